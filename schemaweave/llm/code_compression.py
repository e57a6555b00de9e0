"""Product codes of vectors, learned by Lloyd's rounds that filter entries through kd-trees.

Components become integers, vectors are cut into equal consecutive parts, and each part position
has a codebook. Every partition builds a kd-tree over each part of up to CHUNK_BYTES of its
vectors, once; a node caches its bounding box and the sum and number of its points. The trees are
stored, and a round goes down them with the entries that may still be nearest somewhere in a box: an
entry is eliminated where even the corner that favours it most is nearer to the entry nearest to
the box's middle. A subtree with one entry left is assigned at once, by its cached sum; points of
leaves are compared with what is left. Distances are exact integers, so ties go to the lower index
wherever the rows lie. Each task gives one row per entry, Spark adds them up, and the driver sees a
row per codebook entry: parts * entries of them, whatever the input.

Cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. Integer
components beyond LIMIT on either side count as LIMIT. The number of components is that of the row
with the smallest id whose number is a positive multiple of the number of parts; rows with another
number stay, with a null code and error. Null ids come last. Of rows with equal ids, the one with
the smaller vector comes first. With fewer kept rows than entries, codebooks are shorter. An empty
table has no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.shared import stored

#: Bytes of vectors under one set of trees.
CHUNK_BYTES = 2 << 20
#: A node with so many points isn't split.
LEAF = 32
#: Integer components lie between this and its negative, so all sums of squares fit 64 bits.
LIMIT = 1 << 24
#: Numbers that one block of the filter handles.
_BLOCK = 1 << 20
_TREE = pa.struct([(name, pa.binary()) for name in ("points", "order", "nodes", "boxes", "sums")])
_TREE_SQL = "struct<points:binary,order:binary,nodes:binary,boxes:binary,sums:binary>"


@dataclass
class Tree:
    """points: in the order of the tree, rows of integers; order: their rows; nodes: first and last point (exclusive) and first child or -1."""

    points: np.ndarray
    order: np.ndarray
    nodes: np.ndarray
    boxes: np.ndarray
    sums: np.ndarray

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.__dataclass_fields__}

    @classmethod
    def unpacked(cls, raw: dict[str, bytes], width: int) -> Tree:
        whole = lambda name, kind: np.frombuffer(raw[name], kind)
        return cls(whole("points", np.int32).reshape(-1, width), whole("order", np.int32), whole("nodes", np.int32).reshape(-1, 3), whole("boxes", np.int32).reshape(-1, 2, width), whole("sums", np.int64).reshape(-1, width))


def build(points: np.ndarray) -> Tree:
    """A kd-tree: nodes are halved along their widest side until they are small or one point repeated."""
    order, nodes, boxes, sums, at = np.arange(len(points), dtype=np.int32), [[0, len(points), -1]], [], [], 0
    while at < len(nodes):
        first, stop, _ = nodes[at]
        own = points[order[first:stop]]
        low, high = own.min(0), own.max(0)
        boxes.append((low, high))
        sums.append(own.sum(0, dtype=np.int64))
        side = int((high.astype(np.int64) - low).argmax())
        if stop - first > LEAF and high[side] > low[side]:
            half = (stop - first) // 2
            order[first:stop] = order[first:stop][np.argpartition(own[:, side], half)]
            nodes[at][2] = len(nodes)
            nodes += [[first, first + half, -1], [first + half, stop, -1]]
        at += 1
    return Tree(points[order].astype(np.int32), order, np.array(nodes, np.int32), np.array(boxes, np.int32), np.array(sums, np.int64))


def filtered(tree: Tree, book: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]]]:
    """Nodes all of whose points go to one entry, with that entry; and the points of other leaves (first, last exclusive) with theirs."""
    width = book.shape[1]
    most = max(int(np.abs(book).max(initial=0)), int(np.abs(tree.boxes).max(initial=0)))
    kind = np.float64 if 8 * width * most * most < 1 << 53 else np.int64  # floats are as exact up to there, and faster
    book = book.astype(kind)
    squares, place = (book * book).sum(1), np.arange(len(book))
    whole, single, block = [], [], max(1, _BLOCK // book.size)
    level, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    while len(level):
        deeper, left = [], []
        for at in range(0, len(level), block):
            nodes, keep = level[at : at + block], alive[at : at + block]
            low, high = tree.boxes[nodes, 0].astype(kind), tree.boxes[nodes, 1].astype(kind)
            from_middle = np.where(keep, squares - (low + high) @ book.T, np.inf)
            best = from_middle.argmin(1)
            away = book[None] - book[best][:, None]
            # How much farther than the best the entry is, at the corner of the box that favours it most.
            farther = squares[None] - squares[best][:, None] - 2 * (away * np.where(away > 0, high[:, None], low[:, None])).sum(2)
            keep = keep & ((farther < 0) | ((farther == 0) & (place <= best[:, None])))
            alone, leaf = keep.sum(1) == 1, tree.nodes[nodes, 2] < 0
            whole += zip(nodes[alone].tolist(), keep[alone].argmax(1).tolist(), strict=True)
            for i in np.flatnonzero(leaf & ~alone).tolist():
                first, stop, _ = tree.nodes[nodes[i]].tolist()
                entries = np.flatnonzero(keep[i])
                nearest = (squares[entries] - 2 * (tree.points[first:stop].astype(kind) @ book[entries].T)).argmin(1)
                single.append((first, stop, entries[nearest]))
            down = ~leaf & ~alone
            child = tree.nodes[nodes[down], 2].astype(np.int64)
            deeper.append(np.stack([child, child + 1], 1).ravel())
            left.append(np.repeat(keep[down], 2, axis=0))
        level, alive = np.concatenate(deeper), np.concatenate(left)
    return whole, single


def summed(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points of each entry."""
    counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    whole, single = filtered(tree, book)
    for node, entry in whole:
        counts[entry] += tree.nodes[node, 1] - tree.nodes[node, 0]
        sums[entry] += tree.sums[node]
    for first, stop, entries in single:
        np.add.at(counts, entries, 1)
        np.add.at(sums, entries, tree.points[first:stop].astype(np.int64))
    return counts, sums


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point, in the order of the rows."""
    found = np.zeros(len(tree.points), np.int64)
    whole, single = filtered(tree, book)
    for node, entry in whole:
        found[tree.nodes[node, 0] : tree.nodes[node, 1]] = entry
    for first, stop, entries in single:
        found[first:stop] = entries
    apart = tree.points.astype(np.int64) - book[found]
    entries, squares = np.empty_like(found), np.empty_like(found)
    entries[tree.order], squares[tree.order] = found, (apart * apart).sum(1)
    return entries, squares


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, as a bigint within the limits."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(scale * x.cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))))


def _finite(vector: str) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(number(x), F.lit(False)))


def _trees(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """One row for each chunk of a partition: its ids and labels, and a tree for each part position."""
    most = max(LEAF, CHUNK_BYTES // (4 * parts * width))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while held and sum(b.num_rows for b in held) + batch.num_rows >= most:
                room = most - sum(b.num_rows for b in held)
                yield chunk([*held, batch.slice(0, room)])
                held, batch = [], batch.slice(room)
            while batch.num_rows >= most:
                yield chunk([batch.slice(0, most)])
                batch = batch.slice(most)
            if batch.num_rows:
                held.append(batch)
        if held:
            yield chunk(held)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        cells = table.column("cells").combine_chunks().flatten().to_numpy().reshape(-1, parts, width)
        trees = [build(cells[:, p]).packed() for p in range(parts)]
        lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(_TREE))], ["ids", "labels", "trees"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    return rows.mapInArrow(built, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<{_TREE_SQL}>")


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape
    shared = trees.sparkSession.sparkContext.broadcast(books)
    sums = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for p, raw in enumerate(row):
                    counts, added = summed(Tree.unpacked(raw.as_py(), width), shared.value[p])
                    total[p, :, 0] += counts
                    total[p, :, 1:] += added
        part, entry = np.nonzero(total[:, :, 0])
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, *total[part, entry].T)], ["part", "entry", "n", *sums])

    got = trees.select("trees").mapInArrow(run, "part bigint, entry bigint, n bigint, " + ", ".join(f"{s} bigint" for s in sums)).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).toArrow()
    after = books.copy()
    if got.num_rows:
        columns = {c: got.column(c).to_numpy() for c in got.column_names}
        after[columns["part"], columns["entry"]] = np.stack([columns[s] for s in sums], 1) // columns["n"][:, None]
    shared.unpersist()
    return after


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of each kept row, and the final codebooks (part, entry, place).

    A code is the index of each part's entry in hex, two digits each (more if there are over 256 entries).
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(_finite("vector")).select("id", "label", integers("vector", scale).alias("cells"))
    usable = rows.where((F.size("cells") > 0) & (F.size("cells") % parts == 0))
    first = usable.orderBy(F.col("id").asc_nulls_last(), "cells").limit(1).collect()
    length = len(first[0]["cells"]) if first else parts
    fitting = F.size("cells") == length
    start = rows.where(fitting).orderBy(F.col("id").asc_nulls_last(), "cells").limit(entries).select("cells").toArrow().column("cells").to_pylist()
    books = np.array(start, np.int64).reshape(len(start), parts, length // parts).transpose(1, 0, 2)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    none = rows.where(~fitting).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if not start:
        return none.select(F.col("id").alias(vec_id), F.col("label").alias(label), "code", "error"), books
    trees = stored(_trees(rows.where(fitting), parts, length // parts), "trees")
    for _ in range(rounds):
        books = _round(trees, books)
    shared, digits = vectors.sparkSession.sparkContext.broadcast(books), max(2, len(f"{entries - 1:x}"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [assigned(Tree.unpacked(raw.as_py(), shared.value.shape[2]), shared.value[p]) for p, raw in enumerate(batch.column("trees")[i])]
                codes = ["".join(f"{x:0{digits}x}" for x in row) for row in np.stack([f[0] for f in found], 1).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array(codes), pa.array(sum(f[1] for f in found))], ["id", "label", "code", "error"])

    done = trees.mapInArrow(coded, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint").unionByName(none)
    return done.select(F.col("id").alias(vec_id), F.col("label").alias(label), "code", "error"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components, by part, entry and place, as decimals between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
