"""Exact repeats of a fixed length, of bytes or words, across and within documents.

What both substring operators share. A window is W consecutive items of one document.

1. Anchors (see anchors.py): each window elects one. Only anchors whose k-gram occurs
   twice go on; the others' windows are unique.
2. Anchors with the same context, W - k items before and W items from the anchor on,
   form a class. All their windows are equal, so a class of two or more needs no look at
   single windows: where its members stand is enough. Members of large classes are
   found by lookup and leave as one row for each stretch of a document (see repeated()).
3. One context of each class, of those k-grams that stand in different contexts, is cut
   from its text; the operators compare these contexts' windows with each other.

Counts are combined before shuffling, no group is gathered, and texts move only if a
bitmap (see shared.matching()) can't rule them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.anchors import elect
from schemaweave.llm.arrays import U64, mixed, span_hashes, text_bytes, text_slices, words
from schemaweave.llm.shared import divided, free_name, matching, packed, stored


#: Names that are looked up without a join, at most.
HOT = 1 << 16
_DISTANCE = (1 << 16) - 1


@dataclass(frozen=True)
class Unit:
    """Windows of `window` bytes or words; k: items of an anchor's k-gram."""

    words: bool
    window: int
    k: int

    def __post_init__(self) -> None:
        if not 0 < self.k <= self.window <= _DISTANCE:
            raise ValueError(f"a window has 1 to {_DISTANCE} items")

    @property
    def span(self) -> int:
        return self.window - self.k + 1

    def items(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        if not self.words:
            return data, offsets
        starts, ends, bounds = words(data, offsets)
        return span_hashes(data, starts, ends), bounds


def keyed(docs: DataFrame, key: str, doc_id: str, text: str) -> DataFrame:
    """docs with the column `key`: the id where ids are unique and not null, else the rows' place by id and text."""
    if not docs.groupBy(doc_id).agg(F.count("*")).toDF("id", "n").where("n > 1 or id is null").take(1):
        return docs.withColumn(key, F.col(doc_id).cast("bigint"))
    placed = docs.repartitionByRange(doc_id, text).sortWithinPartitions(doc_id, text)
    return stored(placed.withColumn(key, F.monotonically_increasing_id()), "keyed", "zstd")


def plain(docs: DataFrame, key: str, doc_id: str, text: str) -> DataFrame:
    """key, doc_id, text of keyed documents."""
    return docs.select(F.col(key).alias("key"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """key, doc_id, text of any documents."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return plain(keyed(named, "key", "doc_id", "text"), "key", "doc_id", "text")


def _at(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's place, and how far before it its last and first window start, in 16 bits each."""
    return place << 32 | (place - last) << 16 | (place - first)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _at() has packed: place, and the least and the greatest distance of a window's start before it."""
    return at >> 32, at >> 16 & _DISTANCE, at & _DISTANCE


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places at which a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def anchors(docs: DataFrame, unit: Unit, contexts: bool) -> DataFrame:
    """The anchors of docs(key, text): gram, m; with contexts: gram, name, m, key, at, end, again.

    Neighbours in a text with the same k-gram (and context) are one row of m anchors: what they
    cover is one piece, so a text that repeats itself doesn't make a row for each item. at is
    the first one's; the piece ends before `end`, and what all but the first cover begins at
    `again` (-1 without others). name: a hash of the context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            items, bounds = unit.items(batch.column("text"))
            place, gram, first, last = elect(items, bounds, unit.k, unit.span)
            row = np.searchsorted(bounds, place, "right") - 1
            if not contexts:
                head = _heads(row, gram)
                yield pa.RecordBatch.from_arrays([pa.array(gram[head].view(np.int64)), pa.array(np.diff(head, append=len(place)))], ["gram", "m"])
                continue
            start, stop = np.maximum(place - unit.span + 1, bounds[row]), np.minimum(place + unit.window, bounds[row + 1])
            context = mixed(span_hashes(items, start, stop) ^ (place - start).astype(U64) * U64(0x9E3779B97F4A7C15))
            head = _heads(row, gram, context)
            m = np.diff(head, append=len(place))
            base = bounds[row]
            end, begin = last - base + unit.window, first - base
            again = np.where(m > 1, np.append(begin, 0)[np.minimum(head + 1, len(begin))], -1)
            columns = [gram[head].view(np.int64), context[head].view(np.int64), m]
            places = [_at(place - base, begin, last - base)[head], end[head + m - 1], again]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column("key").take(pa.array(row[head])), *map(pa.array, places)], ["gram", "name", "m", "key", "at", "end", "again"])

    return docs.mapInArrow(run, "gram bigint, m bigint" if not contexts else "gram bigint, name bigint, m bigint, key bigint, at bigint, end bigint, again bigint")


def classes(docs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """All anchors whose k-gram may repeat, and their classes: gram, name, n, key and at of the first, kinds of context of the k-gram."""
    repeated = stored(anchors(docs, unit, contexts=False).groupBy("gram").agg(F.sum("m").alias("n")).where("n > 1").select("gram"), "grams")
    found = stored(matching(anchors(docs, unit, contexts=True), "gram", repeated, "gram"), "anchors")
    grouped = found.groupBy("gram", "name").agg(F.sum("m").alias("n"), F.min(F.struct("key", "at")).alias("first"))
    grouped = stored(grouped.select("gram", "name", "n", "first.key", "first.at"), "contexts")
    kinds = grouped.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1").select("gram", "kinds")
    return found, stored(grouped.join(kinds, "gram"), "classes")


def _start() -> Column:
    """Where what an anchor's own windows cover begins."""
    return F.shiftright("at", 32) - F.col("at").bitwiseAND(F.lit(_DISTANCE))


def members(found: DataFrame, groups: DataFrame, others_than_first: bool) -> DataFrame:
    """key, start, end of what classes of two or more cover."""
    return repeated(found.withColumn("start", _start()), groups.where("n > 1"), others_than_first)


def repeated(rows: DataFrame, many: DataFrame, others_than_first: bool) -> DataFrame:
    """key, start, end of the rows(gram, name, key, at, start, end, again) whose gram and name are in many(gram, name, n, key, at).

    others_than_first: without the row that `many` has as the first, but for what begins at `again`.
    A name with more than one in HOT of all members (so there are HOT of them at most) is looked
    up where the rows are, and touching pieces of a document become one there: a passage that
    many documents share makes a row for each document, and its names make no join uneven.
    All other names are joined.
    """
    total = many.agg(F.sum("n")).first()[0] or 0
    hot = many.where(F.col("n") > total / HOT).select("gram", "name", "key", "at").toArrow()
    gram, name, key, at = (hot.column(c).to_numpy() for c in hot.column_names)
    code = mixed(gram.view(U64) ^ mixed(name.view(U64)))
    order = np.argsort(code)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(x[order] for x in (code, gram, name, key, at)))

    def run(batches: Iterator[pa.RecordBatch], known: bool) -> Iterator[pa.RecordBatch]:
        code, gram, name, first_key, first_at = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            of = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            own = mixed(of["gram"].view(U64) ^ mixed(of["name"].view(U64)))
            k = np.minimum(np.searchsorted(code, own), max(len(code) - 1, 0))
            on = (gram[k] == of["gram"]) & (name[k] == of["name"]) if len(code) else np.zeros(len(own), bool)
            if not known:
                yield batch.filter(pa.array(~on))
                continue
            if others_than_first:
                first = on & (first_key[k] == of["key"]) & (first_at[k] == of["at"]) if len(code) else on
                of["start"] = np.where(first, of["again"], of["start"])
                on &= ~first | (of["again"] >= 0)
            yield pa.RecordBatch.from_arrays([*map(pa.array, touching(*(of[c][on] for c in ("key", "start", "end"))))], ["key", "start", "end"])

    rows = rows.select("gram", "name", "key", "at", "start", "end", "again")
    looked_up = rows.mapInArrow(lambda b: run(b, True), "key bigint, start bigint, end bigint")
    rest = rows.mapInArrow(lambda b: run(b, False), rows.schema)
    firsts = many.select("gram", "name", *([F.col("key").alias("first_key"), F.col("at").alias("first_at")] if others_than_first else []))
    joined = rest.join(firsts, ["gram", "name"], "inner" if others_than_first else "left_semi")
    if others_than_first:
        first = (F.col("key") == F.col("first_key")) & (F.col("at") == F.col("first_at"))
        joined = joined.withColumn("start", F.when(first, F.col("again")).otherwise(F.col("start"))).where("start >= 0")
    return looked_up.unionByName(joined.select("key", "start", "end"))


def touching(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same cover with pieces of one key that touch or overlap made one."""
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    number = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(key) else key
    reach = np.maximum.accumulate(end + (number << 40)) - (number << 40) if len(key) else end
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > reach[:-1])
    head = np.flatnonzero(new)
    return key[head], start[head], reach[np.append(head[1:], len(key)) - 1] if len(key) else end


def with_contexts(docs: DataFrame, groups: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Rows that `run` makes of each document that holds contexts to compare, from key, text, and lists at, gram and n."""
    wanted = groups.where("kinds > 1")
    lists = wanted.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "gram", "n"))).alias("c"))
    lists = lists.select("key", F.col("c.at").alias("at"), F.col("c.gram").alias("gram"), F.col("c.n").alias("n"))
    return matching(docs.select("key", "text"), "key", wanted, "key").join(lists, "key").mapInArrow(run, schema)


def flat(column: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    sizes = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
    return np.asarray(column.flatten()).astype(kind), np.repeat(np.arange(len(sizes)), sizes)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the counts, its index and 0, 1, ... below it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def window_names(docs: DataFrame, groups: DataFrame, unit: Unit) -> DataFrame:
    """gram, name, key, start of every window that the contexts of `groups` own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            items, bounds = unit.items(batch.column("text"))
            at, row = flat(batch.column("at"))
            gram, _ = flat(batch.column("gram"))
            place, low, high = unpacked(at)
            place = place + bounds[row]
            of, step = spread(high - low + 1)
            start = place[of] - high[of] + step
            name = span_hashes(items, start, start + unit.window).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram[of]), pa.array(name), batch.column("key").take(pa.array(row[of])), pa.array(start - bounds[row[of]])], ["gram", "name", "key", "at"])

    return stored(with_contexts(docs, groups, run, "gram bigint, name bigint, key bigint, at bigint"), "windows")


def repeated_windows(windows: DataFrame, unit: Unit, others_than_first: bool) -> DataFrame:
    """key, start, end of the windows(gram, name, key, at) of which there are two or more."""
    many = windows.groupBy("gram", "name").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("first")).where("n > 1")
    many = stored(many.select("gram", "name", "n", "first.key", "first.at"), "names")
    rows = windows.select("gram", "name", "key", "at", F.col("at").alias("start"), (F.col("at") + unit.window).alias("end"), F.lit(-1).cast("bigint").alias("again"))
    return repeated(rows, many, others_than_first)


def _runs(covered: DataFrame) -> DataFrame:
    """key, spans (start, end, start, end, ...): no more than a document's length allows."""
    longest = covered.groupBy("key", "start").agg(F.max("end").alias("end"))
    return longest.groupBy("key").agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("spans"))


def _cut(data: np.ndarray, offsets: np.ndarray, spans: list, unit: Unit) -> Iterator[tuple[int, int, int, bytes]]:
    """Items, removed items, removed runs and what is kept of each text."""
    starts, ends, bounds = words(data, offsets) if unit.words else (None, None, offsets)
    whole = data.tobytes()
    for i, own in enumerate(spans):
        a, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        s, e = np.array(own or [], np.int64).reshape(-1, 2).T
        stay = np.cumsum(np.bincount(s, minlength=n + 1)[: n + 1] - np.bincount(e, minlength=n + 1)[: n + 1])[:n] == 0
        if unit.words:
            kept = b" ".join([whole[x:y] for x, y in zip(starts[a : a + n][stay].tolist(), ends[a : a + n][stay].tolist(), strict=True)])
        else:
            kept = data[a : a + n][stay].tobytes() if own else whole[a : a + n]
        yield n, n - int(stay.sum()), int((~stay & np.append(True, stay[:-1])).sum()) if n else 0, kept


def digests(docs: DataFrame, covered: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of each of docs(key, doc_id, text) without covered(key, start, end).

    Kept bytes are joined as they are, kept words by one space.
    """
    names = ["key", "doc_id", "n", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            n, removed, runs, kept = zip(*_cut(*text_bytes(batch.column("text")), spans, unit), strict=True)
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(digest)], names)

    schema = "key bigint, doc_id bigint, n bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    spans = stored(_runs(covered), "spans")
    cut = matching(docs, "key", spans, "key").join(spans, "key").mapInArrow(run, schema)
    whole = docs.mapInArrow(run, schema).join(spans, "key", "left_anti")
    return packed(whole.unionByName(cut).drop("key"))


def rewritten(docs: DataFrame, text: str, key: str, covered: DataFrame, unit: Unit) -> DataFrame:
    """docs with what is covered cut from the text; a null text stays."""
    of, own = free_name("span_key", docs), free_name("spans", docs)
    spans = stored(_runs(covered).select(F.col("key").alias(of), F.col("spans").alias(own)), "spans")
    maybe, rest = divided(docs, key, spans, of)
    joined = maybe.join(spans, F.col(key) == F.col(of), "left").drop(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            kept = [x[3].decode("utf-8", "ignore") for x in _cut(*text_bytes(column), batch.column(own).to_pylist(), unit)]
            new = pa.array([k if v else None for k, v in zip(kept, column.is_valid().to_pylist(), strict=True)], pa.string())
            names = [c for c in batch.schema.names if c != own]
            yield pa.RecordBatch.from_arrays([new if c == text else batch.column(c) for c in names], names)

    return packed(rest.unionByName(joined.mapInArrow(run, docs.schema)))
