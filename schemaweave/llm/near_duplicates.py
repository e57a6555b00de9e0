"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its distinct 5-word shingles, hashed to 64 bits; its sketch is
the SKETCH smallest hashes. Documents with equal sets form a class with one
representative. Then, among representatives:

1. Inverted lists of the LISTED smallest values bring together documents that share one.
   Pairs of short lists count how many lists they share: a pair with Jaccard 0.85 shares
   fewer than LEAST of 16 values with probability 6e-9.
2. A document in a long list (a passage or family that many documents share) also gets
   BANDS keys of ROWS min-hashes each, of its full set, so that sets of unlike size share
   them as often as others: a pair at 0.85 has none in common with probability
   (1 - 0.85 ** 6) ** 50, 5e-11; at 0.80 it is 3e-7.
   Large band groups are compared with their most central document only.
3. The union sketch of a pair (the SKETCH smallest of both) estimates its Jaccard
   similarity; pairs 5.5 standard deviations below the threshold are dropped.
4. The rest are verified on full sets.
5. Large groups that still hold more than one component are compared exactly, block by
   block: full sets of two blocks of about BLOCK documents make one group of a shuffle, a
   matrix product counts what each pair shares, and only links between components leave
   it. So a central document only saves work, and no link is lost.
6. Components of the links; the smallest id of each is kept.

Cases: a text with fewer than five words is one shingle, its whole sequence; without
words its set is empty and it is linked with nothing. A null id has a null
component and is kept. Rows that share an id are compared each and stay or go together.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.llm.arrays import U64, lowered, mixed, row_sums, span_hashes, text_bytes, text_slices, window_hashes, window_starts, words
from schemaweave.llm.components import components
from schemaweave.llm.shared import matching, stored

WIDTH = 5
SKETCH = 128
LISTED = 16
SHORT = 32
LEAST = 4
BANDS = 50
ROWS = 6
BLOCK = 512
_SIGN = U64(1 << 63)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and the bounds of each text's."""
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    first, row = window_starts(bounds, WIDTH)
    values = window_hashes(hashes, WIDTH)[first]
    count = np.diff(bounds)
    few = np.flatnonzero((count > 0) & (count < WIDTH))
    if len(few):
        own = np.zeros(len(few), U64)
        for i, k in enumerate(few):
            h = U64(count[k])
            for x in hashes[bounds[k] : bounds[k + 1]]:
                h = mixed(np.array([h ^ x], U64))[0]
            own[i] = h
        values, row = np.append(values, own), np.append(row, few)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(column) + 1))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((values ^ _SIGN).view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        values, bounds = shingle_sets(batch.column("text"))
        n = np.diff(bounds)
        small = np.arange(len(values)) - np.repeat(bounds[:-1], n) < SKETCH
        prints = [row_sums(mixed(values ^ U64(seed)).view(np.int64), bounds) for seed in (0x1234567, 0x89ABCDEF01)]
        low = np.arange(len(values)) - np.repeat(bounds[:-1], n) < LISTED
        lists = [_lists(values[of], np.append(0, np.cumsum(np.minimum(n, k)))) for of, k in ((low, LISTED), (small, SKETCH))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *map(pa.array, prints), *lists], ["doc_id", "n", "print_a", "print_b", "low", "sketch"])


_MULTIPLY = mixed(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The band keys of each full set: per row of a band the least of its permuted values."""
    for batch in text_slices(batches):
        values, bounds = shingle_sets(batch.column("text"))
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        keys = np.empty((len(full), BANDS), U64)
        for band in range(BANDS):
            key = np.full(len(full), band, U64)
            for by in _MULTIPLY[band * ROWS : (band + 1) * ROWS]:
                key = mixed(key * U64(31) ^ np.minimum.reduceat(values * by, bounds[full]))
            keys[:, band] = key
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(full)), pa.array(n[full].astype(np.int64)), lists], ["doc_id", "n", "keys"])


def _in_range(a: Column, b: Column, percent: int) -> Column:
    """Only sets of like size can be so similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _all_pairs(groups: DataFrame, percent: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of groups(key, doc_id, n) of bounded size, as (a, b) with a < b."""
    one, two = (groups.select("key", F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *extra)]) for x in "ab")
    pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & _in_range(F.col("n_a"), F.col("n_b"), percent))
    return pairs.select("a", "b", *[f"{c}_{x}" for c in extra for x in "ab"])


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose union sketch doesn't rule them out."""
    both = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a")), "a")
    both = both.join(sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("s_a"), batch.column("s_b"), strict=True)):
                x, y = np.asarray(x.values), np.asarray(y.values)
                union = np.sort(np.concatenate([x, y]))
                same = union[1:] == union[:-1]
                k = min(SKETCH, len(union) - int(same.sum()))
                new = np.flatnonzero(np.append(True, ~same))
                limit = union[new[k - 1]]
                shared = int((same & (union[1:] <= limit)).sum())
                keep[i] = shared >= k * t - 5.5 * np.sqrt(k * t * (1 - t))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return both.where(_in_range(F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough on full sets."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a bigint, b bigint")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        values, bounds = shingle_sets(batch.column("text"))
        rows = [values[a:b].view(np.int64).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "shingles"])


def _shared(rows: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    values = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    names, place, count = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # a value of one set only is shared by none
    of, place = of[count[place] > 1], column[place[count[place] > 1]]
    out = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int((count > 1).sum()), 4096):
        here = (place >= at) & (place < at + 4096)
        part = np.zeros((len(rows), 4096), np.float32)
        part[of[here], place[here] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _across(large: DataFrame, hubs: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of the verified links within families: documents joined by large groups."""
    family = components(hubs)
    placed = large.select("doc_id").distinct().join(family.select(F.col("node").alias("doc_id"), F.col("root").alias("family")), "doc_id")
    placed = stored(placed.join(roots, placed["doc_id"] == roots["node"], "left").select("family", "doc_id", F.coalesce("root", "doc_id").alias("root")), "families")
    sizes = placed.groupBy("family", "root").agg(F.count("*").alias("m")).groupBy("family").agg(F.sum("m").alias("m"), F.count("*").alias("parts"))
    blocks = placed.join(sizes.where("parts > 1"), "family").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    own = blocks.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = own.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "root")
    filled = dealt.join(matching(sets, "doc_id", placed, "doc_id"), "doc_id")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        rows = [np.frombuffer(x, np.int64) for x in table.column("shingles").to_pylist()]
        shared = _shared(rows)
        n = np.array([len(x) for x in rows])
        ids, root = table.column("doc_id").to_numpy(), table.column("root").to_numpy()
        a, b = np.nonzero(100 * shared >= percent * (n[:, None] + n[None] - shared))
        apart = root[a] < root[b]
        a, b = a[apart], b[apart]
        _, one = np.unique(np.stack([root[a], root[b]]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
        return pa.table({"a": ids[a[one]], "b": ids[b[one]]})

    return filled.groupBy("family", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document; percent is 80 at least, for which the search's constants hold."""
    if percent < 80:
        raise ValueError("below a similarity of 0.80 the candidate search would lose links")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketched = stored(rows.mapInArrow(_sketch, "doc_id bigint, n bigint, print_a bigint, print_b bigint, low array<bigint>, sketch array<bigint>"), "sketches")
    full = sketched.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "print_a", "print_b").agg(F.min("doc_id").alias("rep"))
    members = full.select("doc_id", "n", "print_a", "print_b").join(classes, ["n", "print_a", "print_b"]).select("doc_id", "rep")
    listed = full.select("doc_id", "n", "low").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.explode("low").alias("key"), "doc_id", "n")
    sketches = full.select("doc_id", "n", "sketch")

    sizes = listed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    long_of = F.count_if(F.col("m") > SHORT).over(Window.partitionBy("doc_id"))
    lists = stored(listed.join(sizes, "key").withColumn("long", long_of), "lists")
    pairs = _all_pairs(lists.where(F.col("m") <= SHORT), percent, ("long",)).groupBy("a", "b").agg(F.count("*").alias("c"), F.max(F.least("long_a", "long_b")).alias("more"))
    overlapping = pairs.where(F.col("c") + F.col("more") >= LEAST).select("a", "b")

    crowded = stored(lists.where(F.col("m") > SHORT).select("doc_id").distinct(), "crowded")
    banded = matching(rows, "doc_id", crowded, "doc_id").mapInArrow(_bands, "doc_id bigint, n bigint, keys array<bigint>")
    banded = stored(banded.join(crowded, "doc_id", "left_semi").select(F.explode("keys").alias("key"), "doc_id", "n"), "bands")
    bands = banded.join(banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")
    large = stored(bands.where(F.col("m") > SHORT), "bands")
    centre = large.join(large.groupBy("doc_id").agg(F.sum("m").alias("met")), "doc_id")
    hub = centre.groupBy("key").agg(F.max_by("doc_id", F.struct("met", "doc_id")).alias("hub"))
    hubs = stored(large.join(hub, "key").where("doc_id <> hub").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct(), "hubs")
    candidates = stored(overlapping.unionByName(_all_pairs(bands.where(F.col("m") <= SHORT), percent)).unionByName(hubs).distinct(), "pairs")

    def ends(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(F.struct(F.col("a").alias("doc_id")), F.struct(F.col("b").alias("doc_id"))))).distinct()

    likely = stored(_estimated(candidates, matching(sketches, "doc_id", stored(ends(candidates), "ends"), "doc_id"), percent), "likely")
    # Full sets only of documents that have a candidate.
    wanted = stored(ends(likely).unionByName(large.select("doc_id")).distinct(), "wanted")
    sets = stored(matching(rows, "doc_id", wanted, "doc_id").join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, shingles binary"), "sets")
    links = stored(_verified(likely, sets, percent), "verified")
    more = stored(_across(large, hubs, components(links), sets, percent), "verified")
    final = components(links.unionByName(more).unionByName(members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))

    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
