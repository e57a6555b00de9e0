"""Removal of bytes that a repeated string of 200 bytes covers, by sorted suffixes.

Sorting every suffix of the corpus would move more than twenty times the input, so the
suffixes are those at content-defined anchors whose leading tokens repeat (see
repeats.py); every repeated string holds such an anchor at the same place. Each distinct
one is cut out with the bytes before it. Sampled splitters range-partition the suffixes by
their leading bytes, so suffixes that begin alike meet in one bucket and never straddle a
boundary. A bucket sorts them, and the reversed bytes before them, by multikey quicksort
over 8-byte words. Common prefixes of neighbours in both orders tell which windows repeat.

Suffixes whose leading tokens stand in more than `crowd` contexts would make a bucket
large. Spark's aggregation compares these by stretches of windows instead, and looks into
a stretch only where it is neither repeated whole nor alone (see _narrowed()), so a suffix
makes few rows, however many windows it has.

Cases: a null or empty text has no bytes. Rows with one id, or a null id, are told
apart. Texts shorter than a window keep all bytes. No rows give no rows. Only the named
columns are read; remove_from_texts() returns all columns, and drops bytes of a character
that a removed run has cut in two.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.llm import repeats
from schemaweave.llm.arrays import text_bytes, text_slices
from schemaweave.llm.shared import free_name, stored, with_group

CROWD = 4096
_BUCKET_ROWS = 4096
_CUT_ROWS = 2048
#: A stretch of windows is looked into in so many parts.
_PARTS = 4


def multikey_order(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The order of rows of 8-byte keys within ascending groups: ties of one key alone are sorted by the next."""
    order = np.argsort(groups, kind="stable")
    run = groups[order].astype(np.int64)
    open_ = np.ones(len(order), bool)
    for k in range(keys.shape[1]):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        value = keys[order[at], k]
        by = np.lexsort((value, run[at]))
        order[at], value = order[at][by], value[by]
        head = np.append(True, (run[at][1:] != run[at][:-1]) | (value[1:] != value[:-1]))
        run[at] = at[np.flatnonzero(head)][np.cumsum(head) - 1]  # a run is named by its first place
        tied = ~head
        tied[:-1] |= ~head[1:]
        open_[at] = tied
    return order


def neighbour_prefixes(rows: np.ndarray, order: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before it; -1 at the start of a group."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.where(groups[order[1:]] == groups[order[:-1]], shared, -1)
    return out


def _padded(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as 8-byte big-endian keys."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def repeated_offsets(before: np.ndarray, after: np.ndarray, groups: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """Rows by offsets: whether the window that starts so far before the anchor occurs in another row of the group.

    before: bytes before the anchor, nearest first; after: bytes from the anchor on.
    """
    place, shared = [], []
    for side in (after, before):
        order = multikey_order(_padded(side), groups)
        place.append(order)
        shared.append(neighbour_prefixes(side, order, groups))
    out = np.zeros((len(groups), int(high.max(initial=-1)) + 1), bool)
    for d in range(out.shape[1]):
        own = np.flatnonzero((low <= d) & (d <= high))
        if len(own) < 2:
            continue
        names = np.zeros((2, len(groups)), np.int64)
        for name, order, common, need in zip(names, place, shared, (window - d, d), strict=True):
            name[order] = np.cumsum(common < need)
        both = names[0, own] * (len(groups) + 1) + names[1, own]
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        out[own[order[1:][same]], d] = out[own[order[:-1][same]], d] = True
    return out


def _contexts(docs: DataFrame, groups: DataFrame, unit: repeats.Unit) -> DataFrame:
    """Each suffix with the bytes before it, as lead (its first bytes), gram, key, at, n, bytes."""
    left, width = unit.span - 1, unit.span - 1 + unit.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, bounds = text_bytes(batch.column("text"))
            at, row = repeats.flat(batch.column("at"))
            for k in range(0, len(at), _CUT_ROWS):
                part, of = at[k : k + _CUT_ROWS], row[k : k + _CUT_ROWS]
                index = (part >> 32)[:, None] + bounds[of][:, None] + np.arange(-left, unit.window)
                inside = (index >= bounds[of][:, None]) & (index < bounds[of + 1][:, None])
                cut = np.where(inside, data[np.clip(index, 0, max(len(data) - 1, 0))], 255).astype(np.uint8)  # no text has byte 255
                lead = np.ascontiguousarray(cut[:, left : left + 8]).view(">u8")[:, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                gram, n = (repeats.flat(batch.column(c))[0][k : k + _CUT_ROWS] for c in ("gram", "n"))
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(part), [None, pa.py_buffer(cut.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(gram), batch.column("key").take(pa.array(of)), pa.array(part), pa.array(n), cells], ["lead", "gram", "key", "at", "n", "bytes"])

    return repeats.with_contexts(docs, groups, run, "lead bigint, gram bigint, key bigint, at bigint, n bigint, bytes binary")


def _sorted_buckets(contexts: DataFrame, unit: repeats.Unit) -> DataFrame:
    """key, start, end of the repeated windows among suffixes with the same leading tokens."""
    left = unit.span - 1

    def compare(table: pa.Table) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        gram, at, n = (table.column(c).to_numpy() for c in ("gram", "at", "n"))
        place, low, high = repeats.unpacked(at)
        _, groups = np.unique(gram, return_inverse=True)
        again = repeated_offsets(rows[:, :left][:, ::-1], rows[:, left:], groups, low, high, unit.window)
        again[n > 1] = False  # all windows of such a class are known to repeat
        edge = np.zeros((len(again), 1), bool)
        step = np.diff(np.concatenate([edge, again, edge], 1).astype(np.int8), axis=1)
        row, first = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        place = place[row]
        return pa.RecordBatch.from_arrays([table.column("key").combine_chunks().take(pa.array(row)), pa.array(place - stop + 1), pa.array(place - first + unit.window)], ["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < _BUCKET_ROWS:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            full = int(np.flatnonzero(gram != gram[-1]).max(initial=-1)) + 1  # the last group may go on
            if full:
                yield compare(table.slice(0, full))
            held = table.slice(full).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    ranged = contexts.repartitionByRange("lead", "gram").sortWithinPartitions("lead", "gram")
    return ranged.mapInArrow(run, "key bigint, start bigint, end bigint")


def _narrowed(contexts: DataFrame, unit: repeats.Unit) -> DataFrame:
    """key, start, end of the repeated windows among any number of suffixes with the same leading tokens, in rounds.

    A row is a stretch: the windows that start `low` to `high` bytes before the anchor, within one
    of the blocks of `size` distances. Its hull is all that they cover, its core what any window of the
    block covers. Equal hulls make all their windows repeated; a window can be equal only to one with the
    same core. So a core with one hull is settled; of others each hull goes on once, in smaller blocks.
    In the last round a stretch is one window, and core and hull are the same.
    """
    low, high = (F.shiftright("at", b).bitwiseAND(F.lit((1 << 16) - 1)) for b in (16, 0))
    hull = F.substring("bytes", F.lit(unit.span) - high, high - low + unit.window)
    open_ = contexts.select("gram", "key", "at", "n", low.alias("low"), high.alias("high"), hull.alias("hull"))
    found, size = [], 1
    while size * _PARTS < unit.span:
        size *= _PARTS
    while size:
        cut = open_.select("*", F.explode(F.sequence(F.col("low") - F.pmod("low", F.lit(size)), "high", F.lit(size).cast("bigint"))).alias("block"))
        low, high = F.greatest("low", "block"), F.least(F.col("high"), F.col("block") + size - 1)
        cut = cut.select("gram", "key", "at", "n", "block", low.alias("low"), high.alias("high"), F.substring("hull", F.col("high") - high + 1, high - low + unit.window).alias("hull"))
        core = F.substring("hull", F.col("high") - F.col("block") + 1, F.lit(max(0, unit.window - size + 1)))
        name, core = F.xxhash64("low", "high", "hull"), F.xxhash64("gram", "block", core)
        cut = stored(cut.select("gram", name.alias("name"), core.alias("core"), "key", "at", "n", "low", "high", "hull"), "stretches")
        if not cut.take(1):
            break
        hulls = cut.groupBy("gram", "core", "name").agg(F.sum("n").alias("n"), F.min(F.struct("key", "at", "low", "high", "hull")).alias("first"))
        hulls = stored(hulls.select("gram", "core", "name", "n", "first.*"), "hulls")
        place = F.shiftright("at", 32)
        rows = cut.select("gram", "name", "key", "at", (place - F.col("high")).alias("start"), (place - F.col("low") + unit.window).alias("end"), F.lit(-1).cast("bigint").alias("again"))
        found.append(repeats.repeated(rows, hulls.where("n > 1"), others_than_first=False))
        kinds = hulls.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("open", F.lit(True))
        open_ = with_group(hulls, "core", kinds, "kinds").where("open") if size > 1 else open_
        size //= _PARTS
    return functools.reduce(DataFrame.unionByName, found) if found else contexts.select("key", F.col("at").alias("start"), F.col("at").alias("end"))


def repeated_bytes(docs: DataFrame, window: int = 200, crowd: int = CROWD) -> DataFrame:
    """key, start, end (bytes) of the windows of docs(key, text) that start anywhere else too."""
    unit = _unit(window)
    found, groups = repeats.classes(docs, unit)
    copies = repeats.members(found, groups, others_than_first=False)
    sorted_ = _sorted_buckets(stored(_contexts(docs, groups.where(F.col("kinds") <= crowd), unit), "suffixes", "zstd"), unit)
    crowded = _narrowed(stored(_contexts(docs, groups.where(F.col("kinds") > crowd), unit), "crowded"), unit)
    return copies.unionByName(sorted_).unionByName(crowded)


def _unit(window: int) -> repeats.Unit:
    return repeats.Unit(words=False, window=window, k=max(1, min(32, window // 2)))


def remove_repeated_bytes(docs: DataFrame, window: int = 200, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    rows = repeats.texts(docs, doc_id, text)
    out = repeats.digests(rows, repeated_bytes(rows, window, crowd), _unit(window))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def remove_from_texts(docs: DataFrame, window: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes cut from their texts; all columns stay."""
    key = free_name("key", docs)
    rows = repeats.keyed(docs, key, doc_id, text)
    covered = repeated_bytes(repeats.plain(rows, key, doc_id, text), window)
    return repeats.rewritten(rows, text, key, covered, _unit(window)).drop(key)
