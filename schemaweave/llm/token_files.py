"""Token-id files in Simple-8b.

A file set is a Parquet dataset, so any store and commit protocol that Spark knows
will do. Each row is one shard of consecutive documents in ascending id order:

    part, shard      the shard's place: parts in order, shards in order within a part
    start            ids before the shard within its part
    n_ids            ids in the shard
    doc_ids, lengths the documents and the number of ids of each
    payload          the ids, as below

A payload is little-endian: magic `S8W1`, a u32 number of blocks, u64 number of ids,
one u32 per block with its first word, then 64-bit words. A block holds BLOCK ids and is
packed alone, so blocks decode independently. The top four bits of a word select how many
ids of how many bits the other 60 hold. Selector 0 is an escape: the next word is one raw
value of up to 64 bits. Selector 1 is a run of 120 zeros.

Cases: a null text is empty and has only the end id; a null id sorts first; rows with the
same id are ordered by their text and all stay; no rows give no rows. Only the named
columns are read. A text longer than a shard makes one longer shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaweave.llm.arrays import text_slices

#: Fixed values of the code: ids per word and bits per id, by selector.
COUNTS = (1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 1024
SHARD_IDS = 1 << 17
_MAGIC = b"S8W1"
_CACHED_WORDS = 600_000
#: Fixed value: the split pattern for which _ASCII_PIECES holds.
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_POWERS = 1 << np.arange(64, dtype=np.uint64)
_WIDTH = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)  # bits of small ids


def pack(ids: np.ndarray) -> bytes:
    """The payload that holds these ids."""
    ids = np.asarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    wide = np.full((blocks, BLOCK), 255, np.uint8)
    wide.reshape(-1)[: len(ids)] = _WIDTH[ids.astype(np.int64)] if len(ids) and ids.max() < len(_WIDTH) else np.searchsorted(_POWERS, ids, "right")
    selector = np.zeros((blocks, BLOCK), np.uint8)
    runs: dict[int, np.ndarray] = {1: wide}

    def run(n: int) -> np.ndarray:
        """The most bits among n ids from each place on."""
        if n not in runs:
            half = 1 << ((n - 1).bit_length() - 1)
            first = run(half)
            out = np.full_like(first, 255)
            np.maximum(first[:, : BLOCK - (n - half)], first[:, n - half :], out=out[:, : BLOCK - (n - half)])
            runs[n] = out
        return runs[n]

    for s in range(15, 0, -1):
        np.copyto(selector, np.uint8(s), where=run(COUNTS[s]) <= BITS[s])
    steps, places = np.array(COUNTS, np.uint8)[selector].reshape(-1).tolist(), []
    chosen = selector.reshape(-1)
    ends = []
    for b in range(blocks):
        at, stop = b * BLOCK, min((b + 1) * BLOCK, len(ids))
        ends.append(len(places))
        while at < stop:
            places.append(at)
            at += steps[at]
    at = np.array(places, np.int64)
    kind = chosen[at] if len(at) else np.zeros(0, np.uint8)
    size = 1 + (kind == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(1, 16):
        of = np.flatnonzero(kind == s)
        if not len(of):
            continue
        value = np.full(len(of), s << 60, np.uint64)
        if BITS[s]:
            for k in range(COUNTS[s]):
                value |= ids[at[of] + k] << np.uint64(k * BITS[s])
        words[place[of]] = value
    raw = np.flatnonzero(kind == 0)
    words[place[raw] + 1] = ids[at[raw]]
    firsts = np.append(place, len(words))[np.array(ends, np.int64)] if blocks else np.zeros(0)
    return _MAGIC + struct.pack("<IQ", blocks, len(ids)) + firsts.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a payload, or of some of its blocks."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a payload of this format")
    blocks, n = struct.unpack_from("<IQ", payload, 4)
    last_block = blocks if last_block is None else min(last_block, blocks)
    firsts = np.frombuffer(payload, "<u4", blocks, 16)
    words = np.frombuffer(payload, "<u8", offset=16 + 4 * blocks)
    words = words[firsts[first_block] if first_block < blocks else len(words) : firsts[last_block] if last_block < blocks else len(words)]
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(kind == 0)
    while len(escapes):  # a raw value may look like an escape itself
        first = escapes[np.append(True, np.diff(escapes) > 1)]
        raw[first + 1] = True
        escapes = escapes[~np.isin(escapes, first) & ~raw[escapes]]
    count = np.array(COUNTS)[kind]
    count[raw] = 0
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(2, 16):
        of = np.flatnonzero((kind == s) & ~raw)
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s] if len(of) else 0):
            out[place[of] + k] = (words[of] >> np.uint64(k * BITS[s])) & mask
    of = np.flatnonzero((kind == 0) & ~raw)
    out[place[of]] = words[of + 1]
    return out[: min(n, last_block * BLOCK) - first_block * BLOCK]


class _Numbered(dict):
    """Gives each key a number; a new key is kept to be encoded."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class _Lists:
    """Lists of numbers end to end."""

    def __init__(self) -> None:
        self.values, self.first, self.count, self.n, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0, 0

    def one(self, n: int) -> list[int]:
        return self.values[self.first[n] : self.first[n] + self.count[n]].tolist()

    def add(self, sizes: np.ndarray, values: np.ndarray) -> None:
        while self.n + len(sizes) > len(self.first):
            self.first, self.count = (np.append(x, np.zeros_like(x)) for x in (self.first, self.count))
        while self.used + len(values) > len(self.values):
            self.values = np.append(self.values, np.zeros_like(self.values))
        self.first[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.count[self.n : self.n + len(sizes)] = sizes
        self.values[self.used : self.used + len(values)] = values
        self.n, self.used = self.n + len(sizes), self.used + len(values)

    def joined(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these lists end to end, and where each ends."""
        count = self.count[which]
        stop = np.cumsum(count, dtype=np.int64)
        return self.values[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.first[which] - (stop - count), count)], stop


#: What this kind of tokenizer's pre-tokenizer finds in lower-case printable ASCII without white space.
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_EASY = re.compile(rb"[!-;=-~]+")  # no `<`, with which special tokens begin


class Encoder:
    """Encodes texts word by word if the tokenizer's pre-tokenizer is the known one, which never joins what white space parts; else whole.

    So each word is encoded once. Words of printable ASCII are cut as its pre-tokenizer does and their pieces go straight to
    its model; all others, and those that may hold a special token, go through the whole
    tokenizer, many at once with a special token between them.
    """

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(iter(added.items()), ("", -1))
        self.special = tuple(added)
        settings = json.loads(definition)
        self.plain = all(x[0] == "<" for x in added) and settings.get("pre_tokenizer", {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex") == _KNOWN_PATTERN
        self.words, self.lists, self.before = _Numbered(), _Lists(), ({}, _Lists())

    def _whole(self, words: list[str]) -> list[list[int]]:
        """Each word's ids, by the whole tokenizer."""
        if not self.mark:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        special = re.compile("|".join(map(re.escape, self.special)))
        found = {w: self.tokenizer.encode(w, add_special_tokens=False).ids for w in words if special.search(w)}
        rest = [w for w in words if w not in found]
        for at in range(0, len(rest), 256):
            some = rest[at : at + 256]
            ids = self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids
            ends = [i for i, x in enumerate(ids) if x == self.mark_id] + [len(ids)]
            first = 0
            for w, end in zip(some, ends, strict=True):
                found[w] = ids[first:end]
                first = end + 1
        return [found[w] for w in words]

    def _learn(self) -> None:
        """Encode the new words, and the pieces that they consist of."""
        words, base = self.words, self.lists.n
        new, ids, hard, joined = words.new, [], [], []
        cut, easy, tokenize = _ASCII_PIECES.findall, _EASY.fullmatch, self.model.tokenize
        before, kept = self.before
        for w in new:  # grows meanwhile
            n = before.get(w)
            if n is not None:
                ids.append(kept.one(n))
                continue
            if not self.plain or not easy(w):
                hard.append(len(ids))
                ids.append(w)
                continue
            parts = cut(w.lower())
            if len(parts) == 1 and parts[0] == w:
                ids.append([t.id for t in tokenize(w.decode())])
            else:
                joined.append(len(ids))
                ids.append([words[x] for x in parts])
        for i, found in zip(hard, self._whole([ids[i].decode("utf-8", "replace") for i in hard]), strict=True):
            ids[i] = found
        for i in joined:
            ids[i] = [x for n in ids[i] for x in (ids[n - base] if n >= base else self.lists.one(n))]
        self.lists.add(np.fromiter(map(len, ids), np.int64, len(ids)), np.array(list(chain.from_iterable(ids)), np.int32))
        words.new = []

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with end_id after each text, and the number of ids of each text."""
        if not self.plain:  # to other tokenizers white space may matter
            found = [np.array([*e.ids, end_id], np.int32) for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        if len(self.words) > _CACHED_WORDS:  # what is used again is taken over from the generation before
            self.before, self.words, self.lists = (self.words, self.lists), _Numbered(), _Lists()
        if not self.lists.n:  # number 0 is the end of a text
            self.words[b""] = 0
            self.lists.add(np.ones(1, np.int64), np.array([end_id], np.int32))
        look = self.words.__getitem__
        rows = [np.array([*map(look, text.split()), 0], np.int32) for text in texts]
        if self.words.new:
            self._learn()
        which = np.concatenate(rows)
        ids, stop = self.lists.joined(which)
        return ids, np.diff(stop[which == 0], prepend=0)


@cache
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


SHARD_SCHEMA = "part int, shard int, start bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the file set. tokenizer: path of a `tokenizers` file, read on the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # a few MB, whatever the corpus

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, start
            ids = np.concatenate(held)
            row = [[part], [shard], [start], [len(ids)], [keys[:]], [np.concatenate(sizes)], [pack(ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            shard, start = shard + 1, start + len(ids)
            for x in (keys, held, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "shard", "start", "n_ids", "doc_ids", "lengths", "payload"])

        encoder = _encoder(definition.value)
        for batch in text_slices(batches, limit=1 << 19):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            ids, lengths = encoder.encode(texts, end_id)
            keys += batch.column("doc_id").to_pylist()
            held.append(ids)
            sizes.append(lengths)
            if sum(map(len, held)) >= SHARD_IDS:
                yield close()
        if keys:
            yield close()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _starts(shards: DataFrame) -> DataFrame:
    """Ids before each part. There is one row per written file here."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def read(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document; with digests, ids_crc32 instead of ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows)):  # one shard at a time
            ids, lengths = unpack(row["payload"]).astype("<u4"), np.array(row["lengths"], np.int64)
            stop = np.cumsum(lengths)
            each = [ids[b - n : b] for b, n in zip(stop, lengths, strict=True)]
            last = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digests else pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(each), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + stop - lengths), pa.array(lengths), last], ["part", "doc_id", "within", "n_tokens", "last"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    kind = "bigint" if digests else "array<bigint>"
    rows = shards.mapInArrow(documents, f"part int, doc_id bigint, within bigint, n_tokens bigint, last {kind}")
    return rows.join(_starts(shards), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digests else "ids"))
