"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most PASSAGE words, half overlapping. A randomised
SVD of the TF-IDF matrix of these passages, and of all passages of all documents, is computed by
Spark: each power iteration sums partial products where the rows are, and at most
DIMENSIONS * RANK numbers, whatever the corpus, reach the driver. There is one model for all
items. Document frequencies count all documents; every word has weight, common ones a low one.

A document holds an item if, within REACH words, it has in order at least `same` of a passage's
words, or at least `like` of them and the answer, the passage's last words. So at least so many
of the passage's rarest words must stand within REACH words of each other. Inverted lists of
these words find all such places of every document, without loss; there, windows of 16, 32 and
64 words are compared with the passage by cosine in the latent space, and the candidates that
reach `cosine` by the longest common subsequence and the answer check.

Words are lower-cased (A-Z) and known by 64-bit hashes; weights go by the first 20 bits of these.
Passages are compared in chunks of about CHUNK, which bounds what is broadcast (some 40 MB); an
item stays whole. The documents are read once to store the numbers of the benchmark's words in
them, which frequencies and iterations read, and once for each chunk.

Cases: a null or empty text has no words, a null or empty item no passages. A null doc_id is
carried like others. Repeated items and rows are judged each. Without items nothing is found.
Only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.arrays import U64, lowered, mixed, span_hashes, spans_of_rows, text_bytes, text_slices, words
from schemaweave.llm.shared import dropped, stored

PASSAGE = 48
REACH = 2 * PASSAGE
SLOTS = 1 << 20
DIMENSIONS = 1 << 15
RANK = 128
CHUNK = 32_768
#: Passages that are multiplied at once.
BLOCK = 32
STEP = 12
#: Only the search's cost depends on it.
CHANCE = 1e-5
SCALES = (16, 32, 64)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    data = lowered(data)
    starts, ends, bounds = words(data, offsets)
    return span_hashes(data, starts, ends), bounds


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(44)).astype(np.int64)


def passages(benchmark: DataFrame) -> DataFrame:
    """item_id and words (64-bit hashes) of each passage of benchmark(item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, bounds = _hashed(batch.column("text"))
            item, cut = [], []
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for s in [*range(a, max(b - PASSAGE, a), PASSAGE // 2), max(b - PASSAGE, a)] if b > a else []:
                    item.append(row)
                    cut.append(hashes[s : min(s + PASSAGE, b)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(item, pa.int64())), pa.array(cut, pa.binary())], ["item_id", "words"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words binary")


def _joined(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of passages end to end, and their bounds."""
    return np.frombuffer(b"".join(cuts), U64), np.append(0, np.cumsum([len(x) // 8 for x in cuts])).astype(np.int64)


@dataclass
class Space:
    """The weights of the benchmark's words, and the latent space. place: number of a slot, -1 for others; idf by number."""

    place: np.ndarray
    idf: np.ndarray
    basis: np.ndarray | None = None

    @functools.cached_property
    def dimension(self) -> np.ndarray:
        """The dimension of each number: by its slot, of at most DIMENSIONS, numbered without gaps."""
        return np.unique(np.flatnonzero(self.place >= 0) % DIMENSIONS, return_inverse=True)[1]

    @property
    def dimensions(self) -> int:
        return int(self.dimension.max(initial=-1)) + 1

    def rows(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse TF-IDF rows of unit length: row, dimension, value."""
        number = self.place[_slots(hashes)]
        at = np.flatnonzero(number >= 0)
        return self.weighted(number[at], np.searchsorted(bounds, at, "right") - 1, len(bounds) - 1)

    def weighted(self, number: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of known words, given their numbers, and the row of each of n."""
        norm = np.sqrt(np.bincount(row, self.idf[number] ** 2, minlength=n))
        return row, self.dimension[number], self.idf[number] / np.maximum(norm[row], 1e-9)

    def project(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Latent vectors of unit length, one per row."""
        row, dimension, value = self.rows(hashes, bounds)
        out = np.zeros((len(bounds) - 1, self.basis.shape[1]), np.float32)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] = np.add.reduceat(self.basis[dimension] * value[:, None].astype(np.float32), first, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _numbered(docs: DataFrame, cut: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The number of each slot, -1 for those without a word of the benchmark; and of each text numbers (of its known words) and sizes (of its passages, in known words)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(_joined(batch.column("words").to_pylist())[0])))], ["slot"])

    marked = np.sort(cut.mapInArrow(slots, "slot bigint").distinct().toArrow().column("slot").to_numpy())  # at most SLOTS
    place = np.full(SLOTS, -1, np.int32)
    place[marked] = np.arange(len(marked))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def cells(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, bounds = _hashed(batch.column("text"))
            number = shared.value[_slots(hashes)]
            at = np.flatnonzero(number >= 0)
            row = np.searchsorted(bounds, at, "right") - 1
            first = np.append(0, np.cumsum(-(-np.diff(bounds) // PASSAGE)))
            sizes = np.bincount(first[row] + (at - bounds[row]) // PASSAGE, minlength=first[-1]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([cells(number[at], np.searchsorted(at, bounds)), cells(sizes, first)], ["numbers", "sizes"])

    numbered = stored(docs.select("text").mapInArrow(run, "numbers binary, sizes binary"), "numbers")
    shared.destroy()
    return place, numbered


def _weighted(place: np.ndarray, numbered: DataFrame, n_docs: int) -> Space:
    """Document frequencies of the benchmark's words over all documents."""
    n_words = int(place.max(initial=-1)) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_words, np.int64)
        for batch in text_slices(batches, "numbers"):
            data, bounds = text_bytes(batch.column("numbers"))
            number, row = data.view(np.int32), np.repeat(np.arange(batch.num_rows), np.diff(bounds) // 4)
            for a in range(0, batch.num_rows, step := max(1, (1 << 22) // max(1, n_words))):
                some = slice(*np.searchsorted(row, [a, a + step]))
                held = np.zeros((step, n_words), bool)
                held[row[some] - a, number[some]] = True
                seen += held.sum(0)
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(seen[full])], ["word", "n"])

    sums = numbered.select("numbers").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(n_words)
    seen[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    return Space(place, np.log((1 + n_docs) / (1 + seen)) + 0.1)


def sampled_passages(hashes: np.ndarray, bounds: np.ndarray, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Words and bounds of at most `most` passages of each text, chosen by a hash of their first word and place. No model is fitted on these: see _factorised()."""
    first = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b, PASSAGE) for a, b in zip(bounds[:-1], bounds[1:], strict=True))])
    text = np.searchsorted(bounds, first, "right") - 1
    stop = np.minimum(first + PASSAGE, bounds[text + 1])
    order = np.lexsort((mixed(hashes[first] ^ (first - bounds[text]).astype(U64)), text))
    rank = np.arange(len(first)) - np.searchsorted(text, text)
    on = np.sort(order[rank < most])
    first, stop = first[on], stop[on]
    return hashes[spans_of_rows(first, stop)], np.append(0, np.cumsum(stop - first))


def block_products(row: np.ndarray, dimension: np.ndarray, value: np.ndarray, q: np.ndarray, out: np.ndarray) -> None:
    """Add the product of the rows' matrix, transposed, with itself and q; row ascends. A block of rows has few dimensions, so its matrix is small."""
    edges = np.searchsorted(row, np.arange(0, int(row.max(initial=-1)) + 1 + BLOCK, BLOCK))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if a < b:
            own, at = np.unique(dimension[a:b], return_inverse=True)
            cells = np.bincount((row[a:b] - k * BLOCK) * len(own) + at, value[a:b], minlength=BLOCK * len(own))
            cells = cells.reshape(BLOCK, len(own)).astype(np.float32)
            out[own] += cells.T @ (cells @ q[own])


def _factorised(numbered: DataFrame, cut: DataFrame, space: Space, rounds: int = 2, seed: int = 3) -> Space:
    """The leading right singular vectors of the matrix of all passages, by randomised power iterations."""
    spark = numbered.sparkSession
    size = max(1, space.dimensions)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(RANK, size))))[0].astype(np.float32)
    plain = spark.sparkContext.broadcast(space)

    def sums_of(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], q: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = np.zeros(q.shape)
        for row, dimension, value in found:
            block_products(row, dimension, value, q, out)
        full = np.flatnonzero(out.any(1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full % 128), pa.array(full), pa.array([x.astype(np.float32).tobytes() for x in out[full]], pa.binary())], ["part", "dimension", "sums"])

    def of_texts(batches: Iterator[pa.RecordBatch], q) -> Iterator[pa.RecordBatch]:
        cells = ((text_bytes(b.column("numbers"))[0].view(np.int32), text_bytes(b.column("sizes"))[0]) for b in text_slices(batches, "numbers"))
        return sums_of((plain.value.weighted(number, np.repeat(np.arange(len(sizes)), sizes), len(sizes)) for number, sizes in cells), q.value)

    def of_passages(batches: Iterator[pa.RecordBatch], q) -> Iterator[pa.RecordBatch]:
        return sums_of((plain.value.rows(*_joined(b.column("words").to_pylist())) for b in batches if b.num_rows), q.value)

    def add(table: pa.Table) -> pa.Table:
        at, inverse = np.unique(table.column("dimension").to_numpy(), return_inverse=True)
        rows = np.frombuffer(b"".join(table.column("sums").to_pylist()), np.float32).reshape(len(inverse), -1)
        out = np.zeros((len(at), rows.shape[1]))
        np.add.at(out, inverse, rows)
        return pa.table({"dimension": at, "sums": pa.array([x.astype(np.float32).tobytes() for x in out], pa.binary())})

    schema = "part bigint, dimension bigint, sums binary"
    for _ in range(rounds):
        q = spark.sparkContext.broadcast(basis)
        parts = numbered.mapInArrow(lambda b, q=q: of_texts(b, q), schema)
        own = cut.select("words").coalesce(16).mapInArrow(lambda b, q=q: of_passages(b, q), schema)
        sums = parts.unionByName(own).groupBy("part").applyInArrow(add, "dimension bigint, sums binary").toArrow().sort_by("dimension")
        q.destroy()
        y = np.zeros(basis.shape)
        if sums.num_rows:
            y[sums.column("dimension").to_numpy()] = np.frombuffer(b"".join(sums.column("sums").to_pylist()), np.float32).reshape(sums.num_rows, -1)
        basis = np.linalg.qr(y)[0].astype(np.float32)
    plain.destroy()
    space.basis = basis
    return space


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with one bit of an integer for each place of a."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def needed(length: int, like: float) -> int:
    """Words of a passage of this length that a document must have in order."""
    return max(1, int(np.ceil(like * length - 1e-9)))


def listed_words(idf: np.ndarray, length: int, like: float) -> int:
    """How many of a passage's words to list, rarest first; idf ascends in frequency, so descends here.

    At most length - needed() of its words may be missing, so of m listed ones more than that
    difference less m must be there, for any m. Taken is the least m for which so many stand within
    REACH words by chance with a probability below CHANCE (by Poisson, for texts of 500 words), or
    the m for which that is least likely.
    """
    missing = length - needed(length, like)
    often = -np.log1p(-np.minimum(np.exp(0.1 - idf), 0.99)) / 500 * REACH  # expected places in a stretch
    m = np.arange(missing + 1, length + 1)
    mean, need = np.cumsum(often)[m - 1], m - missing
    steps = np.cumsum(np.log(np.arange(1, len(need) + 1)))
    chance = need * np.log(mean) - mean - steps
    rare = np.flatnonzero(chance < np.log(CHANCE))
    return int(m[rare[0] if len(rare) else np.argmin(chance)])


class Chunk:
    """Passages with inverted lists of their rarest words."""

    def __init__(self, space: Space, item: pa.Array, cuts: list[bytes], like: float) -> None:
        self.item = item
        self.words, self.bounds = _joined(cuts)
        self.vectors = space.project(self.words, self.bounds)
        idf = space.idf[space.place[_slots(self.words)]]
        pairs, self.need = [], np.ones(len(cuts), np.int64)
        for j, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)):
            own = self.words[a:b]
            order = np.lexsort((own, -idf[a:b]))
            rare = own[order[: listed_words(idf[a:b][order], b - a, like)]]
            word, times = np.unique(own[np.isin(own, rare)], return_counts=True)  # a word has all its places or none
            self.need[j] = max(1, int(times.sum()) - (b - a - needed(b - a, like)))
            pairs.append(np.stack([word, np.full(len(word), j, U64), times.astype(U64)]))
        word, of, times = np.concatenate(pairs, axis=1)
        order = np.argsort(word, kind="stable")
        self.of, self.times = of[order].astype(np.int64), times[order].astype(np.int64)
        self.known, first = np.unique(word[order], return_index=True)
        self.first = np.append(first, len(word))
        self.mark = np.zeros(SLOTS, bool)
        self.mark[_slots(self.known)] = True

    def places(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, passage, and first and last place of stretches with enough of a passage's listed words; one of each 24 places."""
        at = np.flatnonzero(self.mark[_slots(hashes)])
        k = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        on = self.known[k] == hashes[at]
        at, k = at[on], k[on]
        place = np.repeat(at, self.first[k + 1] - self.first[k])
        entry = spans_of_rows(self.first[k], self.first[k + 1])
        key = self.of[entry] * (len(hashes) + REACH + 24) + place
        order = np.argsort(key)
        key, place, entry = key[order], place[order], entry[order]
        of, row = self.of[entry], np.searchsorted(bounds, place, "right") - 1
        last = np.minimum(np.arange(len(of)) + self.need[of] - 1, len(of) - 1)
        enough = (last - np.arange(len(of)) == self.need[of] - 1) & (of[last] == of) & (row[last] == row) & (place[last] - place < REACH)
        i = np.flatnonzero(enough)
        if len(i):
            i = i[np.unique(np.stack([of[i], row[i], place[i] // 24]), axis=1, return_index=True)[1]]
            # A word counts no oftener than the passage has it; stretches that begin up to 24 places on are inside.
            stop = np.searchsorted(key, np.minimum(key[i] + REACH + 24, of[i] * (len(hashes) + REACH + 24) + bounds[row[i] + 1]))
            one = np.repeat(np.arange(len(i)), stop - i)
            held, seen = np.unique(one * len(self.of) + entry[spans_of_rows(i, stop)], return_counts=True)
            total = np.bincount(held // len(self.of), np.minimum(seen, self.times[held % len(self.of)]), minlength=len(i))
            i = i[total >= self.need[of[i]]]
        return row[i], of[i], place[i], place[last[i]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, same: float = 0.8, like: float = 0.55, answer_words: int = 5) -> DataFrame:
    """doc_id, item_id, overlap, cosine: each benchmark item that a document holds.

    docs(doc_id, text), benchmark(item_id, text). overlap: longest common subsequence over the
    passage's words; cosine: the highest in the latent space; both of the best passage.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    kinds = [x.schema[0].dataType.simpleString() for x in (docs, benchmark)]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, overlap double, cosine double"
    cut = stored(passages(benchmark), "passages")
    n = cut.count()
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    place, numbered = _numbered(docs, cut)
    space = _factorised(numbered, cut, _weighted(place, numbered, numbered.count()))
    dropped(numbered)
    found, chunks = [], -(-n // CHUNK)
    for k in range(chunks):
        some = cut.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == k).toArrow()
        if some.num_rows:
            chunk = Chunk(space, some.column("item_id").combine_chunks(), some.column("words").to_pylist(), min(same, like))
            shared = docs.sparkSession.sparkContext.broadcast((space, chunk))
            found.append(docs.mapInArrow(functools.partial(_search, shared, cosine, same, like, answer_words), schema))
    return functools.reduce(DataFrame.unionByName, found)


def _search(shared, cosine: float, same: float, like: float, answer_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space, chunk = shared.value
    for batch in text_slices(batches, limit=1 << 20):
        hashes, bounds = _hashed(batch.column("text"))
        row, passage, low, high = chunk.places(hashes, bounds)
        if not len(row):
            continue
        # Three windows of each scale: from the first word on, around the middle, and up to the last.
        first, last = bounds[row], bounds[row + 1]
        spans = [(x, x + s) for s in SCALES for x in (low, (low + high - s) // 2, high + 1 - s)]
        a, b = (np.clip(np.stack(x, 1), first[:, None], last[:, None]).ravel() for x in zip(*spans, strict=True))
        near = np.empty(len(a), np.float32)
        of = np.repeat(passage, len(spans))
        for k in range(0, len(a), 4096):
            part = slice(k, k + 4096)
            cut = space.project(hashes[spans_of_rows(a[part], b[part])], np.append(0, np.cumsum(b[part] - a[part])))
            near[part] = (cut * chunk.vectors[of[part]]).sum(1)
        near = near.reshape(len(row), -1).max(1)
        hits: dict[tuple[int, int], tuple[float, float, int]] = {}
        for i in np.flatnonzero(near >= cosine).tolist():
            r, j = int(row[i]), int(passage[i])
            x, y = max(int(high[i]) + 1 - REACH, int(first[i])), min(int(low[i]) + REACH, int(last[i]))
            own, text = chunk.words[chunk.bounds[j] : chunk.bounds[j + 1]].tolist(), hashes[x:y].tolist()
            overlap = _overlap(own, text, same, like, answer_words)
            if overlap > 0 and len(text) > REACH:  # within REACH words, to STEP words
                overlap = max(_overlap(own, text[k : k + REACH + STEP], same, like, answer_words) for k in range(0, len(text) - REACH, STEP))
            value = (overlap, float(near[i]), j)
            item = chunk.item[j].as_py()
            if overlap > 0 and value > hits.get((r, item), (0.0, 0.0, 0)):
                hits[r, item] = value
        if hits:
            rows, best = [r for r, _ in hits], list(hits.values())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), chunk.item.take(pa.array([v[2] for v in best])), pa.array([v[0] for v in best]), pa.array([v[1] for v in best])], ["doc_id", "item_id", "overlap", "cosine"])


def _overlap(passage: list[int], window: list[int], same: float, like: float, answer_words: int) -> float:
    """Share of the passage in the common subsequence; 0 if the passage doesn't count as held."""
    part = common_subsequence(passage, window) / len(passage)
    if part >= same:
        return part
    answer = passage[-answer_words:]
    return part if part >= like and common_subsequence(answer, window) == len(answer) else 0.0
