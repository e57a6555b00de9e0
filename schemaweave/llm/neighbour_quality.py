"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

The terms of a text are its words and pairs of words (lower case, hashed), and hashed 3- to
5-grams of its shape: letters become one symbol per case, runs of letters shrink to one, and
other characters stay, so these tell of layout, case, punctuation and repetition. Document
frequencies count all documents. A bounded sample of labelled documents gives the latent space
(the leading singular vectors of their TF-IDF matrix, words and shapes scaled to unit length
apart and words weighing WORDS) and the labelled vectors, which are broadcast: at most about
2 * per_label rows of RANK floats. Each document's cosine with every labelled vector is computed
exactly, in blocks, and the nearest vote for their labels, weighted by similarity and by how
many labelled documents each stands for.

Cases: a null or empty text has no terms and gets the overall rate of good labels.
Without labels every score is 0.5. Null labels and null ids are not learned from;
repeated labels of a document count once, as the greatest. Of neighbours that are equally near,
the first in order of label and vector vote. Only the named columns are read; score_rows() returns
every input column, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from schemaweave.llm.arrays import lowered, span_hashes, text_bytes, text_slices, window_hashes, window_starts, words
from schemaweave.llm.shared import bounded_sample

#: Terms of each kind: shapes, then words.
KIND = 2048
TERMS = 2 * KIND
RANK = 64
NEIGHBOURS = 24
#: Weight of the words' half of a vector against the shapes'.
WORDS = 0.6
SCORE = "quality_score"


def _shapes() -> np.ndarray:
    shape = np.arange(256, dtype=np.uint8)
    shape[ord("A") : ord("Z") + 1] = ord("A")
    shape[ord("a") : ord("z") + 1] = ord("a")
    shape[ord("0") : ord("9") + 1] = ord("0")
    shape[128:] = ord("a")  # letters with accents and other scripts
    return shape


_SHAPE = _shapes()


def _counted(counts: np.ndarray, row: np.ndarray, key: np.ndarray, first: int) -> None:
    """Adds 1 for each hash in a row, in the columns from `first` on."""
    columns = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 11)
    counts += np.bincount(row * TERMS + first + columns.astype(np.int64), minlength=len(counts)).astype(np.float32)


def term_counts(column: pa.Array) -> np.ndarray:
    """Rows by terms: how often each term occurs in each text."""
    data, offsets = text_bytes(column)
    code = _SHAPE[data].astype(np.uint64)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    stay = np.ones(len(code), bool)
    stay[1:] = (code[1:] != code[:-1]) | (code[1:] < ord("A")) | (code[1:] > ord("z")) | (row[1:] != row[:-1])
    code, row = code[stay], row[stay]
    counts = np.zeros(len(column) * TERMS, np.float32)
    for n in (3, 4, 5):
        m = len(code) - n + 1
        if m > 0:
            key = np.full(m, n, np.uint64)
            for k in range(n):
                key = (key ^ code[k : k + m]) * np.uint64(0x01000193)
            inside = row[:m] == row[n - 1 :]
            _counted(counts, row[:m][inside], key[inside], 0)
    data = lowered(data)
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    for n in (1, 2):
        first, row = window_starts(bounds, n)
        _counted(counts, row, window_hashes(hashes, n)[first], KIND)
    return counts.reshape(len(column), TERMS)


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows: shapes of unit length, and words of length WORDS."""
    x = np.log1p(counts) * idf
    for part, length in ((x[:, :KIND], 1.0), (x[:, KIND:], WORDS)):
        part *= length / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return x


def _leading(x: np.ndarray, rank: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """The leading right singular vectors, by randomised power iterations; columns without weight are 0."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    values, turned = np.linalg.eigh((x @ q).T @ (x @ q))
    return (q @ turned)[:, ::-1][:, :rank] * (values[::-1][:rank] > 1e-6)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = _scaled(counts, self.idf) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        near = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        # The similarity, in steps of 2**-20, and the place make one number, so ties have an order.
        ranked = np.rint(near * np.float32(1 << 20)).astype(np.int64) * -(1 << 20) + np.arange(near.shape[1])
        best = np.argpartition(ranked, k - 1, axis=1)[:, :k]
        likeness = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** 8
        votes = likeness * self.weights[best]
        # One vote in a hundred neighbours' worth goes to the overall rate.
        return (0.01 * self.prior + (votes * self.labels[best]).sum(1)) / (0.01 + votes.sum(1))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(TERMS, np.int64), 0
    for batch in text_slices(batches, limit=1 << 20):
        for at in range(0, batch.num_rows, 250):
            counts = term_counts(batch.column("text").slice(at, 250))
            seen += (counts > 0).sum(0)
            n += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(seen, n))], ["term", "n"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 2000) -> NeighbourModel:
    """A model of the labelled documents where `learn`, a condition on doc_id, holds.

    About per_label of the documents with each label are sampled by a hash of the id.
    """
    frequency = docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(TERMS + 1)
    seen[frequency["term"]] = frequency["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])).astype(np.float32) + np.float32(0.1)
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("label")).where(F.col("doc_id").isNotNull() & learn)
    sums = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows at most
    chosen = F.broadcast(bounded_sample(marks, "label", "doc_id", per_label).select("doc_id", "label"))  # about 2 * per_label rows
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id").select("text", "label")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            x = _scaled(term_counts(batch.column("text")), idf)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["label", "vector"])

    got = rows.mapInArrow(vectors, "label int, vector binary").toArrow().sort_by([("label", "ascending"), ("vector", "ascending")])
    total = sum(sums.values())
    prior = sums.get(1, 0) / total if total else 0.5
    if not got.num_rows:
        return NeighbourModel(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    x = np.frombuffer(b"".join(got.column("vector").to_pylist()), np.float16).reshape(got.num_rows, TERMS).astype(np.float32)
    basis = _leading(x, min(RANK, TERMS))
    marked = got.column("label").to_numpy().astype(np.float64)
    of = {k: (marked == k).sum() for k in (0, 1)}
    weights = np.array([sums.get(int(k), 0) / max(1, of[int(k)]) for k in marked])
    model = NeighbourModel(idf, basis.astype(np.float32), np.zeros((0, 1), np.float32), marked, weights / weights.max(), prior)
    v = x @ model.basis
    model.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return model


def score_rows(docs: DataFrame, model: NeighbourModel, text: str = "text", score: str = SCORE) -> DataFrame:
    """Every row and column of docs, with its score as a last column named `score`; docs must have none of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, limit=1 << 20):
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                scores = shared.value.score(term_counts(part.column(part.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores.astype(np.float64))], [*part.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(score, DoubleType()))
