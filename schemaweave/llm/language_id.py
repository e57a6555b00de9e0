"""Language identification by error-correcting output codes.

Each language gets a codeword; each bit has a binary classifier over hashed byte n-grams,
whose weight for an n-gram is the log of how much oftener it occurs in the languages
with that bit set. Decoding takes the language whose codeword has the least loss,
weighted by how reliable each bit was on the training sample, and flags a text as
ambiguous if the second best is close.

Training reads at most about `per_language` documents of each language, chosen by a
hash of the id; every document is predicted from its whole text. Counts stay distributed: the
driver gets a name and a number per language, and BUCKETS sums per bit, of which there are some
10 for each doubling of the languages. The bits' reliability is measured on a tenth of that sample.

Cases: a null text, or one without a letter, is `und` with score 0. Rows without
language, or without id, are not learned from. Without any training row every text is
`und`. Repeated rows are predicted alike. Only the named columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.arrays import lowered, text_bytes, text_slices
from schemaweave.llm.shared import bounded_sample, stored

BUCKETS = 1 << 15
_LETTER = regex.compile(r"\p{L}")
_STEP = 1 << 19


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all 2- to 4-byte grams, in pieces, with the row of each."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = lowered(data).astype(np.uint32)
    for at in range(0, len(code), _STEP):
        part, rows = code[at : at + _STEP + 3], row[at : at + _STEP + 3]
        for n in (2, 3, 4):
            m = min(_STEP, len(part) - n + 1)
            if m <= 0:
                continue
            key = np.full(m, n, np.uint32)
            for k in range(n):
                key = key * np.uint32(0x01000193) ^ part[k : k + m]
            key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
            inside = rows[:m] == rows[n - 1 : n - 1 + m]
            yield key[inside], rows[:m][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts of each language in this partition."""
    counts: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for name, sums in counts.items():
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full)), pa.array(full), pa.array(sums[full])], ["lang", "bucket", "n"])
        counts.clear()

    for batch in text_slices(batches, limit=1 << 20):
        if len(counts) > 100:  # 256 kB each
            yield from rows()
        names = batch.column("lang").to_pylist()
        for at in range(0, len(names), 200):  # so a piece has 200 languages at most
            part = names[at : at + 200]
            index = {name: i for i, name in enumerate(dict.fromkeys(part))}
            of = np.array([index[x] for x in part], np.int64)
            sums = np.zeros((len(index), BUCKETS), np.int64)
            for key, row in _grams(*text_bytes(batch.column("text").slice(at, 200))):
                sums += np.bincount(of[row] * BUCKETS + key, minlength=sums.size).reshape(sums.shape)
            for name, i in index.items():
                counts[name] = counts.get(name, 0) + sums[i]
    yield from rows()


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """One row of -1 and 1 per language: all splits for up to six, else the best of random codes (over 1000 languages: the first)."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        return np.array([(1, *bits) for bits in itertools.product((1, -1), repeat=languages - 1)][1:], float).T
    rng, best, least = np.random.default_rng(seed), None, -1
    width = int(np.ceil(10 * np.log2(languages)))
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (languages, width))
        code[0, np.abs(code.sum(0)) == languages] *= -1
        if languages > 1000:  # their distances are too many to compare, and random ones are near the best
            return code
        apart = (width - (code @ code.T)[np.triu_indices(languages, 1)].max()) / 2
        if apart > least:
            best, least = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray


def _margins(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """Per text and bit, the summed weights over the root of the number of grams."""
    data, offsets = text_bytes(column)
    sums, n = np.zeros((len(column), weights.shape[1])), np.zeros(len(column))
    for key, row in _grams(data, offsets):
        if len(key):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            sums[row[first]] += np.add.reduceat(weights[key], first, axis=0)
            n[row[first]] += np.diff(first, append=len(row))
    return sums / np.sqrt(np.maximum(n, 1))[:, None]


def _losses(model: LanguageModel, margins: np.ndarray) -> np.ndarray:
    """Weighted logistic loss of each text against each codeword."""
    margins = np.clip(margins, -30, 30)
    on, off = np.logaddexp(0, -margins) * model.trust, np.logaddexp(0, margins) * model.trust
    return (on @ (model.code > 0).T + off @ (model.code < 0).T) / model.trust.sum()


def _bit_sums(code: np.ndarray, totals: np.ndarray, unit: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, and for each bit the sums of its grams' shares in the languages that have it on and off, in whole units."""
    sums: dict[int, np.ndarray] = {}
    on, off = code > 0, code < 0
    for batch in batches:
        bucket, of, n = (batch.column(c).to_numpy() for c in ("bucket", "of", "n"))
        share = np.rint(n / (totals[of] + 0.5 * BUCKETS) * unit).astype(np.int64)
        for b, k, x in zip(bucket.tolist(), of.tolist(), share.tolist(), strict=True):
            own = sums.setdefault(b, np.zeros((2, code.shape[1]), np.int64))
            own[0, on[k]] += x
            own[1, off[k]] += x
    for b, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([own.tobytes()], pa.binary())], ["bucket", "sums"])


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 10_000) -> LanguageModel:
    """A model from the documents where `learn` holds; at most about `per_language` of each language."""
    rows = docs.where(learn).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and doc_id is not null")
    sample = bounded_sample(rows, "lang", "doc_id", per_language).select("lang", "text")
    counts = stored(sample.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    found = counts.groupBy("lang").agg(F.sum("n").alias("n")).toArrow().sort_by("lang")  # a row per language
    languages, totals = found.column("lang").to_pylist(), found.column("n").to_numpy()
    code = codewords(len(languages))
    numbered = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(languages, pa.string()), "of": pa.array(range(len(languages)), pa.int64())}))
    # Shares are summed in whole units, so the sums don't depend on their order; each language counts the same.
    unit = float(1 << (61 - len(languages).bit_length()))
    summed = counts.join(numbered, "lang").select("bucket", "of", "n").repartition("bucket").mapInArrow(partial(_bit_sums, code, totals, unit), "bucket bigint, sums binary").toArrow()
    least = 0.5 / (totals + 0.5 * BUCKETS)  # the share of a gram that a language doesn't have
    sums = np.repeat(np.stack([least @ (code > 0), least @ (code < 0)])[None], BUCKETS, axis=0)
    if summed.num_rows:
        sums[summed.column("bucket").to_numpy()] += np.frombuffer(b"".join(summed.column("sums").to_pylist()), np.int64).reshape(-1, *sums.shape[1:]) / unit
    of = np.stack([(code > 0).sum(0), (code < 0).sum(0)])
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    split = (of > 0).all(0)
    weights[:, split] = np.log(sums[:, 0, split] / of[0, split]) - np.log(sums[:, 1, split] / of[1, split])
    model = LanguageModel(languages, code, weights, np.ones(code.shape[1]))
    if len(languages) < 2:
        return model

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits = 0, np.zeros(code.shape[1], np.int64)
        for batch in text_slices(batches, limit=1 << 20):
            truth = code[np.searchsorted(languages, batch.column("lang").to_pylist())]
            hits += ((_margins(weights, batch.column("text")) > 0) == (truth > 0)).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hits))), pa.array(hits), pa.array([n] * len(hits))], ["bit", "hits", "n"])

    # The bits are judged on a tenth of the bounded sample.
    part = bounded_sample(rows, "lang", "doc_id", max(1, per_language // 10)).select("lang", "text")
    rates = part.mapInArrow(right, "bit bigint, hits bigint, n bigint").groupBy("bit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toPandas()
    if len(rates):
        sure = np.full(code.shape[1], 0.5)
        sure[rates["bit"]] = (rates["hits"] + 1) / (rates["n"] + 2)
        model.trust = np.maximum(np.log(sure / (1 - sure)), 0.01)
    return model


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", closeness: float = 0.05) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of `docs`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_slices(batches, limit=1 << 20):
            texts = batch.column("text").to_pylist()
            known = np.array([bool(m.languages) and x is not None and _LETTER.search(x) is not None for x in texts])
            best, score, close = np.zeros(len(texts), int), np.zeros(len(texts)), known.copy()
            step = max(1, (1 << 20) // max(1, len(m.languages)))  # texts whose losses against all languages are held at once
            for at in range(0, len(texts) if m.languages else 0, step):
                part = slice(at, at + step)
                loss = _losses(m, _margins(m.weights, batch.column("text").slice(at, step)))
                least = loss.min(1, keepdims=True)
                best[part], score[part] = loss.argmin(1), 1 / np.exp(np.maximum(least - loss, -700) * 4).sum(1)
                close[part] &= (np.partition(loss, 1, 1)[:, 1] - least[:, 0] < closeness) if loss.shape[1] > 1 else False
            names = [m.languages[i] if k else "und" for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
