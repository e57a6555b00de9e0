"""Quality rules whose cutoffs are chosen by a risk-controlled test on labelled holdouts.

Every document gets integer measures of its whole text. For each stratum and rule,
candidate cutoffs are tested on the labelled good documents: a cutoff is certified if
the exact binomial tail P(Bin(n, risk) <= k) is at most the test level, where n good
documents were seen and k of them would be rejected. That is the same as an upper
Clopper-Pearson bound of at most `risk`. The risk of a stratum is shared by its rules,
and the level is divided by the number of all tests (Bonferroni), so with probability
1 - delta no stratum rejects more than `risk` of its good documents. The lowest
certified cutoff is used; without one the rule rejects nothing there.

Cases: a null or empty text has no words and fails the base rules. A null stratum
counts as the empty one. Null labels do not count; repeated labels of a document count once,
as good if any is. Repeated documents are measured alike. Without labels nothing but
the base rules rejects. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.arrays import row_sums, span_hashes, text_bytes, text_slices, window_hashes, window_starts, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule: its value, an integer per text, and the cutoffs above which it may reject.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "symbols": ("1000 * n_symbols div nullif(n_words, 0)", (5, 10, 20, 50, 100, 200, 300, 500, 1000, 2000)),
    "dup_lines": ("1000 * n_dup_lines div nullif(n_words, 0)", (2, 5, 10, 20, 40, 80, 160, 320)),
    "word_length": ("100 * word_chars div nullif(n_words, 0)", (600, 700, 800, 900, 1000, 1200, 1500, 2000)),
    "repeats": ("1000 * n_repeat_words div nullif(n_words, 0)", (10, 25, 50, 75, 100, 125, 150, 175)),
}
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        starts, ends, bounds = words(data, offsets)
        n = np.diff(bounds)
        inside = row_sums(_marks(len(data), starts, ends) & ((data & 0xC0) != 0x80), offsets)
        first, row = window_starts(bounds, 5)
        windows = window_hashes(span_hashes(data, starts, ends), 5)[first] ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(windows)
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = _marks(len(starts), first[twice], first[twice] + 5)
        whole, dups = data.tobytes(), np.zeros(len(n), np.int64)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            lines = whole[a:b].split(b"\n")
            if len(lines) > 1:
                seen: set[bytes] = set()
                for line in lines:
                    if line not in seen:
                        seen.add(line)
                    elif line.split(None, 1):
                        dups[i] += 1
        columns = [n, inside, row_sums(_SYMBOLS[data], offsets), dups, row_sums(covered, bounds)]
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "stratum"]).columns, *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", "stratum", *MEASURES])


def _marks(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at each place that lies in one of the spans."""
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def measure(docs: DataFrame, stratum: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, stratum and the measures of each whole text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_measure, f"doc_id {kind}, stratum string, " + ", ".join(f"{m} bigint" for m in MEASURES))


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def _log_factorial_rest(n: float) -> float:
    """log(n!) less Stirling's formula n log(n) - n + log(2 pi n) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - 1 / 1260 / n**2) / n**2) / n


def _deviance(x: float, m: float) -> float:
    """x log(x / m) + m - x, without cancellation where x is near m."""
    d = (x - m) / (x + m)
    if abs(d) > 0.1:
        return x * math.log(x / m) + m - x
    total, term, j = (x - m) * d, 2 * x * d, 1
    while True:
        term *= d * d
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k) for any n: the probability of k itself, times the sum of its ratios to those below.

    The first is exact to about 1e-13 whatever n (deviances instead of differences of large logarithms);
    ratios are summed until they don't count, some times the square root of n of them.
    """
    if k >= n:
        return 1.0
    if k <= 0:
        return math.exp(n * math.log1p(-p)) if k == 0 else 0.0
    rest = _log_factorial_rest(n) - _log_factorial_rest(k) - _log_factorial_rest(n - k)
    log_of_k = rest - _deviance(k, n * p) - _deviance(n - k, n * (1 - p)) + 0.5 * math.log(n / (2 * math.pi * k * (n - k)))
    total, last, at = 1.0, 1.0, k
    while at > 0 and last > 1e-18 * total:
        i = np.arange(at, max(at - 4096, 0), -1, dtype=np.float64)
        with np.errstate(over="ignore"):
            ratios = last * np.cumprod(i * (1 - p) / ((n - i + 1) * p))
        if not np.isfinite(ratios[-1]):  # far above the mean
            return 1.0
        total, last, at = total + float(ratios.sum()), float(ratios[-1]), at - len(i)
    return min(1.0, math.exp(log_of_k + math.log(total)))


def certify(measures: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row per stratum, rule and candidate cutoff: n good, k rejected, tail, certified.

    labels(doc_id, good boolean). Counts are made where the rows are and only sums are shuffled.
    """
    good = labels.where(F.col("good").isNotNull()).groupBy("doc_id").agg(F.max("good").alias("good")).where("good").select("doc_id")
    seen = measures.where(~base_failed()).join(good, "doc_id", "left_semi")
    tests = [(rule, cut) for rule, (_, cuts) in RULES.items() for cut in cuts]
    sums = [F.count_if(F.expr(RULES[r][0]) > c).alias(f"{r}_{c}") for r, c in tests]
    counts = seen.groupBy("stratum").agg(F.count("*").alias("n"), *sums)
    long = counts.select("stratum", "n", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).cast("bigint").alias("cutoff"), F.col(f"{r}_{c}").alias("k")) for r, c in tests])))
    share = risk / len(RULES)

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(x), int(y), share) if x < share * y else 1.0 for x, y in zip(k, n, strict=True)], dtype=float)

    # Under k >= share * n the tail is about a half or more, far above any level; only smaller k need the sum.
    level = delta / (counts.agg(F.count("*")).scalar() * len(tests))
    return long.withColumn("tail", tail("k", "n")).withColumn("certified", F.col("tail") <= level)


def apply_rules(measures: DataFrame, certified: DataFrame) -> DataFrame:
    """The measures with base_failed and kept."""
    cuts = certified.where("certified").groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in RULES])
    rejected = F.lit(False)
    for rule, (value, _) in RULES.items():
        rejected |= F.coalesce(F.expr(value) > F.col(f"__{rule}"), F.lit(False))
    failed = measures.withColumn("base_failed", base_failed())
    return failed.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*[f"__{r}" for r in RULES])
