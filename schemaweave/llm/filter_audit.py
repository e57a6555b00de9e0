"""What every order of a few filters removes: a trie of filter orders over survivor DataFrames.

All orders of n filters make a trie of prefixes. What survives a prefix depends on the set of its
filters only, so the trie is walked depth first with a memo of 2**n survivor DataFrames: a state is
made by applying one filter to a smaller state's survivors, persisted while its subtree is walked,
and counted once. The count tells for each edge out of the state (state, next filter) how many rows
of each part are removed there, and how many of these carry each mark. Counts of a state go to a
table, so neither parts nor rows pass through the driver, and lost executors lose cached blocks only,
which come again from the stored measures. Everything else is read off the edges: what a filter
removes after nothing is all that fail it, what it removes after all others fails it alone, and the
order-weighted sum of what it removes is its Shapley value times the number of orders. Counts are
made before shuffling: a part with a third of all rows sends a row per task.

Cases: a null text is empty: no words, no characters. A null part is the empty string. Null and
empty texts are equal to each other. A row with a null id has no smaller id and is none. Rows with
one id count one by one, and none of them precedes the other. Marks of an id are the greatest of its
labels; labels with a null id mark nothing. An empty table has no parts, so no rows. Other columns
are neither read nor returned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.arrays import row_sums, span_hashes, text_bytes, text_slices, words
from schemaweave.llm.shared import dropped, stored, with_group

#: Letter and failure condition of each filter, over the columns of measure().
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "n_marks > 0",
    "E": "copy",
}
MARKS = ("good", "toxic")
_CAPITALS = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_SIGNS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_MEASURES = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_marks")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        starts, ends, bounds = words(data, offsets)
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        hashes = span_hashes(data, starts, ends)
        order = np.lexsort((hashes, row))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
        columns = [np.diff(bounds), np.bincount(row[order[new]], minlength=batch.num_rows), row_sums(_CAPITALS[data], offsets), row_sums((data & 0xC0) != 0x80, offsets), row_sums(_SIGNS[data], offsets)]
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "part", "same"]).columns, *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", "part", "same", *_MEASURES])


def measure(docs: DataFrame, part: Column, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, the measures of each whole text, copy (its text also has a smaller id), and the marks of labels(doc_id, good, toxic).

    Texts are equal if their SHA-256 is. A text that occurs once needs no join; one that many documents share is looked up.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("same", F.unhex(F.sha2("text", 256)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = stored(rows.mapInArrow(_measured, f"doc_id {kind}, part string, same binary, " + ", ".join(f"{m} bigint" for m in _MEASURES)), "measures")
    texts = measured.where(F.col("doc_id").isNotNull()).groupBy("same").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    found = with_group(measured, "same", stored(texts.where("n > 1"), "texts"), "n")
    marks = labels.groupBy(F.col("doc_id").alias("marked")).agg(*[F.max(m).alias(m) for m in MARKS]).where(F.col("marked").isNotNull())
    found = found.join(marks, F.col("doc_id") == F.col("marked"), "left")
    return found.select("part", *_MEASURES, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"), *[F.coalesce(m, F.lit(False)).alias(m) for m in MARKS])


def edges(rows: DataFrame, filters: dict[str, str], part: str = "part", marks: tuple[str, ...] = MARKS) -> DataFrame:
    """part, state (bits of the filters applied before), filter (its place), alive (rows before), removed, and removed rows by mark."""
    letters, spark, tables, memo = list(filters), rows.sparkSession, [], {}
    bits = {x: 1 << i for i, x in enumerate(letters)}

    def walk(state: int) -> None:
        alive = memo[state]
        open_ = [x for x in letters if not state & bits[x]]
        if open_:
            fails = {x: F.coalesce(F.expr(filters[x]), F.lit(False)) for x in open_}
            counts = [F.count_if(fails[x] & m if m is not None else fails[x]).alias(f"{x}_{i}") for x in open_ for i, m in enumerate([None, *map(F.col, marks)])]
            one = lambda x: F.struct(F.lit(letters.index(x)).alias("filter"), F.col(f"{x}_0").alias("removed"), *[F.col(f"{x}_{i}").alias(m) for i, m in enumerate(marks, 1)])
            tables.append(stored(alive.groupBy(part).agg(F.count("*").alias("alive"), *counts).select(part, F.lit(state).alias("state"), "alive", F.inline(F.array(*map(one, open_)))), "edges"))
        for x in open_:
            if state | bits[x] not in memo:
                memo[state | bits[x]] = alive.where(~fails[x]).persist(StorageLevel.MEMORY_AND_DISK)
                walk(state | bits[x])
        alive.unpersist()

    memo[0] = rows.persist(StorageLevel.MEMORY_AND_DISK)
    walk(0)
    whole = stored(spark.read.schema(tables[0].schema).parquet(*[t._stored_at for t in tables]), "edges")
    for t in tables:
        dropped(t)
    return whole


def audit(rows: DataFrame, filters: dict[str, str], part: str = "part", marks: tuple[str, ...] = MARKS) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, <mark>_lost, shapley."""
    letters = list(filters)
    n = len(letters)
    found = edges(rows, filters, part, marks)
    applied = F.bit_count("state").cast("int")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), applied + 1)
    entry = F.struct((F.col("state") * n + F.col("filter")).alias("edge"), F.struct("alive", "removed", *marks).alias("of"))
    by_part = found.groupBy(part).agg(
        F.map_from_entries(F.collect_list(entry)).alias("edges"),  # n * 2 ** (n - 1) of them for a part
        F.map_from_entries(F.collect_list(F.when(F.col("state") == 0, F.struct("filter", "removed")))).alias("failing"),
        F.map_from_entries(F.collect_list(F.when(applied == n - 1, F.struct("filter", "removed")))).alias("alone"),
        *[F.sum(F.when(F.col("filter") == i, weight * F.col("removed"))).alias(f"shapley_{i}") for i in range(n)],
    )
    steps = [("".join(order), at + 1, sum(1 << letters.index(x) for x in order[:at]), letters.index(x)) for order in itertools.permutations(letters) for at, x in enumerate(order)]
    orders = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")  # n * n! rows
    # Each part meets each step: that is the result itself, made by exploding the steps' places and looking them up.
    place = orders.select("filter_order", "step", (F.col("state") * n + F.col("filter")).alias("edge"), "filter", F.col("step").alias("s"))
    known = by_part.select(part, "edges", "failing", "alone", F.array(*[f"shapley_{i}" for i in range(n)]).alias("shapley"), F.explode(F.sequence(F.lit(0), F.lit(n * 2**n - 1))).alias("edge"))
    full = known.join(F.broadcast(place), "edge")
    of = F.element_at("edges", F.col("edge"))
    count = lambda c: F.coalesce(of[c], F.lit(0).cast("bigint"))
    of_filter = lambda m: F.coalesce(F.element_at(m, F.col("filter")), F.lit(0).cast("bigint"))
    return full.select(
        part, "filter_order", "step",
        (count("alive") - count("removed")).alias("kept"),
        count("removed").alias("removed"),
        (of_filter("failing") - count("removed")).alias("redundant"),
        of_filter("alone").alias("unique_fails"),
        *[count(m).alias(f"{m}_lost") for m in marks],
        F.coalesce(F.element_at("shapley", F.col("filter") + 1), F.lit(0)).cast("bigint").alias("shapley"),
    )
