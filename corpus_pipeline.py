"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns what it
keeps of docs, with the same columns, but for the last, which returns the pieces' digests.
The key is doc_id; a null id is kept as it is, and rows that share an id stay or go
together. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm import decontamination, near_duplicates, neighbour_quality, piece_sampling, suffix_dedup
from schemaweave.llm.queries import tokenizer
from schemaweave.llm.shared import every, free_name, lacking, shared_path, tune

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
#: Five-word shingles with this Jaccard similarity, in percent, make near-duplicates.
SIMILAR_PERCENT = 80
REPEATED_BYTES = 200
#: Fewer lattices than a single query keeps: the stages before have filled the executors.
CACHED_UNITS = 40_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote doesn't reject."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = neighbour_quality.fit(docs, labels, F.lit(True))
    score = free_name(neighbour_quality.SCORE, docs)
    return neighbour_quality.score_rows(docs, model, score=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    tune(spark)
    groups = near_duplicates.near_duplicates(docs, percent=SIMILAR_PERCENT)
    return lacking(docs, "doc_id", groups.where("not kept"), "doc_id")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated strings cover; n_chars follows."""
    tune(spark)
    out = suffix_dedup.remove_from_texts(docs, window=REPEATED_BYTES)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*every(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = tune(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return lacking(docs, "doc_id", decontamination.find_leaks(docs, benchmark), "doc_id")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each text, decoded again: doc_id, n_pieces, pieces_crc32, decoded_sha256, lossless."""
    tune(spark)
    return piece_sampling.sample_pieces(docs, tokenizer("piece_bpe_32k.model"), digests=True, cached_units=CACHED_UNITS)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece sampling", pieces),
]

#: SQL can express neither the classifier nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
