"""Reading scripts and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_scripts(spark: SparkSession, path: str, glob: str = "*.{sql,txt}") -> DataFrame:
    """script_id (path) and ddl of each file."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("ddl"))


def read_checked(spark: SparkSession, path: str, endings: tuple[str, ...] = (".sql", ".txt"), most_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Scripts of the files that may be read, and rejects(script_id, size, reason) for the others.

    Files with another ending, or over most_bytes, aren't opened: the file list alone tells. What isn't UTF-8 is
    rejected whole. A byte order mark is left out. Files without a byte give no row, as in all of Spark's file sources.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ended = F.lower(F.col("path")).rlike("(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
    small = F.col("length") <= most_bytes
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = files.where(ended & small).select(F.col("path").alias("script_id"), F.col("length").alias("size"), F.regexp_replace(text, "^\ufeff", "").alias("ddl"))
    named = files.where(~ended | ~small).select(F.col("path").alias("script_id"), F.col("length").alias("size"), F.when(~ended, "ending").otherwise("size").alias("reason"))
    broken = read.where("ddl is null").select("script_id", "size", F.lit("not UTF-8").alias("reason"))
    return read.where("ddl is not null").select("script_id", "ddl"), named.unionByName(broken)


def from_text(spark: SparkSession, ddl: str, script_id: str = "script") -> DataFrame:
    return spark.createDataFrame([(script_id, ddl)], "script_id string, ddl string")


def from_table(df: DataFrame, script_id: str, ddl: str) -> DataFrame:
    return df.select(F.col(script_id).cast("string").alias("script_id"), F.col(ddl).alias("ddl"))


def write_text(rendered: DataFrame, column: str, path: str) -> None:
    """One text per script, as Spark text files partitioned by nothing but size."""
    rendered.select(column).write.text(path, lineSep="\n")


def write_lines(lines: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Lines of a rendering as text files, in a folder for each script, and script_id, file of all of them in order.

    Lines are dealt out by ranges of (script, key) and sorted in their ranges; the files of a script, in
    order of their names, make its text. files: how many ranges; without it, what fits the size. The list is written last, as `manifest`: without it a write isn't complete.
    """
    dealt = lines.repartitionByRange(*([files] if files else []), "script_id", "key", "line").sortWithinPartitions("script_id", "key", "line")
    dealt.select("script_id", "line").write.partitionBy("script_id").text(f"{path}/lines")
    found = lines.sparkSession.read.text(f"{path}/lines").groupBy(F.col("script_id").cast("string").alias("script_id"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    order = ["script_id", F.length("file"), "file"]  # of two part numbers the longer is the larger
    found.orderBy(*order).write.json(f"{path}/manifest")
    return lines.sparkSession.read.schema("script_id string, file string, n bigint").json(f"{path}/manifest").orderBy(*order)


def write_json(results: DataFrame, path: str) -> None:
    results.write.json(path)
