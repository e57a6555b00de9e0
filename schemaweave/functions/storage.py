"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions, by application; a running session takes no new spark.checkpoint.dir.
_own: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[None]:
    """What is stored within goes when it ends, so results have to be used within; without a scope, tables stay until the folder is cleared."""
    mine: list[DataFrame] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for df in mine:
            dropped(df)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may do without, and then gets a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir isn't set; executors need a folder that they share")
        app = spark.sparkContext.applicationId
        place = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-")
    return place.rstrip("/")


def mounted_dir(spark: SparkSession) -> str:
    """shared_dir() as a path for programs that know files only; an error if it isn't mounted on the machines."""
    place = shared_dir(spark).removeprefix("file:")
    if "://" in place or not place.startswith("/"):
        raise ValueError(f"{place} isn't a mounted folder")
    return "/" + place.lstrip("/")


def tasks(spark: SparkSession) -> int:
    """So many tasks for work that takes time, whatever its size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """`df` written to the shared folder, in a folder for each value of `by`, and read back."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    for s in _scopes:
        s.append(back)
    return back


def dropped(df: DataFrame | None) -> None:
    """Delete what stored() has written for `df`, which must not be read any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
