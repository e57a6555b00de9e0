"""Scripts and saves that arrive as streams: analysed batch by batch, and freed of repeated analyses by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from schemaweave.operators import statements
from schemaweave.plans.analysis import Analysis, analyze
from schemaweave.functions.storage import stored
from schemaweave.sources.versioned import VersionedTable

_SAVE = "project string, seq bigint, action string, ddl string"


def stream_scripts(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """script_id and ddl of each new file."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.col("_metadata.file_path").alias("script_id"), F.col("value").alias("ddl"))


def write_edges(scripts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's edges to a table of batches; a batch that is run again replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        analyze(batch).edges.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scripts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Unrepeated(StatefulProcessor):
    """Keeps a project's saves but for analyses whose ddl equals that of its analysis before; the state is that ddl."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "seen boolean, ddl string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """One project's rows of a batch, in order of seq."""
        given = pd.concat(rows).sort_values("seq", kind="stable")
        seen, ddl = tuple(self.before.get()) if self.before.exists() else (False, None)
        kept = []
        for action, text in zip(given["action"], given["ddl"].where(given["ddl"].notna(), None), strict=True):
            same = action == "analysis" and seen and text == ddl
            kept.append(not same)
            if action == "analysis":
                seen, ddl = True, text
        self.before.update((seen, ddl))
        yield given[kept]

    def close(self) -> None:
        pass


def history_stream(saves: DataFrame) -> DataFrame:
    """history() of a stream of saves(project, seq, action, ddl) whose seq doesn't fall from batch to batch within a project."""
    saves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = saves.select("project", F.col("seq").cast("bigint").alias("seq"), "action", "ddl")
    return rows.groupBy("project").transformWithStateInPandas(Unrepeated(), outputStructType=_SAVE, outputMode="Append", timeMode="None")


def refreshed(scripts: DataFrame, root: str) -> tuple[Analysis, int]:
    """The analysis of scripts(script_id, ddl), and how many of them had to be parsed.

    Statements of each script are kept in a versioned table with a digest of its text; only scripts whose
    digest is new are parsed, and their statements, and those of scripts that are gone, replaced.
    """
    kinds = "script_id string, digest string, stmt_seq int, stmt string, kind string, schema string, name string, temporary boolean"
    table = VersionedTable(scripts.sparkSession, root, kinds, "script_id")
    now = scripts.select("script_id", "ddl", F.sha2(F.coalesce("ddl", F.lit("")), 256).alias("digest"))
    known = table.read().select("script_id", "digest").distinct()
    changed = stored(now.join(known, ["script_id", "digest"], "left_anti"))
    gone = known.select("script_id").join(now.select("script_id"), "script_id", "left_anti")
    count = changed.count()
    if count or gone.take(1):
        parsed = changed.select("script_id", "digest").join(statements.statements(changed.select("script_id", "ddl")), "script_id", "left")  # a script without statements is known by a row without one
        table.replace(stored(changed.select("script_id").unionByName(gone)), parsed)
    return Parsed(scripts, table.read().where("stmt is not null").drop("digest")), count


class Parsed(Analysis):
    """An analysis of statements that are at hand."""

    def __init__(self, scripts: DataFrame, known: DataFrame) -> None:
        super().__init__(scripts)
        self.__dict__["statements"] = stored(known, by="kind")
