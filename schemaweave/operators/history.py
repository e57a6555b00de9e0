"""Projects: saved states and their history as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schemaweave.sources.versioned import VersionedTable


def project_name(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "project").otherwise(clean)


def history(saves: DataFrame) -> DataFrame:
    """saves(project, seq, action, ddl, ...) without analyses whose ddl equals the project's analysis before."""
    mark = "_before"
    while mark in saves.columns:
        mark = f"_{mark}"
    w = Window.partitionBy("project").orderBy("seq")
    before = F.last(F.when(F.col("action") == "analysis", F.struct(F.col("ddl").alias("d"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = saves.withColumn(mark, before)
    return marked.where(~((F.col("action") == "analysis") & F.col(mark).isNotNull() & F.col("ddl").eqNullSafe(F.col(mark)["d"]))).drop(mark)


def current_state(saves: DataFrame) -> DataFrame:
    """The last save of each project."""
    return saves.groupBy("project").agg(F.max("seq").alias("seq"), F.max_by("action", "seq").alias("action"), F.max_by("ddl", "seq").alias("ddl"), F.count("*").alias("n_saves"))


def project_list(saves: DataFrame) -> DataFrame:
    """Projects by their last save, newest first."""
    return current_state(saves).select("project", F.col("seq").alias("updated"), "n_saves").orderBy(F.desc("updated"), "project")


def versions(kept: DataFrame) -> DataFrame:
    """Analyses of history() with their version label, the newest last."""
    return kept.where("action = 'analysis'").withColumn("version", F.row_number().over(Window.partitionBy("project").orderBy("seq")).cast("bigint"))


def without_project(saves: DataFrame, project: str) -> DataFrame:
    return saves.where(F.col("project") != project)


def history_list(kept: DataFrame) -> DataFrame:
    """Entries of history(), newest first, with the statistics in their states, a VARIANT; null where a state has none."""
    of = lambda name, kind: F.try_variant_get("state", f"$.stats.{name}", kind).alias(name)
    return kept.select("project", "seq", "action", of("total_objects", "bigint"), of("total_edges", "bigint"), of("has_cycles", "boolean")).orderBy("project", F.desc("seq"))


def history_entry(kept: DataFrame, project: str, seq: int) -> DataFrame:
    return kept.where((F.col("project") == project) & (F.col("seq") == seq))


class Projects:
    """Projects kept in versioned tables: what they are called, and each save with its state.

    saves(project, seq, action, ddl, state VARIANT); projects as in ensured().
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.saves = VersionedTable(spark, f"{root}/saves", "project string, seq bigint, action string, ddl string, state variant", "project")
        self.projects = VersionedTable(spark, f"{root}/projects", "project string, display_name string, description string, created_at timestamp, updated_at timestamp", "project")

    def ensure(self, requests: DataFrame) -> int:
        """Upserts the projects that requests(name, seq, at, metadata) ask for; only their buckets are written."""
        asked = requests.select(project_name(F.col("name")).alias("project")).distinct()
        known = self.projects.read().join(asked, "project", "left_semi")
        return self.projects.replace(asked, ensured(known, requests))

    def save(self, states: DataFrame) -> int:
        """Appends states(project, seq, action, ddl, state) with their JSON as VARIANT; an analysis that repeats the one before is dropped."""
        given = states.select(project_name(F.col("project")).alias("project"), "seq", "action", "ddl", F.try_parse_json("state").alias("state"), F.lit(True).alias("new"))
        touched = given.select("project").distinct()
        last = self.saves.read().where("action = 'analysis'").join(touched, "project", "left_semi").groupBy("project").agg(F.max("seq").alias("seq"), F.max_by("ddl", "seq").alias("ddl"))
        before = last.select("project", "seq", F.lit("analysis").alias("action"), "ddl", F.lit(None).cast("variant").alias("state"), F.lit(False).alias("new"))
        return self.saves.append(history(before.unionByName(given)).where("new"))

    def load(self, project: str) -> DataFrame:
        """The state saved last."""
        return self.saves.of(project).orderBy(F.desc("seq")).limit(1)

    def history(self, project: str) -> DataFrame:
        return history_list(self.saves.of(project))

    def entry(self, project: str, seq: int) -> DataFrame:
        return history_entry(self.saves.of(project), project, seq)

    def delete(self, projects: DataFrame) -> None:
        """projects(project) and all their saves go; other buckets aren't touched."""
        self.saves.replace(projects)
        self.projects.replace(projects)


def ensured(projects: DataFrame, requests: DataFrame) -> DataFrame:
    """projects(project, display_name, description, created_at, updated_at) after requests to have projects.

    requests(name, seq, at, metadata struct<name, description, created_at>): a new project gets its
    metadata, or its clean name and `at`; an old one changes only where metadata is given: its
    names, and updated_at. Of several requests for a project the last one with metadata counts.
    """
    meta = F.col("r.metadata")
    asked = requests.withColumn("project", project_name(F.col("name"))).groupBy("project").agg(F.max_by(F.struct("at", "metadata"), F.struct(F.col("metadata").isNotNull(), "seq")).alias("r"))
    both = projects.withColumn("old", F.lit(True)).join(asked, "project", "full")
    old, given = F.col("old").isNotNull(), meta.isNotNull()
    created = F.coalesce(meta["created_at"], F.col("r.at"))
    named = {"display_name": F.coalesce(meta["name"], F.col("project")), "description": F.coalesce(meta["description"], F.lit(""))}
    new = {c: F.when(old & ~given, F.col(c)).otherwise(v) for c, v in named.items()}
    times = {"created_at": F.when(old, F.col("created_at")).otherwise(created), "updated_at": F.when(old & ~given, F.col("updated_at")).otherwise(created)}
    return both.withColumns(new | times).select("project", *new, *times)


def project_exists(projects: DataFrame, name: str) -> DataFrame:
    """One row: whether there is a project with the clean form of this name."""
    return projects.agg(F.coalesce(F.bool_or(F.col("project") == project_name(F.lit(name))), F.lit(False)).alias("exists"))
