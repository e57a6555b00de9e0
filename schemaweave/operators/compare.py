"""Comparing, merging and viewing analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def object_key() -> Column:
    return F.concat_ws("::", "type", F.coalesce("schema", F.lit("")), "name")


def edge_key() -> Column:
    return F.concat(F.col("source"), F.lit("→"), F.col("target"), F.lit("::"), F.col("edge_type"))


def _status(old: str, new: str) -> Column:
    return F.when(F.col(old).isNull(), "added").when(F.col(new).isNull(), "removed").otherwise("unchanged").alias("status")


def object_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Objects of two versions (with n_columns): script_id, key, status, old_columns, new_columns."""
    a = old.select("script_id", object_key().alias("key"), F.col("n_columns").alias("old_columns"))
    b = new.select("script_id", object_key().alias("key"), F.col("n_columns").alias("new_columns"))
    return a.join(b, ["script_id", "key"], "full").select("script_id", "key", _status("old_columns", "new_columns"), "old_columns", "new_columns")


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of two versions: script_id, key, status."""
    a = old.select("script_id", edge_key().alias("key")).distinct().withColumn("a", F.lit(1))
    b = new.select("script_id", edge_key().alias("key")).distinct().withColumn("b", F.lit(1))
    return a.join(b, ["script_id", "key"], "full").select("script_id", "key", _status("a", "b"))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("script_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "unchanged")])


def merged(*results: tuple[DataFrame, ...]) -> tuple[DataFrame, ...]:
    """(objects, edges) or (objects, edges, cycles) of several analyses as one: first seen of (name, type), of (source, target, type) and of each cycle."""

    def first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
        every = None
        for i, f in enumerate(frames):
            f = f.withColumn("result", F.lit(i))
            every = f if every is None else every.unionByName(f, allowMissingColumns=True)
        order = Window.partitionBy(*keys).orderBy("result", "script_id")
        number = "_n"
        while number in every.columns:
            number = f"_{number}"
        return every.withColumn(number, F.row_number().over(order)).where(F.col(number) == 1).drop(number)

    keys = (["name", "type"], ["source", "target", "edge_type"], ["path"])
    return tuple(first([r[i] for r in results], keys[i]) for i in range(min(map(len, results), default=0)))


def lineage_view(objects: DataFrame, edges: DataFrame, flows: DataFrame) -> DataFrame:
    """script_id, from, to, type, details, via: edges turned to the direction of data.

    Reads and writes of routines give way to their flows; what points to nothing known is dropped.
    """
    routines = objects.where("type in ('FUNCTION', 'PROCEDURE')").select("script_id", F.col("name").alias("source"))
    kept = edges.where("edge_type not in ('READ', 'WRITE')").unionByName(edges.where("edge_type in ('READ', 'WRITE')").join(routines, ["script_id", "source"], "left_anti"))
    turned = kept.select("script_id", F.when(F.col("edge_type") == "WRITE", F.col("source")).otherwise(F.col("target")).alias("from"), F.when(F.col("edge_type") == "WRITE", F.col("target")).otherwise(F.col("source")).alias("to"), F.col("edge_type").alias("type"), "details", F.lit("").alias("via"))
    moved = flows.select("script_id", F.col("source").alias("from"), F.col("target").alias("to"), F.col("edge_type").alias("type"), "details", "via")
    links = turned.unionByName(moved).where("`from` <> `to`").groupBy("script_id", "from", "to", "type", "details").agg(F.min("via").alias("via"))
    for end in ("from", "to"):
        links = links.join(objects.select("script_id", F.col("name").alias(end)), ["script_id", end], "left_semi")
    return links.select("script_id", "from", "to", "type", "details", "via")


def _members(objects: DataFrame, links: DataFrame) -> DataFrame:
    """script_id, owner, name: what is drawn in a routine's group: its tables, and itself if it is linked or has no tables."""
    routines = objects.where("type in ('FUNCTION', 'PROCEDURE')").select("script_id", F.col("name").alias("owner")).distinct()
    tables = objects.where("parent is not null").select("script_id", F.col("parent").alias("owner"), "name").join(routines, ["script_id", "owner"], "left_semi")
    linked = links.select("script_id", F.explode(F.array("from", "to")).alias("owner")).distinct()
    bare = routines.join(tables, ["script_id", "owner"], "left_anti")
    shown = routines.join(linked, ["script_id", "owner"], "left_semi").unionByName(bare).distinct()
    return tables.unionByName(shown.withColumn("name", F.col("owner")))


def view_nodes(objects: DataFrame, links: DataFrame) -> DataFrame:
    """script_id, name, owner of what lineage_view() draws: all but routines that only move data between tables; owner: its group, or null."""
    members = _members(objects, links)
    hidden = objects.where("type in ('FUNCTION', 'PROCEDURE')").select("script_id", "name").join(members.select("script_id", "name"), ["script_id", "name"], "left_anti")
    return objects.select("script_id", "name").distinct().join(hidden, ["script_id", "name"], "left_anti").join(members, ["script_id", "name"], "left").select("script_id", "name", "owner")


def link_labels(links: DataFrame, objects: DataFrame) -> DataFrame:
    """links of lineage_view() with label: type and details, and the routine if both ends are outside its group."""
    members = _members(objects, links)
    out = links
    for end in ("from", "to"):
        out = out.join(members.select("script_id", F.col("name").alias(end), F.col("owner").alias(f"{end}_owner")), ["script_id", end], "left")
    outside = lambda end: ~F.col(f"{end}_owner").eqNullSafe(F.col("via"))
    named = F.when((F.col("via") != "") & outside("from") & outside("to"), F.concat(F.lit(" · ƒ "), "via")).otherwise("")
    return out.select(*links.columns, F.concat("type", F.when(F.col("details") != "", F.concat(F.lit(" "), "details")).otherwise(""), named).alias("label"))


def groups(objects: DataFrame) -> DataFrame:
    """script_id, owner, members: each routine with the tables it creates, sorted."""
    own = objects.where("parent is not null").select("script_id", F.col("parent").alias("owner"), "name")
    both = own.unionByName(own.select("script_id", "owner", F.col("owner").alias("name")).distinct())
    return both.groupBy("script_id", "owner").agg(F.sort_array(F.collect_set("name")).alias("members"))


def collapsed(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links between groups instead of their members: script_id, from, to."""
    owner = objects.where("parent is not null").select("script_id", "name", "parent")
    out = links.select("script_id", "from", "to")
    for end in ("from", "to"):
        out = out.join(owner.select("script_id", F.col("name").alias(end), F.col("parent").alias(f"{end}_owner")), ["script_id", end], "left").withColumn(end, F.coalesce(f"{end}_owner", end)).drop(f"{end}_owner")
    return out.where("`from` <> `to`").distinct().select("script_id", "from", "to")
