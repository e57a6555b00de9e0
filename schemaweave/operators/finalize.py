"""Distinct relations, registered endpoints and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The least seq of each key: partial sums before the one shuffle, and no group in one task."""
    return df.groupBy("script_id", *keys).agg(F.min(seq).alias(seq))


def numbered(edges: DataFrame) -> DataFrame:
    """First of each (source, target, type, details) without self-edges; edge_seq, an array, ascends in order of emission."""
    kept = edges.where("source <> target and source <> '' and target <> ''")
    seq = F.concat(F.array(F.col("stmt_seq").cast("bigint"), F.col("phase").cast("bigint")), "pos")
    return _first(kept.withColumn("edge_seq", seq), ["source", "target", "edge_type", "via", "details"], "edge_seq").select("script_id", "edge_seq", "source", "target", "edge_type", "via", "details")


def distinct_flows(flows: DataFrame) -> DataFrame:
    """First of each (source, target, type, details, via); flow_seq, an array, ascends in order of emission."""
    return _first(flows, ["source", "target", "edge_type", "via", "details"], "flow_seq").select("script_id", "flow_seq", "source", "target", "edge_type", "via", "details")


def registered(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """objects with a bare TABLE for each endpoint that nothing defines, after all others, in edge order.

    obj_seq is an array: 0 and the statement, 1, the statement and its part for what bodies create, 2 and the edge for the rest.
    """
    ends = edges.select("script_id", F.posexplode(F.array("source", "target")).alias("side", "name"), "edge_seq")
    missing = ends.join(objects.select("script_id", "name"), ["script_id", "name"], "left_anti").groupBy("script_id", "name").agg(F.min(F.concat("edge_seq", F.array(F.col("side").cast("bigint")))).alias("at"))
    bare = missing.select("script_id", F.concat(F.array(F.lit(2).cast("bigint")), "at").alias("obj_seq"), "name", F.lit("TABLE").alias("type"), F.lit("").alias("schema"), F.lit(False).alias("temporary"), F.lit(None).cast("string").alias("parent"))
    return objects.select(*bare.columns).unionByName(bare)


def stats(objects: DataFrame, edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """script_id, total_objects, total_edges, has_cycles."""
    counted = objects.groupBy("script_id").agg(F.count("*").alias("total_objects"))
    counted = counted.join(edges.groupBy("script_id").agg(F.count("*").alias("total_edges")), "script_id", "left")
    marked = counted.join(cyclic.select("script_id").distinct().withColumn("has_cycles", F.lit(True)), "script_id", "left")
    return marked.select("script_id", "total_objects", F.coalesce("total_edges", F.lit(0)).alias("total_edges"), F.coalesce("has_cycles", F.lit(False)).alias("has_cycles"))
