"""Views and routines: reads, writes, column mappings and statement-level flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.functions import scanners, text
from schemaweave.operators.tables import edge

#: The kinds of writes, in order of precedence.
WRITES = ("CREATE", "INSERT", "INSERT_VALUES", "UPDATE", "DELETE", "MERGE", "TRUNCATE")


def bodies(statements: DataFrame) -> DataFrame:
    """Views and routines as script_id, stmt_seq, name, kind, body and parts.

    parts: the statements of the body (a view's query is one) with part_seq, reads, writes, created
    and mapping; reads without the object itself and the body's common table expressions.
    """
    some = statements.where("kind in ('VIEW', 'MATERIALIZED_VIEW', 'FUNCTION', 'PROCEDURE')")
    read = some.withColumn("b", scanners.body_parts(F.col("stmt"), F.col("kind")))
    known = lambda t: (t != F.col("name")) & ~F.array_contains(F.col("b.ctes"), t)
    written = lambda w: ~F.array_contains(F.col("b.ctes"), w["t"])
    parts = F.transform("b.parts", lambda p: p.withField("reads", F.filter(p["reads"], known)).withField("writes", F.filter(p["writes"], written)))
    return read.select("script_id", "stmt_seq", "name", "kind", F.col("b.body").alias("body"), parts.alias("parts"))


def _first(full: DataFrame, values: Column) -> DataFrame:
    """script_id, stmt_seq, name, pos, v: the distinct values of a body in order of first appearance."""
    return full.select("script_id", "stmt_seq", "name", F.posexplode(F.array_distinct(F.flatten(values))).alias("pos", "v"))


def read_edges(full: DataFrame) -> DataFrame:
    rows = _first(full, F.transform("parts", lambda p: p["reads"]))
    return rows.select(*edge(F.col("name"), F.col("v"), "READ", F.col("name"), F.lit(""), 0, F.col("pos")))


def _rank(label: Column) -> Column:
    return F.array_position(F.lit(list(WRITES)), label)


def write_edges(full: DataFrame) -> DataFrame:
    """An edge for each table and kind of write, by kind and then by place."""
    rows = _first(full, F.transform("parts", lambda p: p["writes"]))
    return rows.select(*edge(F.col("name"), F.col("v.t"), "WRITE", F.col("name"), F.col("v.label"), 1, (_rank(F.col("v.label")), F.col("pos"))))


def body_parts(full: DataFrame) -> DataFrame:
    """The statements of routine bodies: reads, writes with what is created first, and sources, which are reads that aren't written."""
    rows = full.where("kind in ('FUNCTION', 'PROCEDURE')").select("script_id", "stmt_seq", "name", F.inline("parts"))
    kind = "array<struct<label:string,t:string>>"
    first = F.when(F.col("created").isNotNull(), F.array(F.struct(F.lit("CREATE").alias("label"), F.col("created.name").alias("t")))).otherwise(F.array().cast(kind))
    wide = rows.withColumn("writes", F.concat(first, "writes"))
    return wide.withColumn("sources", F.array_except("reads", F.transform("writes", lambda w: w["t"])))


def create_edges(parts: DataFrame) -> DataFrame:
    made = parts.where("created is not null")
    return made.select(*edge(F.col("name"), F.col("created.name"), "WRITE", F.col("name"), F.lit("CREATE"), 2, F.col("part_seq")))


def body_tables(parts: DataFrame) -> DataFrame:
    """Tables that bodies create, first creator first; parent is the routine."""
    made = parts.where("created is not null")
    first = made.groupBy("script_id", F.col("created.name").alias("made")).agg(F.min_by(F.struct("stmt_seq", "part_seq", F.col("name").alias("parent"), "created"), F.struct("stmt_seq", "part_seq")).alias("f"))
    return first.select("script_id", "f.stmt_seq", "f.part_seq", F.col("made").alias("name"), "f.created.schema", "f.created.temporary", "f.parent", "f.created.stmt")


def flows(parts: DataFrame) -> DataFrame:
    """Data movement of each body statement: source to target, via the routine.

    Sources go to all targets; without sources the routine feeds them, without targets it is fed.
    """
    own = F.array(F.col("name"))
    writing = F.size("writes") > 0
    first = F.filter("writes", lambda w, i: F.array_position(F.transform("writes", lambda x: x["t"]), w["t"]) == i + 1)
    targets = F.when(writing, first).otherwise(F.array(F.struct(F.lit("").alias("label"), F.col("name").alias("t"))))
    sources = F.when((F.size("sources") > 0) | ~writing, F.col("sources")).otherwise(own)
    seq = F.array(*[F.col(c).cast("bigint") for c in ("stmt_seq", "part_seq", "target_pos", "source_pos")])
    rows = parts.select("script_id", "stmt_seq", "part_seq", "name", writing.alias("writing"), sources.alias("s"), F.posexplode(targets).alias("target_pos", "w"))
    rows = rows.select("*", F.posexplode("s").alias("source_pos", "source")).where("source <> w.t")
    return rows.select("script_id", seq.alias("flow_seq"), "source", F.col("w.t").alias("target"), F.when(F.col("writing"), "WRITE").otherwise("READ").alias("edge_type"), F.col("name").alias("via"), F.col("w.label").alias("details"))


def column_mappings(full: DataFrame) -> DataFrame:
    """INSERT (columns) SELECT items FROM table, matched by place; items are split at every comma."""
    rows = full.select("script_id", "stmt_seq", F.col("name").alias("via"), F.inline("parts")).where("mapping is not null")
    pairs = rows.select("script_id", "stmt_seq", "via", F.col("part_seq").alias("insert_seq"), "mapping.src_table", "mapping.tgt_table", F.posexplode(F.arrays_zip("mapping.src", "mapping.tgt").cast("array<struct<src:string,tgt:string>>")).alias("pos", "p")).where("p.src is not null and p.tgt is not null")
    bare = text.strip(F.regexp_replace("p.src", rf"(?iU)\bAS\b\s+{text.NAME}$", ""))
    named = F.lower(F.coalesce(text.first(bare, rf"^(?:{text.NAME}\.)?{text.NAME}$", 2), bare))
    return pairs.withColumn("src_col", named).where(~text.reserved(F.col("src_col"))).select("script_id", "stmt_seq", "insert_seq", "pos", "src_table", "src_col", "tgt_table", F.col("p.tgt").alias("tgt_col"), "via")
