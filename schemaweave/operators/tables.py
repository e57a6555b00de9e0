"""Table definitions: columns, constraints, foreign keys and parents.

A definition stays one row: what its constraints say about its columns is worked out on arrays
in that row, so nothing is shuffled until edges of different statements meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.functions import scanners, text

#: A column as columns_of() gives it.
COLUMN = ("column", "data_type", "nullable", "pk", "unique", "fk_to", "default")


def pairs(cols: Column, table: Column, refs: Column) -> Column:
    """array<struct<column, fk_to>> of a foreign key, for places that both lists have."""
    zipped = F.filter(F.arrays_zip(cols.alias("c"), refs.alias("r")), lambda p: p["c"].isNotNull() & p["r"].isNotNull())
    return F.transform(zipped, lambda p: F.struct(p["c"].alias("column"), F.concat(table, F.lit("."), p["r"]).alias("fk_to")))


def _last_of(keys: Column, name: Column) -> Column:
    """fk_to of the last of (column, fk_to) pairs with this column; null without."""
    return F.try_element_at(F.filter(keys, lambda p: p["column"] == name), F.lit(-1))["fk_to"]


def definitions(statements: DataFrame) -> DataFrame:
    """statements(script_id, stmt_seq, name, stmt, ...) with listed, columns and parents.

    listed: whether there is a column list; columns: array of ordinal and COLUMN, as written;
    parents: those of LIKE and INHERITS.
    """
    read = statements.withColumn("list", scanners.column_list(F.col("stmt")))
    parts = F.coalesce("list.parts", F.array())
    of = lambda kind: F.filter(parts, lambda p: p["constraint"] == kind)
    keys = F.flatten(F.transform(of("PRIMARY KEY"), lambda p: p["cols"]))
    singles = F.flatten(F.transform(F.filter(of("UNIQUE"), lambda p: F.size(p["cols"]) == 1), lambda p: p["cols"]))
    foreign = F.flatten(F.transform(F.filter(of("FOREIGN KEY"), lambda p: p["ref_table"].isNotNull()), lambda p: pairs(p["cols"], p["ref_table"], p["ref_cols"])))

    def column(p: Column) -> Column:
        kind, mods = p["type"], p["mods"]
        counted = kind.rlike(r"\b(?:SERIAL|IDENTITY)\b") | mods.rlike(r"\bIDENTITY\b")
        own = mods.contains("PRIMARY KEY") | counted
        listed = F.array_contains(F.col("__keys"), p["column"])
        inline = F.concat(p["ref_table"], F.lit("."), p["ref_column"])
        default = F.when(F.upper(p["default"]) != "NULL", text.unwrapped(p["default"]))
        values = (p["column"], kind, ~(mods.contains("NOT NULL") | own | listed), own | listed, mods.rlike(r"\bUNIQUE\b") | F.array_contains(F.col("__singles"), p["column"]), F.coalesce(_last_of(F.col("__foreign"), p["column"]), inline), default)
        return F.struct(p["ordinal"].alias("ordinal"), *[v.alias(n) for v, n in zip(values, COLUMN, strict=True)])

    wide = read.withColumns({"__keys": keys, "__singles": singles, "__foreign": foreign})
    plain = lambda p: p.withField("type", text.normal_type(p["type"])).withField("mods", F.upper(F.regexp_replace(p["mods"], r"\s+", " ")))
    own = F.transform(F.transform(F.filter(parts, lambda p: p["constraint"].isNull()), plain), column)
    return wide.select(*statements.columns, F.col("list").isNotNull().alias("listed"), own.alias("columns"), F.coalesce("list.parents", F.array()).alias("parents"))


#: pos: where an edge stands in its statement and phase, an array that sorts.
EDGE = ("script_id", "stmt_seq", "phase", "pos", "source", "target", "edge_type", "via", "details")


def edge(source: Column, target: Column, kind: str, via: Column, details: Column, phase: int, pos: Column | tuple[Column, ...]) -> list[Column]:
    return [F.col("script_id"), F.col("stmt_seq"), F.lit(phase).alias("phase"), F.transform(F.array(*pos) if isinstance(pos, tuple) else F.array(pos), lambda p: p.cast("bigint")).alias("pos"), source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), via.alias("via"), details.alias("details")]


def foreign_edges(tables: DataFrame) -> DataFrame:
    """One edge per referenced table of a definition, details in column order."""
    refs = F.filter("columns", lambda c: c["fk_to"].isNotNull())
    table = lambda c: F.substring_index(c["fk_to"], ".", 1)
    rows = tables.select("script_id", "stmt_seq", "name", refs.alias("refs"), F.posexplode(F.array_distinct(F.transform(refs, table))).alias("pos", "ref"))
    said = F.transform(F.filter("refs", lambda c: table(c) == F.col("ref")), lambda c: F.concat(c["column"], F.lit(" -> "), c["fk_to"]))
    return rows.select(*edge(F.col("name"), F.col("ref"), "FK", F.col("name"), F.array_join(said, ", "), 0, F.col("pos")))


def parent_edges(tables: DataFrame) -> DataFrame:
    """INHERITS edges to the parents."""
    rows = tables.select("script_id", "stmt_seq", "name", F.posexplode("parents").alias("pos", "parent"))
    return rows.select(*edge(F.col("name"), F.col("parent"), "INHERITS", F.col("name"), F.lit(""), 1, F.col("pos")))


def alterations(statements: DataFrame) -> DataFrame:
    """ALTER TABLE statements to script_id, stmt_seq, name, pos, cols, ref_table, ref_cols of their references."""
    rows = statements.select("script_id", "stmt_seq", "name", F.posexplode(scanners.references(F.col("stmt"))).alias("pos", "r"))
    return rows.select("script_id", "stmt_seq", "name", "pos", "r.*")


def alter_edges(altered: DataFrame) -> DataFrame:
    """An edge per reference; its details are the pairs of columns, if it is a FOREIGN KEY clause."""
    detail = F.array_join(F.transform(pairs(F.col("cols"), F.col("ref_table"), F.col("ref_cols")), lambda p: F.concat(p["column"], F.lit(" -> "), p["fk_to"])), ", ")
    return altered.select(*edge(F.col("name"), F.col("ref_table"), "FK", F.col("name"), detail, 0, F.col("pos")))


def with_alterations(tables: DataFrame, altered: DataFrame) -> DataFrame:
    """tables with fk_to of their columns set by later ALTER TABLE statements, the last one's last."""
    sets = altered.withColumn("p", pairs(F.col("cols"), F.col("ref_table"), F.col("ref_cols"))).groupBy("script_id", "name").agg(F.sort_array(F.collect_list(F.struct("stmt_seq", "pos", "p"))).alias("sets"))
    later = F.flatten(F.transform(F.filter("sets", lambda s: s["stmt_seq"] > F.col("stmt_seq")), lambda s: s["p"]))
    joined = tables.join(sets, ["script_id", "name"], "left").withColumn("later", F.coalesce(later, F.array()))
    new = F.transform("columns", lambda c: c.withField("fk_to", F.coalesce(_last_of(F.col("later"), c["column"]), c["fk_to"])))
    return joined.withColumn("columns", new).select(*tables.columns)


def latest(definitions: DataFrame) -> DataFrame:
    """Objects by name: the last definition wins and keeps the first one's place (obj_seq)."""
    w = Window.partitionBy("script_id", "name")
    marked = definitions.withColumn("obj_seq", F.min("stmt_seq").over(w)).withColumn("__last", F.max("stmt_seq").over(w))
    return marked.where("stmt_seq = __last").drop("__last")
