"""Columns of views and CREATE TABLE AS: names from the select list, types from what was defined before.

A query stays one row with its items and sources. All that it needs of earlier definitions is
joined to it as one array, and its columns are worked out in that row. Queries on queries wait
until those have their columns: one round per level of nesting, each query in one round only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.functions import scanners, text
from schemaweave.functions.storage import stored
from schemaweave.operators.tables import COLUMN

_KEY = ["script_id", "stmt_seq", "part_seq"]
#: A plain item: a column with or without what it is a column of.
_PLAIN = rf"^(?:{text.NAME}\.)?{text.NAME}$"
COLUMNS = "array<struct<column:string,data_type:string,nullable:boolean,pk:boolean,unique:boolean,fk_to:string,default:string>>"
_KNOWN = f"array<struct<table:string,columns:{COLUMNS}>>"


def as_given(c: Column) -> Column:
    """A defined column as queries see it."""
    return F.struct(*[c[x].alias(x) for x in COLUMN])


def _plain(column: Column, data_type: Column) -> list[Column]:
    """The fields of a column without flags."""
    none = F.lit(None).cast("string")
    values = (column, data_type, F.lit(True), F.lit(False), F.lit(False), none, none)
    return [v.alias(x) for v, x in zip(values, COLUMN, strict=True)]


def queries(rows: DataFrame) -> DataFrame:
    """rows(script_id, stmt_seq, part_seq, name, body) with items, and names: array<struct<k, table>> of what a qualifier k means."""
    read = rows.withColumn("q", scanners.query_parts(F.col("body")))
    both = F.flatten(F.transform("q.sources", lambda s: F.array(F.struct(s["table"].alias("k"), s["table"].alias("table")), F.struct(s["alias"].alias("k"), s["table"].alias("table")))))
    return read.select(*_KEY, "name", F.col("q.items").alias("items"), F.filter(both, lambda x: x["k"].isNotNull()).alias("names"), F.lit(False).alias("copy"))


def copies(rows: DataFrame) -> DataFrame:
    """rows(script_id, stmt_seq, name, of): queries for all columns of a table; none if it isn't known."""
    names = F.array(F.struct(F.col("of").alias("k"), F.col("of").alias("table")))
    return rows.select("script_id", "stmt_seq", F.lit(-1).alias("part_seq"), "name", F.array(F.lit("*")).alias("items"), names.alias("names"), F.lit(True).alias("copy"))


def _meant(qualifier: Column) -> Column:
    """The table that a qualifier means: the last source called so, else a table of that name."""
    return F.coalesce(F.try_element_at(F.filter(F.col("names"), lambda x: x["k"] == qualifier), F.lit(-1))["table"], qualifier)


def _qualifier(item: Column) -> Column:
    return F.lower(text.first(text.expression_source(item), rf"^{text.NAME}\.(?:\*|{text.NAME})$"))


def _tables() -> Column:
    return F.array_distinct(F.transform(F.col("names"), lambda x: x["table"]))


def _needed(open_: DataFrame, given: DataFrame) -> DataFrame:
    """_KEY, table, def_seq, def_part: the last definition before a query of each table that it names."""
    every = F.array_union(_tables(), F.filter(F.transform("items", lambda x: _meant(_qualifier(x))), lambda x: x.isNotNull()))
    named = open_.select(*_KEY, F.explode(every).alias("table"))
    defs = given.select("script_id", F.col("name").alias("table"), F.col("stmt_seq").alias("def_seq"))
    top = open_.where("part_seq < 0").select("script_id", F.col("name").alias("table"), F.col("stmt_seq").alias("def_seq"))
    found = named.join(defs.unionByName(top), ["script_id", "table"]).where("def_seq < stmt_seq")
    return found.groupBy(*_KEY, "table").agg(F.max("def_seq").alias("def_seq"))


def _of(table: Column) -> Column:
    """Columns of a table among those that the query knows; none if it isn't known."""
    return F.coalesce(F.try_element_at(F.filter(F.col("known"), lambda k: k["table"] == table), F.lit(1))["columns"], F.array().cast(COLUMNS))


def _type_in(table: Column, column: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(_of(table), lambda c: c["column"] == column), F.lit(1))["data_type"], F.lit(""))


def _typed(item: Column) -> Column:
    """The type of a plain item: that of its qualifier's column, else the only one that any source has."""
    source = text.expression_source(item)
    column, qualifier = F.lower(text.first(source, _PLAIN, 2)), F.lower(text.first(source, _PLAIN, 1))
    kinds = F.array_distinct(F.filter(F.transform(_tables(), lambda t: _type_in(t, column)), lambda x: x != ""))
    free = F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("")
    return F.when(column.isNull(), "").when(qualifier.isNotNull(), _type_in(_meant(qualifier), column)).otherwise(free)


def _columns(item: Column, place: Column) -> Column:
    """What an item gives: the columns that its wildcard stands for, or one; n numbers a name that is taken (0: by its own place)."""
    source = text.expression_source(item)
    wide = F.when(source == "*", F.flatten(F.transform(_tables(), _of))).when(source.endswith(".*"), _of(_meant(_qualifier(item)))).otherwise(F.array().cast(COLUMNS))
    one = F.array(F.struct(*_plain(text.expression_name(item, place), _typed(item)), place.cast("int").alias("n")))
    kept = lambda c: F.struct(*[F.when(F.col("copy"), c[x]).otherwise(p).alias(x) for x, p in zip(COLUMN, _plain(c["column"], c["data_type"]), strict=True)], F.lit(0).alias("n"))
    many = F.transform(wide, kept)
    return F.when((F.size(many) > 0) | F.col("copy"), many).otherwise(one)


def resolved(ready: DataFrame) -> DataFrame:
    """_KEY, name, columns of queries with known(table, columns)."""
    wide = ready.withColumn("all", F.flatten(F.transform("items", lambda x, i: _columns(x, i + 1))))
    names = F.transform("all", lambda c: c["column"])

    def unique(c: Column, i: Column) -> Column:
        number = F.when(c["n"] > 0, c["n"]).otherwise(i + 1)
        taken = F.array_position(F.col("used"), c["column"]) <= i
        return as_given(c.withField("column", F.when(taken, F.concat(c["column"], F.lit("_"), number)).otherwise(c["column"])))

    return wide.withColumn("used", names).select(*_KEY, "name", F.transform("all", unique).alias("columns"))


def derived_columns(open_: DataFrame, given: DataFrame) -> DataFrame:
    """_KEY, name, columns of queries() rows; given(script_id, stmt_seq, name, columns) is what other definitions have.

    A query sees the last definition before it; part_seq is -1 for those that others can see.
    """
    open_ = stored(open_)
    if not open_.take(1):
        return resolved(open_.withColumn("known", F.array().cast(_KNOWN)))
    given = stored(given)
    needed = stored(_needed(open_, given))
    waiting = needed.join(given.select("script_id", F.col("name").alias("table"), F.col("stmt_seq").alias("def_seq")), ["script_id", "table", "def_seq"], "left_anti")
    waiting, known, out = stored(waiting), given, None
    while True:
        ready = open_.join(waiting, _KEY, "left_anti")
        visible = needed.join(known.select("script_id", F.col("name").alias("table"), F.col("stmt_seq").alias("def_seq"), "columns"), ["script_id", "table", "def_seq"])
        own = ready.join(visible.groupBy(*_KEY).agg(F.collect_list(F.struct("table", "columns")).alias("known")), _KEY, "left")
        done = stored(resolved(own.withColumn("known", F.coalesce("known", F.array().cast(_KNOWN)))))
        out = done if out is None else out.unionByName(done)
        if not waiting.take(1):
            return out
        top = done.where("part_seq < 0").select("script_id", "stmt_seq", "name", "columns")
        known = known.unionByName(top)
        open_ = stored(open_.join(done, _KEY, "left_anti"))
        waiting = stored(waiting.join(top.select("script_id", F.col("name").alias("table"), F.col("stmt_seq").alias("def_seq")), ["script_id", "table", "def_seq"], "left_anti"))
