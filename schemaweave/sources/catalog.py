"""Scripts from the catalogs of databases.

What a catalog says comes as DataFrames of a stated shape (SHAPES), read by Connector.read() from a
running database or from anywhere else; filters are expressions, so they reach the source by pushdown.
The transforms give one row per statement: section, seq and ddl, in which order script_of() joins
them. Frames of several databases have a `database` column, and give a script for each. Null names
and definitions give no statement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.functions.storage import tasks
from schemaweave.sources.live import DbApi, Jdbc

#: Columns of each catalog relation.
SHAPES = {
    "tables": "oid bigint, schema string, name string, kind string, is_partition boolean, inherits string, from_extension boolean",
    "columns": "oid bigint, schema string, owner string, ordinal int, name string, type string, not_null boolean, default_expr string",
    "constraints": "oid bigint, schema string, owner string, ordinal int, name string, definition string",
    "views": "oid bigint, schema string, name string, kind string, definition string, from_extension boolean",
    "routines": "oid bigint, schema string, name string, kind string, definition string, from_extension boolean",
    "named_tables": "schema string, name string, kind string",
    "named_routines": "schema string, name string, kind string",
    "definitions": "schema string, name string, kind string, definition string",
}


def quote_postgres(name: Column) -> Column:
    return F.when(name.rlike(r"^[a-z_][a-z0-9_]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_mysql(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def _ended(definition: Column) -> Column:
    """A definition that ends with one semicolon."""
    return F.concat(F.regexp_replace(F.trim(definition), r"[;\s]+$", ""), F.lit(";"))


def chosen(rows: DataFrame, schema: str | None = None, objects: list[str] | None = None) -> DataFrame:
    """Rows of a schema, with these names, that no extension has made."""
    if schema is not None:
        rows = rows.where(F.col("schema") == schema)
    if objects:
        rows = rows.where(F.col("name").isin(objects))
    return rows.where(~F.coalesce("from_extension", F.lit(False))) if "from_extension" in rows.columns else rows


def _apart(rows: DataFrame) -> list[str]:
    """The column that tells databases apart, if there is one."""
    return [c for c in rows.columns if c == "database"]


def table_statements(tables: DataFrame, columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """CREATE TABLE statements: oid, ddl.

    tables(oid, schema, name, inherits), columns(oid, ordinal, name, type, not_null, default_expr),
    constraints(oid, ordinal, name, definition). Foreign keys come after other constraints.
    """
    col = F.concat(quote_postgres(F.col("name")), F.lit(" "), "type", F.when(F.col("default_expr").isNotNull(), F.concat(F.lit(" DEFAULT "), "default_expr")).otherwise(""), F.when(F.col("not_null"), " NOT NULL").otherwise(""))
    con = F.concat(F.lit("CONSTRAINT "), quote_postgres(F.col("name")), F.lit(" "), "definition")
    rank = F.when(F.col("definition").startswith("FOREIGN KEY"), 2).otherwise(1)
    key = ["oid", *_apart(tables)]
    parts = columns.select(*key, F.lit(0).alias("kind"), "ordinal", col.alias("part")).unionByName(constraints.select(*key, rank.alias("kind"), "ordinal", con.alias("part")))
    body = parts.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "ordinal", "part"))), lambda x: x["part"]), ", ").alias("body"))
    named = F.concat(quote_postgres(F.col("schema")), F.lit("."), quote_postgres(F.col("name")))
    tail = F.when(F.coalesce("inherits", F.lit("")) != "", F.concat(F.lit(" INHERITS ("), "inherits", F.lit(")"))).otherwise("")
    return tables.join(body, key, "left").select(*key, F.concat(F.lit("CREATE TABLE "), named, F.lit(" ("), F.coalesce("body", F.lit("")), F.lit(")"), tail, F.lit(";")).alias("ddl"))


def view_statements(views: DataFrame) -> DataFrame:
    """views(schema, name, kind v/m, definition) with ddl."""
    word = F.when(F.col("kind") == "m", "MATERIALIZED VIEW ").otherwise("VIEW ")
    return views.withColumn("ddl", F.concat(F.lit("CREATE "), word, quote_postgres(F.col("schema")), F.lit("."), quote_postgres(F.col("name")), F.lit(" AS "), _ended(F.col("definition"))))


def _sections(*parts: DataFrame) -> DataFrame:
    """(seq, ddl) frames as section, seq, ddl."""
    numbered = [p.select(*_apart(p), F.lit(k).alias("section"), F.col("seq").cast("string").alias("seq"), "ddl") for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, numbered).where("ddl is not null")


def postgres_statements(tables: DataFrame, columns: DataFrame, constraints: DataFrame, views: DataFrame, routines: DataFrame, schema: str = "public", objects: list[str] | None = None) -> DataFrame:
    """Tables by name, views in order of creation, routines by name: section, seq, ddl.

    tables also have kind (relkind) and is_partition; ordinary and partitioned tables count,
    partitions don't. routines(schema, name, oid, kind f/p, definition); views also have an oid.
    """
    own = chosen(tables, schema, objects).where("kind in ('r', 'p') and not is_partition")
    key = ["oid", *_apart(tables)]
    made = table_statements(own, columns, constraints).join(own.select(*key, F.col("name").alias("seq")), key)
    seen = view_statements(chosen(views, schema, objects).where("kind in ('v', 'm')")).withColumn("seq", F.lpad(F.col("oid").cast("string"), 20, "0"))
    run = chosen(routines, schema, objects).where("kind in ('f', 'p')").select(*_apart(routines), F.concat("name", F.lit("\0"), F.lpad(F.col("oid").cast("string"), 20, "0")).alias("seq"), _ended(F.col("definition")).alias("ddl"))
    return _sections(made, seen, run)


def mysql_statements(tables: DataFrame, routines: DataFrame, definitions: DataFrame, database: str, objects: list[str] | None = None) -> DataFrame:
    """Tables, then views, then routines, each by name: section, seq, ddl.

    tables(schema, name, kind), routines(schema, name, kind); definitions(schema, name, kind TABLE,
    VIEW, FUNCTION or PROCEDURE, definition) are what SHOW CREATE gives. What the user may not see has none.
    """
    apart = _apart(tables)
    shown = definitions.select(*apart, "schema", "name", "kind", _ended(F.col("definition")).alias("ddl"))

    def of(rows: DataFrame, kind: Column) -> DataFrame:
        return chosen(rows, database, objects).select(*apart, "schema", "name", kind.alias("kind")).join(shown, [*apart, "schema", "name", "kind"]).select(*apart, F.col("name").alias("seq"), "ddl")

    view = F.col("kind") == "VIEW"
    return _sections(of(tables.where(~view), F.lit("TABLE")), of(tables.where(view), F.lit("VIEW")), of(routines, F.upper("kind")))


def show_create(tables: DataFrame, routines: DataFrame) -> DataFrame:
    """The SHOW CREATE statements that give mysql_statements() its definitions: schema, name, kind, query."""
    kinds = tables.select("schema", "name", F.when(F.col("kind") == "VIEW", "VIEW").otherwise("TABLE").alias("kind")).unionByName(routines.select("schema", "name", F.upper("kind").alias("kind")))
    return kinds.withColumn("query", F.concat(F.lit("SHOW CREATE "), "kind", F.lit(" "), quote_mysql(F.col("schema")), F.lit("."), quote_mysql(F.col("name"))))


def script_of(statements: DataFrame, script_id: str | None = None) -> DataFrame:
    """script_id and ddl: all statements of a catalog as one script; of several databases, one script each, called like the database."""
    ordered = F.sort_array(F.collect_list(F.struct("section", "seq", "ddl")))
    text = F.array_join(F.transform(ordered, lambda x: x["ddl"]), "\n\n").alias("ddl")
    if script_id is None:
        # Reading text takes time, not space: a fixed number of partitions isn't merged for being small.
        return statements.repartition(tasks(statements.sparkSession), "database").groupBy(F.col("database").alias("script_id")).agg(text)
    return statements.agg(text).select(F.lit(script_id).alias("script_id"), "ddl")


@dataclass(frozen=True)
class Connector:
    """A kind of database: its JDBC URL and driver, how it quotes names, its statements, and how its catalog is asked.

    catalog: the query of each relation that `statements` takes, in its order; shard: a condition that cuts
    a query's rows into n shares, or none; follow: the relation whose definitions are statements to run.
    """

    scheme: str
    driver: str
    port: int
    quote: Callable[[Column], Column]
    statements: Callable[..., DataFrame]
    catalog: dict[str, str] = field(default_factory=dict)
    shard: str | None = None
    follow: str | None = None

    def url(self, host: str, database: str, port: int | None = None) -> str:
        return f"jdbc:{self.scheme}://{host}:{port or self.port}/{database}"

    def read(self, spark: SparkSession, source: DbApi | Jdbc, relation: str, schema: str | None = None, objects: list[str] | None = None) -> DataFrame:
        """A catalog relation of all databases of a source; schema and objects are pushed down to it."""
        rows = source.load(spark, self.catalog[relation], SHAPES[relation], self.shard, "definition" if relation == self.follow else None)
        if schema is not None:
            rows = rows.where(F.col("schema") == schema)
        return rows.where(F.col("owner" if "owner" in rows.columns else "name").isin(objects)) if objects else rows

    def scripts(self, spark: SparkSession, source: DbApi | Jdbc, schema: str, objects: list[str] | None = None) -> DataFrame:
        """script_id and ddl of each database of a source."""
        return script_of(self.statements(*[self.read(spark, source, r, schema, objects) for r in self.catalog], schema, objects))

    def extract(self, script_id: str, *catalog: DataFrame, **filters) -> DataFrame:
        """The script (script_id, ddl) of catalog tables in the shape that `statements` takes."""
        return script_of(self.statements(*catalog, **filters), script_id)


_PG_EXTENSION = "EXISTS (SELECT 1 FROM pg_depend e WHERE e.objid = {0}.oid AND e.classid = '{1}'::regclass AND e.deptype = 'e')"
_POSTGRES = {
    "tables": f"""SELECT t.oid::bigint AS oid, s.nspname AS schema, t.relname AS name, t.relkind::text AS kind, t.relispartition AS is_partition,
      (SELECT string_agg(format('%I.%I', ps.nspname, p.relname), ', ' ORDER BY h.inhseqno) FROM pg_inherits h JOIN pg_class p ON p.oid = h.inhparent JOIN pg_namespace ps ON ps.oid = p.relnamespace
       WHERE h.inhrelid = t.oid AND NOT t.relispartition) AS inherits, {_PG_EXTENSION.format("t", "pg_class")} AS from_extension
      FROM pg_class t JOIN pg_namespace s ON s.oid = t.relnamespace WHERE t.relkind IN ('r', 'p')""",
    "columns": """SELECT t.oid::bigint AS oid, s.nspname AS schema, t.relname AS owner, a.attnum::int AS ordinal, a.attname AS name, format_type(a.atttypid, a.atttypmod) AS type, a.attnotnull AS not_null,
      CASE WHEN a.attgenerated = '' THEN pg_get_expr(d.adbin, d.adrelid) END AS default_expr
      FROM pg_attribute a JOIN pg_class t ON t.oid = a.attrelid JOIN pg_namespace s ON s.oid = t.relnamespace LEFT JOIN pg_attrdef d ON d.adrelid = t.oid AND d.adnum = a.attnum
      WHERE a.attnum > 0 AND NOT a.attisdropped AND t.relkind IN ('r', 'p')""",
    "constraints": """SELECT t.oid::bigint AS oid, s.nspname AS schema, t.relname AS owner, row_number() OVER (PARTITION BY t.oid ORDER BY c.conname)::int AS ordinal, c.conname AS name, pg_get_constraintdef(c.oid) AS definition
      FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace s ON s.oid = t.relnamespace WHERE c.contype IN ('p', 'u', 'f', 'c', 'x')""",
    "views": f"""SELECT v.oid::bigint AS oid, s.nspname AS schema, v.relname AS name, v.relkind::text AS kind, pg_get_viewdef(v.oid) AS definition, {_PG_EXTENSION.format("v", "pg_class")} AS from_extension
      FROM pg_class v JOIN pg_namespace s ON s.oid = v.relnamespace WHERE v.relkind IN ('v', 'm')""",
    "routines": f"""SELECT r.oid::bigint AS oid, s.nspname AS schema, r.proname AS name, r.prokind::text AS kind, pg_get_functiondef(r.oid) AS definition, {_PG_EXTENSION.format("r", "pg_proc")} AS from_extension
      FROM pg_proc r JOIN pg_namespace s ON s.oid = r.pronamespace WHERE r.prokind IN ('f', 'p')""",
}
_MYSQL_TABLES = "SELECT table_schema AS `schema`, table_name AS name, CASE WHEN table_type LIKE '%VIEW' THEN 'VIEW' ELSE 'TABLE' END AS kind FROM information_schema.tables"
_MYSQL_ROUTINES = "SELECT routine_schema AS `schema`, routine_name AS name, routine_type AS kind FROM information_schema.routines"
_MYSQL = {
    "named_tables": _MYSQL_TABLES,
    "named_routines": _MYSQL_ROUTINES,
    "definitions": f"SELECT o.`schema`, o.name, o.kind, concat('SHOW CREATE ', o.kind, ' `', replace(o.`schema`, '`', '``'), '`.`', replace(o.name, '`', '``'), '`') AS definition FROM ({_MYSQL_TABLES} UNION ALL {_MYSQL_ROUTINES}) o",
}
_SQLITE = {
    "tables": "SELECT rowid AS oid, 'main' AS schema, name, 'r' AS kind, 0 AS is_partition, NULL AS inherits, name LIKE 'sqlite\\_%' ESCAPE '\\' AS from_extension FROM sqlite_master WHERE type = 'table'",
    "columns": "SELECT m.rowid AS oid, 'main' AS schema, m.name AS owner, c.cid AS ordinal, c.name, c.type, c.\"notnull\" AS not_null, c.dflt_value AS default_expr FROM sqlite_master m, pragma_table_info(m.name) c WHERE m.type = 'table'",
    "constraints": """SELECT m.rowid AS oid, 'main' AS schema, m.name AS owner, 0 AS ordinal, m.name || '_pkey' AS name, 'PRIMARY KEY (' || group_concat('"' || c.name || '"', ', ') || ')' AS definition
      FROM sqlite_master m, pragma_table_info(m.name) c WHERE m.type = 'table' AND c.pk > 0 GROUP BY m.rowid, m.name
      UNION ALL SELECT m.rowid, 'main', m.name, f.id + 1, m.name || '_fk' || f.id, 'FOREIGN KEY (' || group_concat('"' || f."from" || '"', ', ') || ') REFERENCES "' || f."table" || '"' || coalesce(' (' || group_concat('"' || f."to" || '"', ', ') || ')', '')
      FROM sqlite_master m, pragma_foreign_key_list(m.name) f WHERE m.type = 'table' GROUP BY m.rowid, m.name, f.id, f."table\"""",
    "views": "SELECT rowid AS oid, 'main' AS schema, name, 'v' AS kind, substr(sql, instr(upper(sql), ' AS ') + 4) AS definition, 0 AS from_extension FROM sqlite_master WHERE type = 'view'",
    "routines": "SELECT 0 AS oid, 'main' AS schema, '' AS name, 'f' AS kind, NULL AS definition, 0 AS from_extension FROM sqlite_master WHERE 0",
}

CONNECTORS = {
    "postgresql": Connector("postgresql", "org.postgresql.Driver", 5432, quote_postgres, postgres_statements, _POSTGRES, "mod(q.oid, {n}) = {i}"),
    "mysql": Connector("mysql", "com.mysql.cj.jdbc.Driver", 3306, quote_mysql, mysql_statements, _MYSQL, "mod(crc32(q.name), {n}) = {i}", "definitions"),
    "sqlite": Connector("sqlite", "org.sqlite.JDBC", 0, quote_postgres, postgres_statements, _SQLITE, "q.oid % {n} = {i}"),
}


def connector(kind: str) -> Connector:
    if kind not in CONNECTORS:
        raise ValueError(f"unknown database {kind!r}; known: {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[kind]
