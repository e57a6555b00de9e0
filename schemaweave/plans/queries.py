"""Queries over corpora of scripts that are written from the tables' rows, with the truth in SQL.

Each row becomes DDL text, which is then really parsed; the SQL derives the same relations
from the rows, without any text. Corpora are DataFrames, so they grow with the tables.
"""

from __future__ import annotations

import sqlite3
import uuid
from contextlib import closing
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.functions import storage
from schemaweave.operators import compare, graph, history, render, splitting, statements
from schemaweave.plans.analysis import Analysis, Dump, Project, analyze
from schemaweave.sources.catalog import connector
from schemaweave.sources.live import DbApi


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _say(form: str, *columns: str) -> Column:
    return F.format_string(form, *[F.col(c) for c in columns])


def _scripts(rows: DataFrame, script: Column, ddl: Column) -> DataFrame:
    """Statements of rows gathered into scripts of bounded size: script is a key of few rows."""
    said = rows.select(script.cast("string").alias("script_id"), ddl.alias("d"))
    # Reading text takes time, not space: a fixed number of partitions isn't merged for being small.
    said = said.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "script_id")
    return said.groupBy("script_id").agg(F.array_join(F.sort_array(F.collect_list("d")), "\n").alias("ddl"))


def _customers(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer")
    return _scripts(rows, F.expr("c_custkey div 50"), _say(form, "c_custkey", "c_nationkey"))


def fk_edges_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyze(_customers(spark, sf_dir, "CREATE TABLE c_%1$s (id INT PRIMARY KEY, nation_id INTEGER NOT NULL REFERENCES sales.nation_%2$s(id)); -- customer; one\n"))
    return a.edges.select("script_id", "source", "target", "edge_type", "details")


def fk_edges_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer")
    head = F.element_at(F.array(*map(F.lit, ('ALTER TABLE ONLY shop."C_', "ALTER TABLE IF EXISTS `c_", "ALTER TABLE IF EXISTS ONLY a.shop.c_"))), F.col("c_custkey").cast("int") % 3 + 1)
    mark = F.element_at(F.array(*map(F.lit, ('"', "`", ""))), F.col("c_custkey").cast("int") % 3 + 1)
    tail = _say(" ADD CONSTRAINT fk_%1$s FOREIGN KEY (nation_id, \"Part\") REFERENCES shop.nation_%2$s (id, part);", "c_custkey", "c_nationkey")
    s = _scripts(rows, F.expr("c_custkey div 50"), F.concat(head, F.col("c_custkey").cast("string"), mark, tail))
    return analyze(s).edges.select("script_id", "source", "target", "edge_type", "details")


def columns_altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyze(_customers(spark, sf_dir, "CREATE TABLE c_%1$s (id INT, nation_id INT); ALTER TABLE ONLY shop.c_%1$s ADD FOREIGN KEY (nation_id) REFERENCES old_%2$s; ALTER TABLE c_%1$s ADD CONSTRAINT k FOREIGN KEY (nation_id) REFERENCES shop.nation_%2$s(code);"))
    return a.columns.select("script_id", "name", "column", "fk_to")


def fk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"))
    s = _scripts(rows, F.expr("l_orderkey div 50"), _say("CREATE TABLE IF NOT EXISTS ret_%1$s (\n  order_id INT, line_no INT DEFAULT %2$s,\n  CONSTRAINT fk FOREIGN KEY (order_id, line_no) REFERENCES items_%1$s (order_id, line_no)\n);", "l_orderkey", "n"))
    return analyze(s).edges.select("script_id", "source", "target", "details")


def columns_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part")
    form = "CREATE TABLE part_%1$s (\n  id SERIAL, /* key; */ brand varchar ( 10 ) NOT NULL DEFAULT '%2$s',\n  price NUMERIC(10 , 2) UNIQUE,\n  size_%3$s integer, owner_id INT REFERENCES owners,\n  PRIMARY KEY (brand)\n);"
    return analyze(_scripts(rows, F.expr("p_partkey div 50"), _say(form, "p_partkey", "p_brand", "p_size"))).columns.select("script_id", "name", F.col("ordinal").cast("bigint").alias("ordinal"), "column", "data_type", "nullable", "pk", "unique", "fk_to", "default")


def _order_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    orders = _read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joins = F.coalesce(F.array_join(F.transform("parts", lambda p: F.format_string("JOIN part_%1$s ON TRUE", p)), " "), F.lit(""))
    return orders.withColumn("joins", joins)


def view_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_views(spark, sf_dir)
    s = _scripts(rows, F.expr("o_orderkey div 50"), _say("CREATE OR REPLACE VIEW v_%1$s AS SELECT EXTRACT(YEAR FROM o.d) AS y, c.id FROM shop.customer_%2$s AS c %3$s WHERE c.note <> 'from nowhere;';", "o_orderkey", "o_custkey", "joins"))
    return analyze(s).edges.select("script_id", "source", "target", "edge_type")


def reads_comma_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders")
    form = "CREATE VIEW v_%1$s AS WITH recent AS (SELECT id FROM orders_%1$s o, (SELECT 1) s) SELECT substring(x FROM 2) FROM recent r, \"Cust_%2$s\" AS c, unnest(arr) AS u(z) JOIN (a.b_%1$s JOIN d_%1$s USING (id)) ON TRUE"
    return analyze(_scripts(rows, F.expr("o_orderkey div 50"), F.concat(_say(form, "o_orderkey", "o_custkey"), F.lit(";")))).edges.select("script_id", "source", "target")


_ROUTINES = {
    "purchase": "INSERT INTO sales_%1$s (user_id, total) SELECT user_id, value AS v FROM carts_%2$s;",
    "click": "UPDATE ONLY users_%2$s u SET n = 1 FROM clicks_%1$s;",
    "error": "DELETE FROM queue_%1$s;",
    "view": "SELECT count(*) INTO x FROM pages_%1$s;",
    "signup": "CREATE TEMP TABLE fresh_%1$s AS SELECT id FROM users_%2$s;",
}


def _routines(spark: SparkSession, sf_dir: str) -> Analysis:
    form = F.lit("")
    for kind, body in _ROUTINES.items():
        form = F.when(F.col("event_type") == kind, F.format_string(body, F.col("event_id"), F.col("user_id"))).otherwise(form)
    rows = _read(spark, sf_dir, "events").withColumn("body", form)
    return analyze(_scripts(rows, F.expr("event_id div 50"), _say("CREATE FUNCTION f_%1$s() RETURNS void AS $$ BEGIN %2$s END $$ LANGUAGE plpgsql;", "event_id", "body")))


def routine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routines(spark, sf_dir).edges.select("script_id", "source", "target", "edge_type", "details")


def routine_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routines(spark, sf_dir).flows.select("script_id", "source", "target", "edge_type", "via", "details")


def column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routines(spark, sf_dir).column_lineage.select("script_id", F.col("pos").cast("bigint").alias("pos"), "src_table", "src_col", "tgt_table", "tgt_col", "via")


def routine_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routines(spark, sf_dir).objects.select("script_id", "name", "type", "temporary", "parent")


def lineage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _routines(spark, sf_dir)
    return compare.lineage_view(a.objects, a.edges, a.flows).select("script_id", "from", "to", "type", "details")


def function_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = compare.groups(_routines(spark, sf_dir).objects)
    return g.select("script_id", "owner", F.array_join("members", ",").alias("members"))


def statement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier")
    form = "CREATE TABLE s_%1$s (note TEXT DEFAULT 'a;b');\nCREATE FUNCTION f_%1$s() AS $q$ SELECT 1; SELECT ';' $q$;\nCREATE PROCEDURE p_%1$s() BEGIN IF x THEN UPDATE t SET a = CASE WHEN b THEN 1 END; END IF; DELETE FROM t; END;\nINSERT INTO s_%1$s VALUES (1, ';');"
    return statements.statement_counts(_scripts(rows, F.expr("s_suppkey div 5"), _say(form, "s_suppkey")))


def derived_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "supplier")
    form = (
        "CREATE TABLE t_%1$s (id BIGINT, nation INT, label VARCHAR(%2$s)); CREATE VIEW v_%1$s AS SELECT a.*, label AS tag, count(*) AS n, id + 1 FROM t_%1$s a; CREATE VIEW w_%1$s AS SELECT v.tag, id, nothing FROM v_%1$s v;"
        "CREATE TABLE u_%1$s (id INT, mail TEXT);"
        "CREATE VIEW x_%1$s AS SELECT t_%1$s.id, u_%1$s.id, mail FROM (t_%1$s JOIN shop.u_%1$s AS b ON TRUE);"
        "CREATE VIEW y_%1$s AS SELECT *, b.* FROM u_%1$s a JOIN u_%1$s b ON TRUE; CREATE VIEW z_%1$s AS SELECT * FROM unknown_%1$s;"
        "CREATE FUNCTION f_%1$s() RETURNS SETOF x_%1$s AS $$ SELECT 1 $$; CREATE TABLE c_%1$s AS SELECT tag, f.mail FROM w_%1$s JOIN f_%1$s f ON TRUE;"
    )
    a = analyze(_scripts(rows, F.col("s_suppkey"), F.format_string(form, F.col("s_suppkey"), F.col("s_nationkey") + 1)))
    return a.derived_columns.select("script_id", "name", F.col("ordinal").cast("bigint").alias("ordinal"), "column", "data_type")


def _shop(spark: SparkSession, sf_dir: str) -> Project:
    """Regions, nations and customers, and views over them: scripts of bounded size, analysed as one project."""
    nation = _read(spark, sf_dir, "nation").select(F.expr("concat('n', n_nationkey div 50)").alias("s"), _say("CREATE TABLE n_%1$s (id INT, r INT REFERENCES r_%2$s);", "n_nationkey", "n_regionkey").alias("d"))
    rows = _read(spark, sf_dir, "customer").withColumn("s", F.expr("concat('c', c_custkey div 50)"))
    customer = rows.select("s", _say("CREATE TABLE c_%1$s (id INT, n INT REFERENCES n_%2$s);", "c_custkey", "c_nationkey").alias("d"))
    view = rows.select("s", _say("CREATE VIEW w_%1$s AS SELECT * FROM c_%1$s JOIN n_%2$s USING (id);", "c_custkey", "c_nationkey").alias("d"))
    return Project(_scripts(nation.unionByName(customer).unionByName(view), F.col("s"), F.col("d")), "shop")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.lit("shop").alias("script_id"), _say("r_%1$s", "r_regionkey").alias("target"))


def impact_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shop(spark, sf_dir).impact(_regions(spark, sf_dir), directions=("downstream",)).select("target", "node")


def impact_fk_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shop(spark, sf_dir).impact(_regions(spark, sf_dir), ["FK"], ("downstream",)).select("target", "node")


def impact_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _read(spark, sf_dir, "customer").select(F.lit("shop").alias("script_id"), _say("w_%1$s", "c_custkey").alias("target"))
    return _shop(spark, sf_dir).impact(views, directions=("upstream",)).select("target", "node")


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _shop(spark, sf_dir)
    return graph.levels(a.objects, a.edges).select("name", "level")


def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shop(spark, sf_dir).topological_order().select("position", "name")


def object_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shop(spark, sf_dir).stats


def _rings(spark: SparkSession, sf_dir: str) -> Analysis:
    """A view of each part, on the next one; of each ten, those at 5 to 8 form a ring."""
    ring = F.expr("CASE WHEN p_partkey % 10 = 8 THEN p_partkey - 3 ELSE p_partkey + 1 END")
    return analyze(_scripts(_read(spark, sf_dir, "part"), F.expr("p_partkey div 50"), F.format_string("CREATE VIEW p_%1$s AS SELECT 1 FROM p_%2$s;", F.col("p_partkey"), ring)))


def cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).cyclic.select("script_id", "node")


def cycles_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).cycles().select("script_id", F.array_join("path", " ").alias("path"))


def layer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _shop(spark, sf_dir)
    return graph.layer_levels(a.objects, a.edges.select("script_id", "edge_seq", F.col("target").alias("from"), F.col("source").alias("to"))).select("name", "level")


def layer_levels_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of views that form rings, and of the views of other scripts that they read: the link that closes a ring is left out."""
    a = _rings(spark, sf_dir)
    return graph.layer_levels(a.objects, a.edges.select("script_id", "edge_seq", F.col("target").alias("from"), F.col("source").alias("to"))).select("script_id", "name", "level")


def _spread(spark: SparkSession, sf_dir: str) -> Project:
    """Tables, views on them, and routines that return their rows or copy them, each kind in scripts of its own."""
    rows = _read(spark, sf_dir, "customer")
    forms = {
        "a": "CREATE TABLE c_%1$s (id BIGINT PRIMARY KEY, n INT NOT NULL REFERENCES n_%2$s (id), note TEXT UNIQUE);",
        "b": "CREATE VIEW v_%1$s AS SELECT c.*, n AS nation, count(*) AS k FROM c_%1$s c;",
        "c": "CREATE FUNCTION f_%1$s() RETURNS SETOF c_%1$s AS $$ INSERT INTO v_%1$s (id, k) SELECT id, n FROM c_%1$s $$; CREATE VIEW w_%1$s AS SELECT nation, f.note FROM v_%1$s JOIN f_%1$s f ON TRUE;",
    }
    made = [rows.select(F.concat(F.lit(k), F.expr("c_custkey div 50").cast("string")).alias("s"), _say(form, "c_custkey", "c_nationkey").alias("d")) for k, form in forms.items()]
    return Project(_scripts(reduce(DataFrame.unionByName, made), F.col("s"), F.col("d")), "spread")


def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir).columns.select("script_id", "name", F.col("ordinal").cast("bigint").alias("ordinal"), "column", "data_type", "nullable", "pk", "unique", "fk_to")


def project_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _spread(spark, sf_dir)
    flows = a.flows.select("script_id", "source", F.lit("").alias("src_col"), "target", F.lit("").alias("tgt_col"), "via")
    return flows.unionByName(a.column_lineage.select("script_id", F.col("src_table").alias("source"), "src_col", F.col("tgt_table").alias("target"), "tgt_col", "via"))


def dump_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One script of all orders, cut in blocks wherever a block is full."""
    rows = _read(spark, sf_dir, "orders")
    forms = (
        "CREATE TABLE o_%1$s ( -- it's; one", "  id INT REFERENCES c_%2$s, note TEXT DEFAULT 'a;", "b('' );');",
        "CREATE FUNCTION f_%1$s() RETURNS void AS $$ BEGIN", "  INSERT INTO o_%1$s (id) SELECT id FROM c_%2$s; /* not;", "  yet */ END $$;",
    )
    lines = rows.select(F.lit("dump").alias("script_id"), F.col("o_orderkey").cast("bigint").alias("k"), F.posexplode(F.array(*[_say(f, "o_orderkey", "o_custkey") for f in forms])).alias("i", "line"))
    blocks = splitting.line_blocks(lines.select("script_id", (F.col("k") * len(forms) + F.col("i")).alias("at"), "line"), size=1 << 17)
    return Dump(blocks).edges.select("script_id", "source", "target", "edge_type", "details")


def live_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' definitions, made in databases of 1000 customers each, read from their catalogs and analysed."""
    folder = storage.mounted_dir(spark)
    rows = _read(spark, sf_dir, "customer").select(F.expr("concat('shop', c_custkey div 1000)").alias("database"), _say("CREATE TABLE c_%1$s (id INTEGER PRIMARY KEY, nation_id INT NOT NULL REFERENCES nation_%2$s (id)); CREATE VIEW w_%1$s AS SELECT id FROM c_%1$s;", "c_custkey", "c_nationkey").alias("ddl"))

    def make(table: pa.Table) -> pa.Table:
        """One database, as a file that no other attempt of the task touches."""
        path = f"{folder}/catalog-{uuid.uuid4().hex}.db"
        with closing(sqlite3.connect(path)) as db:
            db.executescript("BEGIN; " + "".join(table.column("ddl").to_pylist()) + " COMMIT;")  # written once, not statement by statement
        return pa.table({"database": table.column("database")[:1], "path": [path]})

    made = storage.stored(rows.repartition(storage.tasks(spark), "database").groupBy("database").applyInArrow(make, "database string, path string"))
    source = DbApi("sqlite3", {r["database"]: {"database": r["path"]} for r in made.collect()})  # a row per database
    return analyze(connector("sqlite").scripts(spark, source, "main")).edges.select("script_id", "source", "target", "edge_type", "details")


def _versions(spark: SparkSession, sf_dir: str) -> list[Analysis]:
    """Two versions of the suppliers' tables; each refers elsewhere for some of them, and the new one renames some."""
    rows = _read(spark, sf_dir, "supplier")
    old = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'o' ELSE 'n' END")
    new = F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'q' ELSE 'n' END")
    name = F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 't' ELSE 's' END")
    forms = (F.format_string("CREATE TABLE %1$s_%2$s (id INT, n INT REFERENCES %3$s_%4$s);", x, F.col("s_suppkey"), y, F.col("s_nationkey")) for x, y in ((F.lit("s"), old), (name, new)))
    return [analyze(_scripts(rows, F.expr("s_suppkey div 50"), form)) for form in forms]


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.edge_diff(*[a.edges for a in _versions(spark, sf_dir)])


def object_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.object_diff(*[a.objects.join(a.columns.groupBy("script_id", "name").agg(F.count("*").alias("n_columns")), ["script_id", "name"], "left").fillna(0, ["n_columns"]) for a in _versions(spark, sf_dir)]).fillna(-1, ["old_columns", "new_columns"])


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_counts(version_diff(spark, sf_dir))


def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.merged(*[(a.objects, a.edges) for a in _versions(spark, sf_dir)])[0].select("name", "type")


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.merged(*[(a.objects, a.edges) for a in _versions(spark, sf_dir)])[1].select("source", "target", "edge_type", "details")


def render_mermaid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyze(_customers(spark, sf_dir, "CREATE TABLE c_%1$s (id INT, n INT REFERENCES nation_%2$s);"))
    return render.mermaid_links(a.edges).select("script_id", "line")


def render_mermaid_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyze(_customers(spark, sf_dir, "CREATE TABLE c_%1$s (id INT, n INT REFERENCES nation_%2$s);"))
    return render.to_mermaid(a).select("script_id", "mermaid")


def history_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    saves = e.select(F.col("user_id").cast("string").alias("project"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "update").otherwise("analysis").alias("action"), F.col("event_type").alias("ddl"))
    return history.history(saves).select("project", "seq", "action", "ddl")


def history_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves with their states in a project store, and each project's history with the statistics in its states."""
    e = _read(spark, sf_dir, "events")
    stats = F.struct(F.col("user_id").alias("total_objects"), (F.col("event_id") % 7).alias("total_edges"), (F.col("event_id") % 2 == 0).alias("has_cycles"))
    state = F.when(F.col("event_type") == "error", F.lit("{}")).otherwise(F.to_json(F.struct(stats.alias("stats"))))
    saves = e.select(F.col("user_id").cast("string").alias("project"), F.col("event_id").cast("bigint").alias("seq"), F.when(F.col("event_type") == "view", "update").otherwise("analysis").alias("action"), F.col("event_type").alias("ddl"), state.alias("state"))
    store = history.Projects(spark, f"{storage.shared_dir(spark)}/projects-{uuid.uuid4().hex}")
    store.save(saves)
    return history.history_list(store.saves.read()).fillna(-1, ["total_objects", "total_edges"]).fillna({"has_cycles": False})


QUERIES = (
    fk_edges_inline, fk_edges_alter, fk_composite, columns_parsed, columns_altered, view_reads, reads_comma_cte, routine_edges, routine_flows, column_mapping, routine_objects, lineage_view, function_groups, statement_counts,
    derived_types, impact_downstream, impact_upstream, impact_fk_only, topo_levels, topo_order, layer_levels, layer_levels_rings, object_stats, cyclic_nodes, cycles_listed, version_diff, object_diff, diff_counts, merged_results, merged_edges, render_mermaid_edges, render_mermaid_whole, history_dedupe, project_columns, project_flows, live_catalog, dump_edges, history_states,
)

_SHOP_LINKS = """
  SELECT 'n_' || n_nationkey AS a, 'r_' || n_regionkey AS b, 'FK' AS k FROM nation
  UNION SELECT 'c_' || c_custkey, 'n_' || c_nationkey, 'FK' FROM customer
  UNION SELECT 'w_' || c_custkey, 'c_' || c_custkey, 'READ' FROM customer
  UNION SELECT 'w_' || c_custkey, 'n_' || c_nationkey, 'READ' FROM customer"""
_DOWN = """WITH RECURSIVE links AS ({links}), reach AS (
  SELECT 'r_' || r_regionkey AS target, 'r_' || r_regionkey AS node FROM region
  UNION SELECT reach.target, a FROM reach JOIN links ON b = node {where})
SELECT target, node FROM reach WHERE node <> target"""
_SHOP_LEVELS = """SELECT DISTINCT 'r_' || n_regionkey AS name, CAST(0 AS BIGINT) AS level FROM nation
UNION ALL SELECT 'n_' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'c_' || c_custkey, 2 FROM customer
UNION ALL SELECT 'w_' || c_custkey, 3 FROM customer"""
_VERSIONS = """WITH v AS (
  SELECT CAST(s_suppkey // 50 AS VARCHAR) AS script_id, s_suppkey AS s, 's_' || s_suppkey AS old_name, CASE WHEN s_suppkey % 7 = 0 THEN 't_' ELSE 's_' END || s_suppkey AS new_name,
    CASE WHEN s_suppkey % 3 = 0 THEN 'o_' ELSE 'n_' END || s_nationkey AS old_to, CASE WHEN s_suppkey % 5 = 0 THEN 'q_' ELSE 'n_' END || s_nationkey AS new_to FROM supplier)"""
_EDGE_DIFF = _VERSIONS + """, a AS (SELECT script_id, old_name || '→' || old_to || '::FK' AS key FROM v), b AS (SELECT script_id, new_name || '→' || new_to || '::FK' AS key FROM v),
d AS (SELECT script_id, key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (script_id, key))"""
_EVENT = "SELECT CAST(event_id // 50 AS VARCHAR) AS script_id, 'f_' || event_id AS f, event_id AS e, user_id AS u, event_type AS k FROM events"

ORACLE_SQL = {
    "fk_edges_inline": "SELECT CAST(c_custkey // 50 AS VARCHAR) AS script_id, 'c_' || c_custkey AS source, 'nation_' || c_nationkey AS target, 'FK' AS edge_type, 'nation_id -> nation_' || c_nationkey || '.id' AS details FROM customer",
    "fk_edges_alter": "SELECT CAST(c_custkey // 50 AS VARCHAR) AS script_id, 'c_' || c_custkey AS source, 'nation_' || c_nationkey AS target, 'FK' AS edge_type, 'nation_id -> nation_' || c_nationkey || '.id, part -> nation_' || c_nationkey || '.part' AS details FROM customer",
    "columns_altered": """SELECT CAST(c_custkey // 50 AS VARCHAR) AS script_id, 'c_' || c_custkey AS name, unnest(['id', 'nation_id']) AS "column", unnest([NULL, 'nation_' || c_nationkey || '.code']) AS fk_to FROM customer""",
    "fk_composite": "SELECT DISTINCT CAST(l_orderkey // 50 AS VARCHAR) AS script_id, 'ret_' || l_orderkey AS source, 'items_' || l_orderkey AS target, 'order_id -> items_' || l_orderkey || '.order_id, line_no -> items_' || l_orderkey || '.line_no' AS details FROM lineitem",
    "columns_parsed": """SELECT CAST(p_partkey // 50 AS VARCHAR) AS script_id, 'part_' || p_partkey AS name, CAST(o AS BIGINT) AS ordinal,
  CASE o WHEN 0 THEN 'id' WHEN 1 THEN 'brand' WHEN 2 THEN 'price' WHEN 3 THEN 'size_' || p_size ELSE 'owner_id' END AS "column",
  CASE o WHEN 0 THEN 'SERIAL' WHEN 1 THEN 'VARCHAR(10)' WHEN 2 THEN 'NUMERIC(10,2)' WHEN 3 THEN 'INTEGER' ELSE 'INT' END AS data_type,
  o >= 2 AS nullable, o < 2 AS pk, o = 2 AS "unique", CASE WHEN o = 4 THEN 'owners.id' END AS fk_to, CASE WHEN o = 1 THEN p_brand END AS "default"
FROM part, range(5) AS r(o)""",
    "view_reads": """SELECT CAST(o_orderkey // 50 AS VARCHAR) AS script_id, 'v_' || o_orderkey AS source, 'customer_' || o_custkey AS target, 'READ' AS edge_type FROM orders
UNION SELECT CAST(o_orderkey // 50 AS VARCHAR), 'v_' || o_orderkey, 'nowhere', 'READ' FROM orders -- literals are read like the rest
UNION SELECT CAST(o_orderkey // 50 AS VARCHAR), 'v_' || o_orderkey, 'part_' || l_partkey, 'READ' FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "reads_comma_cte": """SELECT CAST(o_orderkey // 50 AS VARCHAR) AS script_id, 'v_' || o_orderkey AS source, unnest(['orders_' || o_orderkey, 'cust_' || o_custkey, 'b_' || o_orderkey, 'd_' || o_orderkey]) AS target FROM orders""",
    "routine_edges": f"""WITH e AS ({_EVENT})
SELECT script_id, f AS source, 'sales_' || e AS target, 'WRITE' AS edge_type, 'INSERT' AS details FROM e WHERE k = 'purchase'
UNION ALL SELECT script_id, f, 'carts_' || u, 'READ', '' FROM e WHERE k = 'purchase'
UNION ALL SELECT script_id, f, 'users_' || u, 'WRITE', 'UPDATE' FROM e WHERE k = 'click'
UNION ALL SELECT script_id, f, 'clicks_' || e, 'READ', '' FROM e WHERE k = 'click'
UNION ALL SELECT script_id, f, 'queue_' || e, 'WRITE', 'DELETE' FROM e WHERE k = 'error'
UNION ALL SELECT script_id, f, 'queue_' || e, 'READ', '' FROM e WHERE k = 'error'
UNION ALL SELECT script_id, f, 'pages_' || e, 'READ', '' FROM e WHERE k = 'view'
UNION ALL SELECT script_id, f, 'fresh_' || e, 'WRITE', 'CREATE' FROM e WHERE k = 'signup'
UNION ALL SELECT script_id, f, 'users_' || u, 'READ', '' FROM e WHERE k = 'signup'""",
    "routine_flows": f"""WITH e AS ({_EVENT})
SELECT script_id, 'carts_' || u AS source, 'sales_' || e AS target, 'WRITE' AS edge_type, f AS via, 'INSERT' AS details FROM e WHERE k = 'purchase'
UNION ALL SELECT script_id, 'clicks_' || e, 'users_' || u, 'WRITE', f, 'UPDATE' FROM e WHERE k = 'click'
UNION ALL SELECT script_id, f, 'queue_' || e, 'WRITE', f, 'DELETE' FROM e WHERE k = 'error'
UNION ALL SELECT script_id, 'pages_' || e, f, 'READ', f, '' FROM e WHERE k = 'view'
UNION ALL SELECT script_id, 'users_' || u, 'fresh_' || e, 'WRITE', f, 'CREATE' FROM e WHERE k = 'signup'""",
    "column_mapping": f"""WITH e AS ({_EVENT})
SELECT script_id, CAST(p AS BIGINT) AS pos, 'carts_' || u AS src_table, CASE p WHEN 0 THEN 'user_id' ELSE 'value' END AS src_col, 'sales_' || e AS tgt_table, CASE p WHEN 0 THEN 'user_id' ELSE 'total' END AS tgt_col, f AS via FROM e, range(2) AS r(p) WHERE k = 'purchase'""",
    "routine_objects": f"""WITH e AS ({_EVENT})
SELECT script_id, f AS name, 'FUNCTION' AS type, FALSE AS temporary, CAST(NULL AS VARCHAR) AS parent FROM e
UNION ALL SELECT script_id, 'fresh_' || e, 'TABLE', TRUE, f FROM e WHERE k = 'signup'
UNION ALL SELECT DISTINCT script_id, t, 'TABLE', FALSE, NULL FROM (
  SELECT script_id, unnest(CASE k WHEN 'purchase' THEN ['sales_' || e, 'carts_' || u] WHEN 'click' THEN ['users_' || u, 'clicks_' || e] WHEN 'error' THEN ['queue_' || e] WHEN 'view' THEN ['pages_' || e] ELSE ['users_' || u] END) AS t FROM e)""",
    "lineage_view": f"""WITH e AS ({_EVENT})
SELECT DISTINCT script_id, 'carts_' || u AS "from", 'sales_' || e AS "to", 'WRITE' AS type, 'INSERT' AS details FROM e WHERE k = 'purchase'
UNION ALL SELECT script_id, 'clicks_' || e, 'users_' || u, 'WRITE', 'UPDATE' FROM e WHERE k = 'click'
UNION ALL SELECT script_id, f, 'queue_' || e, 'WRITE', 'DELETE' FROM e WHERE k = 'error'
UNION ALL SELECT script_id, 'pages_' || e, f, 'READ', '' FROM e WHERE k = 'view'
UNION ALL SELECT script_id, 'users_' || u, 'fresh_' || e, 'WRITE', 'CREATE' FROM e WHERE k = 'signup'""",
    "function_groups": f"WITH e AS ({_EVENT}) SELECT script_id, f AS owner, f || ',' || 'fresh_' || e AS members FROM e WHERE k = 'signup'",
    "statement_counts": "SELECT CAST(s_suppkey // 5 AS VARCHAR) AS script_id, 4 * count(*) AS n_statements FROM supplier GROUP BY 1",
    "derived_types": """SELECT CAST(s_suppkey AS VARCHAR) AS script_id, v || s_suppkey AS name, CAST(o AS BIGINT) AS ordinal, c AS "column", replace(t, '?', CAST(s_nationkey + 1 AS VARCHAR)) AS data_type FROM supplier, (VALUES
  ('v_', 1, 'id', 'BIGINT'), ('v_', 2, 'nation', 'INT'), ('v_', 3, 'label', 'VARCHAR(?)'), ('v_', 4, 'tag', 'VARCHAR(?)'), ('v_', 5, 'n', ''), ('v_', 6, '1', ''),
  ('w_', 1, 'tag', 'VARCHAR(?)'), ('w_', 2, 'id', 'BIGINT'), ('w_', 3, 'nothing', ''),
  ('x_', 1, 'id', 'BIGINT'), ('x_', 2, 'id_2', 'INT'), ('x_', 3, 'mail', 'TEXT'),
  ('y_', 1, 'id', 'INT'), ('y_', 2, 'mail', 'TEXT'), ('y_', 3, 'id_3', 'INT'), ('y_', 4, 'mail_4', 'TEXT'), ('z_', 1, 'column_1', ''),
  ('f_', 1, 'id', 'BIGINT'), ('f_', 2, 'id_2', 'INT'), ('f_', 3, 'mail', 'TEXT'), ('c_', 1, 'tag', 'VARCHAR(?)'), ('c_', 2, 'mail', 'TEXT')) AS x(v, o, c, t)""",
    "impact_downstream": _DOWN.format(links=_SHOP_LINKS, where=""),
    "impact_fk_only": _DOWN.format(links=_SHOP_LINKS, where="AND k = 'FK'"),
    "impact_upstream": f"""WITH RECURSIVE links AS ({_SHOP_LINKS}), reach AS (
  SELECT 'w_' || c_custkey AS target, 'w_' || c_custkey AS node FROM customer
  UNION SELECT target, b FROM reach JOIN links ON a = node)
SELECT target, node FROM reach WHERE node <> target""",
    "topo_levels": _SHOP_LEVELS,
    "layer_levels": _SHOP_LEVELS,
    "layer_levels_rings": """WITH RECURSIVE links AS (
        SELECT p_partkey // 50 AS s, CASE WHEN p_partkey % 10 = 8 THEN p_partkey - 3 ELSE p_partkey + 1 END AS a, p_partkey AS b FROM part),
      ahead AS (SELECT * FROM links WHERE NOT (b % 10 = 5 AND b + 3 IN (SELECT p_partkey FROM part))),
      paths AS (SELECT s, unnest([a, b]) AS k, 0 AS n FROM links UNION SELECT s, b, n + 1 FROM paths JOIN ahead USING (s) WHERE a = k)
      SELECT CAST(s AS VARCHAR) AS script_id, 'p_' || k AS name, CAST(max(n) AS BIGINT) AS level FROM paths GROUP BY s, k""",
    "topo_order": """WITH r AS (
  SELECT 'r_' || n_regionkey AS name, row_number() OVER (ORDER BY min('n_' || n_nationkey || ' ')) AS position FROM nation GROUP BY n_regionkey
), n AS (
  SELECT 'n_' || n_nationkey AS name, (SELECT count(*) FROM r) + row_number() OVER (ORDER BY position, 'n_' || n_nationkey) AS position FROM nation JOIN r ON r.name = 'r_' || n_regionkey
), c AS (
  SELECT 'c_' || c_custkey AS name, (SELECT max(position) FROM n) + row_number() OVER (ORDER BY position, 'c_' || c_custkey) AS position FROM customer JOIN n ON n.name = 'n_' || c_nationkey
), w AS (
  SELECT 'w_' || c_custkey AS name, (SELECT max(position) FROM c) + row_number() OVER (ORDER BY position) AS position FROM customer JOIN c ON c.name = 'c_' || c_custkey
) SELECT position, name FROM r UNION ALL SELECT position, name FROM n UNION ALL SELECT position, name FROM c UNION ALL SELECT position, name FROM w""",
    "object_stats": """SELECT 'shop' AS script_id, (SELECT count(DISTINCT n_regionkey) + count(*) FROM nation) + 2 * count(*) AS total_objects, (SELECT count(*) FROM nation) + 3 * count(*) AS total_edges, FALSE AS has_cycles FROM customer""",
    "cyclic_nodes": "SELECT CAST(p_partkey // 50 AS VARCHAR) AS script_id, 'p_' || p_partkey AS node FROM part WHERE p_partkey % 10 BETWEEN 5 AND 8",
    "cycles_listed": """SELECT CAST(p // 50 AS VARCHAR) AS script_id, array_to_string(list_concat(list_slice(x, k, 4), list_slice(x, 1, k - 1), [x[k]]), ' ') AS path FROM (
  SELECT p, x, list_position(x, list_min(x)) AS k FROM (SELECT p_partkey AS p, ['p_' || p_partkey, 'p_' || (p_partkey + 1), 'p_' || (p_partkey + 2), 'p_' || (p_partkey + 3)] AS x FROM part WHERE p_partkey % 10 = 5))""",
    "project_columns": """SELECT 'spread' AS script_id, v || c_custkey AS name, CAST(o AS BIGINT) AS ordinal, c AS "column", t AS data_type, nul AS nullable, pk, uq AS "unique", CASE WHEN fk THEN 'n_' || c_nationkey || '.id' END AS fk_to FROM customer, (VALUES
  ('c_', 0, 'id', 'BIGINT', FALSE, TRUE, FALSE, FALSE), ('c_', 1, 'n', 'INT', FALSE, FALSE, FALSE, TRUE), ('c_', 2, 'note', 'TEXT', TRUE, FALSE, TRUE, FALSE),
  ('v_', 1, 'id', 'BIGINT', TRUE, FALSE, FALSE, FALSE), ('v_', 2, 'n', 'INT', TRUE, FALSE, FALSE, FALSE), ('v_', 3, 'note', 'TEXT', TRUE, FALSE, FALSE, FALSE), ('v_', 4, 'nation', 'INT', TRUE, FALSE, FALSE, FALSE), ('v_', 5, 'k', '', TRUE, FALSE, FALSE, FALSE),
  ('f_', 1, 'id', 'BIGINT', FALSE, TRUE, FALSE, FALSE), ('f_', 2, 'n', 'INT', FALSE, FALSE, FALSE, TRUE), ('f_', 3, 'note', 'TEXT', TRUE, FALSE, TRUE, FALSE),
  ('w_', 1, 'nation', 'INT', TRUE, FALSE, FALSE, FALSE), ('w_', 2, 'note', 'TEXT', TRUE, FALSE, FALSE, FALSE)) AS x(v, o, c, t, nul, pk, uq, fk)""",
    "project_flows": """SELECT 'spread' AS script_id, 'c_' || c_custkey AS source, s AS src_col, 'v_' || c_custkey AS target, t AS tgt_col, 'f_' || c_custkey AS via FROM customer, (VALUES ('', ''), ('id', 'id'), ('n', 'k')) AS x(s, t)""",
    "dump_edges": """SELECT 'dump' AS script_id, 'o_' || o_orderkey AS source, 'c_' || o_custkey AS target, 'FK' AS edge_type, 'id -> c_' || o_custkey || '.id' AS details FROM orders
UNION ALL SELECT 'dump', 'f_' || o_orderkey, 'o_' || o_orderkey, 'WRITE', 'INSERT' FROM orders UNION ALL SELECT 'dump', 'f_' || o_orderkey, 'c_' || o_custkey, 'READ', '' FROM orders""",
    "live_catalog": """SELECT 'shop' || (c_custkey // 1000) AS script_id, 'c_' || c_custkey AS source, 'nation_' || c_nationkey AS target, 'FK' AS edge_type, 'nation_id -> nation_' || c_nationkey || '.id' AS details FROM customer
UNION ALL SELECT 'shop' || (c_custkey // 1000), 'w_' || c_custkey, 'c_' || c_custkey, 'READ', '' FROM customer""",
    "version_diff": _EDGE_DIFF + " SELECT script_id, key, status FROM d",
    "diff_counts": _EDGE_DIFF + " SELECT script_id, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM d GROUP BY script_id",
    "object_diff": _VERSIONS + """, a AS (SELECT DISTINCT script_id, unnest(['TABLE::::' || old_name, 'TABLE::::' || old_to]) AS key, unnest([2, 0]) AS n FROM v), b AS (SELECT DISTINCT script_id, unnest(['TABLE::::' || new_name, 'TABLE::::' || new_to]) AS key, unnest([2, 0]) AS n FROM v)
SELECT script_id, key, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'unchanged' END AS status, CAST(coalesce(a.n, -1) AS BIGINT) AS old_columns, CAST(coalesce(b.n, -1) AS BIGINT) AS new_columns FROM a FULL JOIN b USING (script_id, key)""",
    "merged_results": _VERSIONS + " SELECT DISTINCT unnest([old_name, new_name, old_to, new_to]) AS name, 'TABLE' AS type FROM v",
    "merged_edges": _VERSIONS + " SELECT DISTINCT s AS source, t AS target, 'FK' AS edge_type, 'n -> ' || t || '.id' AS details FROM (SELECT unnest([old_name, new_name]) AS s, unnest([old_to, new_to]) AS t FROM v)",
    "render_mermaid_edges": "SELECT CAST(c_custkey // 50 AS VARCHAR) AS script_id, '  c_' || c_custkey || ' -->|\"FK (n -> nation_' || c_nationkey || '.id)\"| nation_' || c_nationkey AS line FROM customer",
    "render_mermaid_whole": """WITH c AS (SELECT CAST(c_custkey // 50 AS VARCHAR) AS script_id, 'c_' || c_custkey AS name, 'nation_' || c_nationkey AS ref, 'CREATE TABLE c_' || c_custkey || ' (' AS stmt FROM customer),
lines AS (
  SELECT DISTINCT script_id, 0 AS section, '' AS key, 'graph LR' AS line FROM c
  UNION ALL SELECT DISTINCT script_id, 1, name, '  ' || name || '["' || name || '<br/>TABLE"]' FROM (SELECT script_id, unnest([name, ref]) AS name FROM c)
  UNION ALL SELECT script_id, 2, stmt, '  ' || name || ' -->|"FK (n -> ' || ref || '.id)"| ' || ref FROM c)
SELECT script_id, string_agg(line, chr(10) ORDER BY section, key) AS mermaid FROM lines GROUP BY script_id""",
    "history_states": """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS project, CAST(event_id AS BIGINT) AS seq, CASE WHEN event_type = 'view' THEN 'update' ELSE 'analysis' END AS action, event_type AS ddl, event_type <> 'error' AS known, CAST(user_id AS BIGINT) AS u FROM events),
p AS (SELECT *, lag(ddl) OVER (PARTITION BY project, action ORDER BY seq) AS before FROM s)
SELECT project, seq, action, CASE WHEN known THEN u ELSE -1 END AS total_objects, CASE WHEN known THEN seq % 7 ELSE -1 END AS total_edges, known AND seq % 2 = 0 AS has_cycles FROM p WHERE NOT (action = 'analysis' AND before IS NOT NULL AND before = ddl)""",
    "history_dedupe": """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS project, event_id AS seq, CASE WHEN event_type = 'view' THEN 'update' ELSE 'analysis' END AS action, event_type AS ddl FROM events),
p AS (SELECT *, lag(ddl) OVER (PARTITION BY project, action ORDER BY seq) AS before FROM s)
SELECT project, seq, action, ddl FROM p WHERE NOT (action = 'analysis' AND before IS NOT NULL AND before = ddl)""",
}
