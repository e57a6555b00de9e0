"""Catalogs of running databases: SQLite through DB-API, Derby through JDBC."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, Not
from pyspark.sql.types import StructType

from schemaweave.plans.analysis import analyze
from schemaweave.sources import live
from schemaweave.sources.catalog import SHAPES, connector

DDL = """CREATE TABLE users (id INTEGER PRIMARY KEY, mail TEXT NOT NULL DEFAULT 'x''y');
CREATE TABLE "Odd Name" (a INT, b INT, PRIMARY KEY (a, b));
CREATE TABLE orders (id INTEGER PRIMARY KEY, user_id INT REFERENCES users (id), a INT, b INT, FOREIGN KEY (a, b) REFERENCES "Odd Name" (a, b));
CREATE VIEW big AS SELECT o.id, u.mail FROM orders o JOIN users u ON u.id = o.user_id;"""


@pytest.fixture
def databases(tmp_path):
    paths = {}
    for name, ddl in (("one", DDL), ("two", DDL.replace("orders", "sales")), ("none", "")):
        paths[name] = {"database": str(tmp_path / f"{name}.db")}
        with sqlite3.connect(**paths[name]) as db:
            db.executescript(ddl)
    return live.DbApi("sqlite3", paths, partitions=3)


def test_each_database_is_a_script(spark, databases):
    scripts = connector("sqlite").scripts(spark, databases, "main")
    a = analyze(scripts)
    edges = {(e.script_id, e.source, e.target, e.edge_type) for e in a.edges.collect()}
    assert edges == {(s, x, y, k) for s, t in (("one", "orders"), ("two", "sales")) for x, y, k in ((t, "users", "FK"), (t, "odd name", "FK"), ("big", t, "READ"), ("big", "users", "READ"))}
    columns = {(c.script_id, c.name, c.column): c for c in a.columns.collect()}
    assert columns["one", "users", "mail"].default == "x''y" and not columns["one", "users", "mail"].nullable and columns["one", "users", "id"].pk
    assert columns["two", "sales", "user_id"].fk_to == "users.id" and columns["two", "big", "mail"].data_type == "TEXT"


def test_schema_objects_and_databases_are_pushed(spark, databases):
    c = connector("sqlite")
    some = c.read(spark, databases, "columns", "main", ["users"]).where("database = 'two'")
    assert {(r.database, r.owner) for r in some.collect()} == {("two", "users")}
    plan = some._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    assert plan.metrics().apply("numOutputRows").value() == 2, plan  # the source gave no others
    assert c.scripts(spark, databases, "main", ["users"]).where("script_id = 'one'").first().ddl.count("CREATE") == 1
    assert c.scripts(spark, databases, "elsewhere").count() == 0


def test_filters_of_a_reader():
    options = {"module": "sqlite3", "databases": '{"a": {}, "b": {}}', "query": "SELECT 1 AS name", "shard": "q.oid % {n} = {i}", "partitions": "2"}
    reader = live.DbApiReader(options, StructType.fromDDL("database string, name string, oid bigint"))
    rest = list(reader.pushFilters([EqualTo(("database",), "b"), In(("name",), ("x", "y")), IsNotNull(("name",)), Not(EqualTo(("name",), "z"))]))
    assert len(rest) == 4  # Spark tests them again
    assert [(s.database, s.i) for s in reader.partitions()] == [("b", 0), ("b", 1)]
    assert reader.statement(live.Share("b", 1), "qmark") == ("SELECT q.name, q.oid FROM (SELECT 1 AS name) q WHERE (q.oid % 2 = 1) AND q.name IN (?, ?) AND q.name IS NOT NULL", ["x", "y"])
    assert reader.statement(live.Share("b", 1), "pyformat")[0].endswith("(q.oid %% 2 = 1) AND q.name IN (%s, %s) AND q.name IS NOT NULL")
    assert reader.statement(live.Share("b", 1), "named")[1] == {"p1": "x", "p2": "y"}


def test_many_databases_share_tasks(spark, databases):
    """A task reads several databases if there are many, each in fewer shares, and nothing is left out; their scripts are read by many tasks."""
    options = {"module": "sqlite3", "databases": '{"a": {}, "b": {}, "c": {}, "d": {}, "e": {}}', "query": "SELECT 1 AS name", "shard": "q.oid % {n} = {i}", "partitions": "4", "tasks": "3"}
    reader = live.DbApiReader(options, StructType.fromDDL("database string, name string"))
    parts = reader.partitions()
    assert len(parts) == 3 and sorted((s.database, s.i) for p in parts for s in (p, *p.then)) == [(d, 0) for d in "abcde"]
    assert "q.oid % 1 = 0" in reader.statement(parts[0], "qmark")[0]
    shape = StructType.fromDDL("database string, name string, oid bigint")
    query = "SELECT rowid AS oid, name FROM sqlite_master WHERE type <> 'index'"
    for tasks in ("1", "2", "5", "99"):
        reader = live.DbApiReader({**options, "databases": json.dumps(databases.databases), "query": query, "tasks": tasks}, shape)
        parts = reader.partitions()
        rows = sorted(r[:2] for p in parts for r in reader.read(p))
        assert rows == sorted((d, x) for d, t in (("one", "orders"), ("two", "sales")) for x in ("users", "Odd Name", t, "big")) and len(parts) <= int(tasks)
    assert connector("sqlite").scripts(spark, databases, "main").rdd.getNumPartitions() >= 4


def test_a_statement_for_each_object(spark, databases):
    """As SHOW CREATE: each listed object's statement is run where it was listed; what fails has no definition."""
    query = "SELECT rowid AS oid, 'main' AS schema, name, upper(type) AS kind, CASE WHEN name = 'users' THEN 'SELECT broken' ELSE 'SELECT 1, sql AS \"Create Table\", 2 FROM sqlite_master WHERE name = ''' || name || '''' END AS definition FROM sqlite_master WHERE type <> 'index'"
    rows = databases.load(spark, query, "oid bigint, " + SHAPES["definitions"], "q.oid % {n} = {i}", follow="definition")
    got = {(r.database, r.name): r.definition for r in rows.collect()}
    assert got["one", "users"] is None and got["two", "sales"].startswith("CREATE TABLE sales") and len(got) == 8
    mysql = connector("mysql").statements(*[rows.where(k).select("database", "schema", "name", "kind") for k in ("true", "false")], rows.select("database", "schema", "name", "kind", "definition"), "main")
    assert [r.seq for r in mysql.where("database = 'one'").orderBy("section", "seq").collect()] == ["Odd Name", "orders", "big"]


def test_postgres_and_mysql_queries_have_their_shapes(spark):
    for kind in ("postgresql", "mysql"):
        c = connector(kind)
        for relation, query in c.catalog.items():
            assert all(f.name in query for f in StructType.fromDDL(SHAPES[relation]).fields)
    with pytest.raises(ValueError, match="DB-API"):
        live.Jdbc("x", {"a": "jdbc:x"}).load(spark, "q", "a int", follow="a")


def test_catalog_over_jdbc(spark, tmp_path):
    """Derby's jar comes with Spark; its catalog stands for any that JDBC reaches."""
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    jvm = spark._jvm
    jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    db = jvm.java.sql.DriverManager.getConnection(url)
    for x in ("CREATE TABLE users (id INT NOT NULL PRIMARY KEY)", "CREATE VIEW v1 AS SELECT id FROM users", "CREATE SCHEMA other", "CREATE VIEW other.v2 AS SELECT id FROM app.users"):
        db.createStatement().execute(x)
    query = "SELECT 1 AS oid, s.schemaname AS \"schema\", t.tablename AS name, 'v' AS kind, CAST(v.viewdefinition AS VARCHAR(32000)) AS definition, FALSE AS from_extension FROM sys.sysviews v JOIN sys.systables t ON t.tableid = v.tableid JOIN sys.sysschemas s ON s.schemaid = t.schemaid"
    rows = live.Jdbc("org.apache.derby.jdbc.EmbeddedDriver", {"d": url}).load(spark, query, SHAPES["views"]).where("schema = 'OTHER'")
    assert [(r.database, r.name, r.from_extension) for r in rows.collect()] == [("d", "V2", False)] and "CREATE VIEW" in rows.first().definition
    pushed = rows._jdf.queryExecution().executedPlan().toString().partition("PushedFilters: [")[2].partition("]")[0]
    assert "EqualTo(schema,OTHER)" in pushed
    db.close()
