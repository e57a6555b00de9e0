import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from schemaweave import cli
from schemaweave.operators import compare, graph, history, render
from schemaweave.plans.analysis import Project, analyze
from schemaweave.sources import catalog
from schemaweave.sources.scripts import from_text, read_scripts, write_json, write_text
from schemaweave.streaming.scripts import stream_scripts, write_edges

LIBRARY = """
CREATE TABLE members (id SERIAL PRIMARY KEY, card VARCHAR(40) NOT NULL UNIQUE); -- readers; all
CREATE TABLE loans (id SERIAL PRIMARY KEY, member_id INTEGER NOT NULL REFERENCES members(id), state VARCHAR(20) DEFAULT 'open');
CREATE TABLE loan_books (id SERIAL PRIMARY KEY, loan_id INTEGER NOT NULL REFERENCES loans(id), book INTEGER NOT NULL, days INTEGER NOT NULL);
CREATE TABLE fines (id SERIAL PRIMARY KEY, loan_id INTEGER REFERENCES loans(id), fee DECIMAL(8, 2));
CREATE VIEW open_loans AS SELECT l.id, m.card FROM loans l JOIN members m ON m.id = l.member_id WHERE l.state = 'open';
CREATE OR REPLACE FUNCTION close_loan(p INT) RETURNS VOID AS $$
BEGIN
  INSERT INTO fines (loan_id, fee, paid_at) SELECT loan_id, SUM(days * 3), NOW() FROM loan_books WHERE loan_id = p;
  UPDATE loans SET state = 'done' WHERE id = p;
END; $$ LANGUAGE plpgsql;
"""
STAGED = """
CREATE TABLE raw (id INT, total INT); CREATE TABLE sums (total INT);
CREATE FUNCTION stage() RETURNS void AS $$ BEGIN CREATE TEMP TABLE part AS SELECT id, total FROM raw; INSERT INTO sums (total) SELECT total FROM part; END $$;
"""


def edges_of(spark, ddl):
    return [(r.source, r.edge_type, r.target, r.details) for r in analyze(from_text(spark, ddl)).edges.orderBy("edge_seq").collect()]


def test_library(spark):
    a = analyze(from_text(spark, LIBRARY))
    assert [(r.source, r.edge_type, r.target, r.details) for r in a.edges.orderBy("edge_seq").collect()] == [
        ("loans", "FK", "members", "member_id -> members.id"), ("loan_books", "FK", "loans", "loan_id -> loans.id"), ("fines", "FK", "loans", "loan_id -> loans.id"),
        ("open_loans", "READ", "loans", ""), ("open_loans", "READ", "members", ""), ("close_loan", "READ", "loan_books", ""), ("close_loan", "WRITE", "fines", "INSERT"), ("close_loan", "WRITE", "loans", "UPDATE"),
    ]
    assert [(r.source, r.target, r.details, r.via) for r in a.flows.orderBy("flow_seq").collect()] == [("loan_books", "fines", "INSERT", "close_loan"), ("close_loan", "loans", "UPDATE", "close_loan")]
    assert [(r.src_col, r.tgt_col) for r in a.column_lineage.orderBy("pos").collect()] == [("loan_id", "loan_id"), ("sum(days * 3)", "fee"), ("now()", "paid_at")]
    assert [r.name for r in a.topological_order().orderBy("position").collect()] == ["members", "loans", "fines", "loan_books", "open_loans", "close_loan"]
    found = graph.impact_summary(a.impact(spark.createDataFrame([("script", "LOANS"), ("script", "nothing")], "script_id string, target string"))).collect()
    assert [(r.target, r.upstream, r.downstream) for r in found] == [("loans", "members", "close_loan, fines, loan_books, open_loans")]
    assert {(r.column, r.data_type) for r in a.columns.where("name = 'open_loans'").collect()} == {("id", "SERIAL"), ("card", "VARCHAR(40)")}
    s = a.stats.first()
    assert (s.total_objects, s.total_edges, s.has_cycles) == (6, 8, False) and a.cycles().count() == 0


def test_renderings_have_all_facts(spark):
    a = analyze(from_text(spark, LIBRARY))
    text = render.to_text(a).first().report
    for part in ("  TABLEs  (4)", "    * members\n        id                       SERIAL               PK NOT NULL\n", "member_id                INTEGER              FK NOT NULL  -> members.id", "Lineage edges  (8)", "    fines                    --[FK (loan_id -> loans.id)]--> loans",
                 "    close_loan               --[WRITE (INSERT)]--> fines\n        loan_books.loan_id  ->  fines.loan_id", "Column-level lineage  (3)", "Data flows in function bodies  (2)", "members -> loans -> fines -> loan_books -> open_loans -> close_loan", "  Summary: 6 objects, 8 edges"):
        assert part in text, part
    assert "WARNING" not in text and "objects, 8 edges, without cycles" in render.to_report(a).first().report
    found = json.loads(render.to_json(a).first().json)
    assert list(found) == ["objects", "edges", "col_lineage", "flows", "cycles", "topo_order", "stats"] and found["stats"] == {"total_objects": 6, "total_edges": 8, "has_cycles": False}
    assert found["objects"][1]["columns"][1] == {"name": "member_id", "type": "INTEGER", "nullable": False, "pk": False, "fk_to": "members.id", "unique": False, "default": ""}
    assert [c["tgt_col"] for e in found["edges"] if e["details"] == "INSERT" for c in e["col_lineage"]] == ["loan_id", "fee", "paid_at"] and len(found["flows"]) == 2 and found["topo_order"][0] == "members"

    staged = analyze(from_text(spark, STAGED))
    assert "    * part  [TEMP, created in stage]" in render.to_text(staged).first().report
    dot, mermaid = render.to_dot(staged).first().dot, render.to_mermaid(staged).first().mermaid
    cluster = dot.split('subgraph "cluster_stage"')[1].split("  }")[0]
    assert '"stage" [label=' in cluster and '"part" [label=' in cluster and 'label="flow CREATE"' in dot and "total INT" in dot
    group = mermaid.split('subgraph stage_group["ƒ stage"]')[1].split("  end")[0]
    assert "stage[" in group and "part[" in group and '  raw ==>|"CREATE"| part' in mermaid and '  part ==>|"INSERT"| sums' in mermaid and mermaid.startswith("graph LR\n")

    ring = analyze(from_text(spark, 'CREATE VIEW a AS SELECT 1 FROM b; CREATE VIEW b AS SELECT 1 FROM a; CREATE TABLE "end" (id INT); CREATE VIEW graph AS SELECT id FROM "end";'))
    mermaid, dot, text = render.to_mermaid(ring).first().mermaid, render.to_dot(ring).first().dot, render.to_text(ring).first().report
    assert "  n_end[" in mermaid and '  n_graph -->|"reads"| n_end' in mermaid and "  %% a -> b -> a" in mermaid and mermaid.endswith("  class a,b cycle")
    assert dot.count("CYCLE!") == 2 and "color=red" in dot and "WARNING: 1 circular" in text and "    a -> b -> a" in text and "[CYCLES DETECTED]" in text
    assert "1. a > b > a" in render.to_report(ring).first().report and json.loads(render.to_json(ring).first().json)["cycles"] == [["a", "b", "a"]]


def test_view_labels_and_hidden_routines(spark):
    a = analyze(from_text(spark, STAGED + "CREATE PROCEDURE copy() BEGIN INSERT INTO sums SELECT total FROM raw; END;"))
    links = compare.lineage_view(a.objects, a.edges, a.flows)
    got = {(r["from"], r["to"]): r.label for r in compare.link_labels(links, a.objects).collect()}
    assert got == {("raw", "part"): "WRITE CREATE", ("part", "sums"): "WRITE INSERT", ("raw", "sums"): "WRITE INSERT · ƒ copy"}
    assert {(r.name, r.owner) for r in compare.view_nodes(a.objects, links).collect()} == {("raw", None), ("sums", None), ("part", "stage"), ("copy", "copy")}


def test_types_through_views_and_wildcards(spark):
    ddl = """
    CREATE TABLE t (id INT, v TEXT); CREATE TABLE u (id BIGINT, w DATE);
    CREATE VIEW own AS SELECT t.id, u.w FROM t JOIN u ON t.id = u.id;
    CREATE VIEW aliased AS SELECT t.v FROM t x;
    CREATE VIEW nested AS select `x`.`id` AS `n`,`y`.`w` AS `d` from (`t` `x` join `u` `y` on((`x`.`id` = `y`.`id`)));
    CREATE VIEW lost AS SELECT * FROM nowhere; CREATE VIEW twice AS SELECT * FROM t a JOIN t b ON TRUE;
    CREATE VIEW doubled AS SELECT id, count(*), id FROM own;
    CREATE FUNCTION f() RETURNS SETOF doubled AS $$ SELECT 1 $$; CREATE FUNCTION g() RETURNS SETOF nothing AS $$ SELECT 1 $$;
    CREATE TABLE made AS SELECT d, id_3 FROM nested JOIN f ON TRUE;
    CREATE TABLE t (id UUID); CREATE VIEW later AS SELECT id FROM t;
    """
    got = {}
    for r in analyze(from_text(spark, ddl)).derived_columns.orderBy("name", "ordinal").collect():
        got.setdefault(r.name, []).append((r.column, r.data_type))
    assert got == {
        "own": [("id", "INT"), ("w", "DATE")], "aliased": [("v", "TEXT")], "nested": [("n", "INT"), ("d", "DATE")], "lost": [("column_1", "")], "twice": [("id", "INT"), ("v", "TEXT")],
        "doubled": [("id", "INT"), ("column_2", ""), ("id_3", "INT")], "f": [("id", "INT"), ("column_2", ""), ("id_3", "INT")], "made": [("d", "DATE"), ("id_3", "INT")], "later": [("id", "UUID")],
    }


def test_altered_names(spark):
    ddl = """
    CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT, a_id INT, c_id INT);
    ALTER TABLE ONLY s.b ADD CONSTRAINT k FOREIGN KEY (a_id) REFERENCES s.a(id); ALTER TABLE IF EXISTS ONLY "S"."B" ADD FOREIGN KEY (c_id) REFERENCES `C`;
    ALTER TABLE b ADD COLUMN d_id INT REFERENCES d, ADD COLUMN e_id INT REFERENCES s.e(id);
    """
    assert edges_of(spark, ddl) == [("b", "FK", "a", "a_id -> a.id"), ("b", "FK", "c", "c_id -> c.id"), ("b", "FK", "d", ""), ("b", "FK", "e", "")]
    a = analyze(from_text(spark, ddl))
    assert {r.name for r in a.objects.collect()} == {"a", "b", "c", "d", "e"}
    assert {(r.column, r.fk_to) for r in a.columns.where("name = 'b'").collect()} == {("id", None), ("a_id", "a.id"), ("c_id", "c.id")}


def test_catalog_style_columns(spark):
    ddl = """
    CREATE TABLE shop.customers (id integer NOT NULL, email character varying(255) NOT NULL, CONSTRAINT pk PRIMARY KEY (id), CONSTRAINT u UNIQUE (email));
    CREATE TABLE vip (discount numeric(5,2) DEFAULT 0) INHERITS (shop.customers);
    CREATE TABLE items (order_id integer, line_no integer, status varchar(20) DEFAULT 'new'::character varying NOT NULL, at timestamp without time zone DEFAULT now(), PRIMARY KEY (order_id, line_no), check_date DATE, period INT, type TEXT);
    CREATE TABLE returns (id integer, order_id integer, line_no integer, customer_id integer, LIKE base,
      FOREIGN KEY (order_id, line_no) REFERENCES shop.items(order_id, line_no), FOREIGN KEY (customer_id) REFERENCES customers);
    ALTER TABLE ONLY items ADD CONSTRAINT x FOREIGN KEY (status) REFERENCES states;
    """
    a = analyze(from_text(spark, ddl))
    got = {(r.name, r.column): (r.data_type, r.nullable, r.pk, r.unique, r.fk_to, r.default) for r in a.columns.collect()}
    assert got[("customers", "id")] == ("INTEGER", False, True, False, None, None)
    assert got[("customers", "email")] == ("CHARACTER VARYING(255)", False, False, True, None, None)
    assert got[("vip", "discount")] == ("NUMERIC(5,2)", True, False, False, None, "0")
    assert got[("items", "status")][:2] == ("VARCHAR(20)", False) and got[("items", "status")][5] == "new"
    assert got[("items", "at")] == ("TIMESTAMP WITHOUT TIME ZONE", True, False, False, None, "now()")
    assert {c for t, c in got if t == "items"} == {"order_id", "line_no", "status", "at"}
    assert got[("returns", "line_no")][4] == "items.line_no" and got[("returns", "customer_id")][4] == "customers.id"
    e = edges_of(spark, ddl)
    assert ("returns", "FK", "items", "order_id -> items.order_id, line_no -> items.line_no") in e
    assert ("vip", "INHERITS", "customers", "") in e and ("returns", "INHERITS", "base", "") in e


def test_routines_of_several_dialects(spark):
    ddl = """
    CREATE DEFINER=`u`@`%` PROCEDURE checkout(c INT) BEGIN DELETE FROM cart_items WHERE id IN (SELECT id FROM cart); TRUNCATE TABLE log; END;
    CREATE OR REPLACE PROCEDURE load_tgt IS CURSOR c IS SELECT 1 FROM src; BEGIN INSERT INTO tgt VALUES (1); MERGE INTO audit_log USING src ON (1=1); END;
    /
    CREATE PROCEDURE refresh AS UPDATE stats SET n = 1 FROM raw;
    CREATE FUNCTION keep() RETURNS INT AS $$ WITH cte AS (SELECT 1 FROM base) SELECT a FROM cte FOR UPDATE $$;
    CREATE FUNCTION stage() RETURNS void AS $$ BEGIN CREATE TEMP TABLE s AS SELECT id FROM orders; INSERT INTO r (x) SELECT sum(id) FROM s; END $$;
    """
    e = {x[:3] for x in edges_of(spark, ddl)}
    assert {("checkout", "WRITE", "cart_items"), ("checkout", "WRITE", "log"), ("checkout", "READ", "cart"), ("load_tgt", "READ", "src"), ("load_tgt", "WRITE", "tgt"), ("load_tgt", "WRITE", "audit_log"), ("refresh", "WRITE", "stats"), ("refresh", "READ", "raw"), ("keep", "READ", "base"), ("stage", "WRITE", "s")} <= e
    assert not any(t == "cte" for _, _, t in e)
    a = analyze(from_text(spark, ddl))
    assert [(r.owner, r.members) for r in compare.groups(a.objects).collect()] == [("stage", ["s", "stage"])]
    assert {(r["from"], r["to"]) for r in compare.lineage_view(a.objects, a.edges, a.flows).where("via = 'stage'").collect()} == {("orders", "s"), ("s", "r")}
    assert {(r.source, r.target) for r in a.flows.where("via = 'keep'").collect()} == {("base", "keep")}


def test_columns_of_routines_and_their_tables(spark):
    ddl = """
    CREATE TABLE orders (id SERIAL PRIMARY KEY, amount DECIMAL(10,2));
    CREATE FUNCTION f() RETURNS TABLE (day DATE, total NUMERIC(12, 2)) AS $$ SELECT 1 $$;
    CREATE FUNCTION g() RETURNS SETOF shop.orders AS $$ SELECT 1 $$;
    CREATE FUNCTION stage() RETURNS void AS $$ BEGIN CREATE TEMP TABLE s AS SELECT id, amount FROM orders; CREATE TABLE log (at DATE, note TEXT); END $$;
    """
    a = analyze(from_text(spark, ddl))
    got = {}
    for r in a.columns.orderBy("name", "ordinal").collect():
        got.setdefault(r.name, []).append((r.column, r.data_type))
    assert got == {"orders": [("id", "SERIAL"), ("amount", "DECIMAL(10,2)")], "f": [("day", "DATE"), ("total", "NUMERIC(12,2)")], "g": [("id", "SERIAL"), ("amount", "DECIMAL(10,2)")], "s": [("id", "SERIAL"), ("amount", "DECIMAL(10,2)")], "log": [("at", "DATE"), ("note", "TEXT")]}
    assert {(r.name, r.temporary, r.parent) for r in a.objects.where("parent is not null").collect()} == {("s", True, "stage"), ("log", False, "stage")}


def test_order_of_emission_has_no_bound(spark):
    n = 700
    froms, inserts = ", ".join(f"s{i:04}" for i in range(n)), " ".join(f"INSERT INTO t{i:04} VALUES (1);" for i in range(n))
    a = analyze(from_text(spark, f"CREATE FUNCTION f() RETURNS void AS $$ INSERT INTO t SELECT 1 FROM {froms}; {inserts} $$; CREATE VIEW v AS SELECT 1 FROM {froms};"))
    flows = [(r.source, r.target) for r in a.flows.orderBy("flow_seq").collect()]
    assert flows == [(f"s{i:04}", "t") for i in range(n)] + [("f", f"t{i:04}") for i in range(n)]
    assert len({str(r.flow_seq) for r in a.flows.collect()}) == 2 * n
    reads = [r.target for r in a.edges.where("edge_type = 'READ' and source = 'v'").orderBy("edge_seq").collect()]
    assert reads == [f"s{i:04}" for i in range(n)]
    objects = [r.name for r in a.objects.orderBy("obj_seq").collect()]
    assert objects[:2] == ["f", "v"] and sorted(objects[2:]) == sorted([*{x for f in flows for x in f} - {"f"}])


def test_projects_cross_scripts(spark):
    scripts = spark.createDataFrame([("1", "CREATE TABLE t (id INT PRIMARY KEY, o INT NOT NULL REFERENCES o (id));"), ("2", "CREATE VIEW v AS SELECT id AS x, o FROM t; CREATE FUNCTION f() RETURNS SETOF t AS $$ SELECT 1 $$;"), ("3", "CREATE VIEW w AS SELECT v.x FROM v; ALTER TABLE t ADD FOREIGN KEY (o) REFERENCES p (code);"), ("4", "CREATE TABLE v (y INT);")], "script_id string, ddl string")
    p = Project(scripts, "all")
    got = {(c.name, c.column): c for c in p.columns.collect()}
    assert {c.script_id for c in got.values()} == {"all"} and set(got) == {("t", "id"), ("t", "o"), ("f", "id"), ("f", "o"), ("w", "x"), ("v", "y")}
    assert got["w", "x"].data_type == "INT" and got["t", "o"].fk_to == "p.code" and got["f", "id"].pk and not got["f", "o"].nullable and got["f", "o"].fk_to == "o.id"
    assert [(o.name, o.type) for o in p.objects.orderBy("obj_seq").collect()][:3] == [("t", "TABLE"), ("v", "TABLE"), ("f", "FUNCTION")]
    assert "x INT" in render.to_report(p).first().report


def test_empty_and_null_scripts(spark):
    a = analyze(spark.createDataFrame([("a", None), ("b", ""), ("c", "SELECT 1")], "script_id string, ddl string"))
    assert a.edges.count() == a.objects.count() == a.flows.count() == a.columns.count() == 0
    assert a.topological_order().count() == 0


def kahn(nodes, edges):
    need = {n: {b for a, b in edges if a == n and b != n} for n in nodes}
    left = {n: len(x) for n, x in need.items()}
    todo, out = deque(n for n in nodes if not left[n]), []
    while todo:
        n = todo.popleft()
        out.append(n)
        free = []
        for m in nodes:
            if n in need[m]:
                left[m] -= 1
                if not left[m]:
                    free.append(m)
        todo.extend(sorted(free))
    return out + ["*" + n for n in sorted(set(nodes) - set(out))]


def test_order_and_cycles_on_random_graphs(spark):
    rng, rows, objects, expected, cyclic = random.Random(9), [], [], {}, set()
    for g in range(25):
        nodes = [f"n{k}" for k in rng.sample(range(20), rng.randint(2, 9))]
        links = [tuple(rng.sample(nodes, 2)) for _ in range(rng.randint(0, 10))]
        rows += [(str(g), i, a, b, "FK") for i, (a, b) in enumerate(links)]
        objects += [(str(g), i, n) for i, n in enumerate(nodes)]
        expected[str(g)] = kahn(nodes, set(links))
        reach = {n: {b for a, b in links if a == n} for n in nodes}
        for _ in nodes:
            reach = {n: x | {z for y in x for z in reach[y]} for n, x in reach.items()}
        cyclic |= {(str(g), n) for n in nodes if n in reach[n]}
    e = spark.createDataFrame(rows, "script_id string, edge_seq long, source string, target string, edge_type string")
    o = spark.createDataFrame(objects, "script_id string, obj_seq long, name string")
    got = {}
    for r in graph.topological_order(o, e).orderBy("script_id", "position").collect():
        got.setdefault(r.script_id, []).append(r.name)
    assert got == expected
    assert {(r.script_id, r.node) for r in graph.cyclic_nodes(e).collect()} == cyclic
    listed = graph.cycles(o, e).collect()
    assert {r.script_id for r in listed} == {g for g, _ in cyclic} and all(r.path[0] == r.path[-1] == min(r.path) for r in listed)


def test_history_and_names(spark):
    saves = spark.createDataFrame([("p", 1, "analysis", "a"), ("p", 2, "analysis", "a"), ("p", 3, "update", "a"), ("p", 4, "analysis", "a"), ("p", 5, "analysis", "b"), ("q", 1, "analysis", None), ("q", 2, "analysis", None)], "project string, seq long, action string, ddl string")
    kept = history.history(saves)
    assert sorted((r.project, r.seq) for r in kept.collect()) == [("p", 1), ("p", 3), ("p", 5), ("q", 1)]
    assert [(r.seq, r.version) for r in history.versions(kept).where("project = 'p'").orderBy("seq").collect()] == [(1, 1), (5, 2)]
    assert [r.project for r in history.project_list(saves).collect()] == ["p", "q"]
    names = spark.createDataFrame([("my shop!",), ("__é-1",), ("",), (None,)], "n string").select(history.project_name(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["my_shop", "é-1", "project", "project"]


def test_catalog_to_statements(spark):
    tables = spark.createDataFrame([(1, "public", "Order", ""), (2, "public", "vip", "public.base")], "oid long, schema string, name string, inherits string")
    columns = spark.createDataFrame([(1, 2, "b", "text", False, "'x'"), (1, 1, "a", "integer", True, None)], "oid long, ordinal int, name string, type string, not_null boolean, default_expr string")
    keys = spark.createDataFrame([(1, 1, "pk", "PRIMARY KEY (a)")], "oid long, ordinal int, name string, definition string")
    got = {r.oid: r.ddl for r in catalog.table_statements(tables, columns, keys).collect()}
    assert got == {1: "CREATE TABLE public.\"Order\" (a integer NOT NULL, b text DEFAULT 'x', CONSTRAINT pk PRIMARY KEY (a));", 2: "CREATE TABLE public.vip () INHERITS (public.base);"}
    with pytest.raises(ValueError):
        catalog.connector("oracle")
    assert catalog.connector("mysql").url("h", "d") == "jdbc:mysql://h:3306/d"


def test_catalog_extraction(spark):
    tables = spark.createDataFrame([(1, "public", "b", "", "r", False, False), (2, "public", "a", "", "p", False, False), (3, "public", "part", "", "r", True, False), (4, "x", "o", "", "r", False, False), (5, "public", "stat", "", "r", False, True)], "oid long, schema string, name string, inherits string, kind string, is_partition boolean, from_extension boolean")
    columns = spark.createDataFrame([(k, 1, "id", "integer", True, None) for k in range(1, 6)], "oid long, ordinal int, name string, type string, not_null boolean, default_expr string")
    keys = spark.createDataFrame([(1, 1, "f", "FOREIGN KEY (id) REFERENCES a(id)"), (1, 2, "pk", "PRIMARY KEY (id)")], "oid long, ordinal int, name string, definition string")
    views = spark.createDataFrame([(9, "public", "w", "v", " SELECT id FROM a; ", False), (8, "public", "m", "m", "SELECT 1", False), (7, "public", "i", "i", "SELECT 2", False)], "oid long, schema string, name string, kind string, definition string, from_extension boolean")
    routines = spark.createDataFrame([(6, "public", "f", "f", "CREATE FUNCTION f() RETURNS int AS $$ SELECT 1 FROM a $$ ", False), (5, "public", "agg", "a", "x", False)], "oid long, schema string, name string, kind string, definition string, from_extension boolean")
    script = catalog.connector("postgresql").extract("db", tables, columns, keys, views, routines)
    assert script.first().ddl.split("\n\n") == [
        "CREATE TABLE public.a (id integer NOT NULL);", "CREATE TABLE public.b (id integer NOT NULL, CONSTRAINT pk PRIMARY KEY (id), CONSTRAINT f FOREIGN KEY (id) REFERENCES a(id));",
        "CREATE MATERIALIZED VIEW public.m AS SELECT 1;", "CREATE VIEW public.w AS SELECT id FROM a;", "CREATE FUNCTION f() RETURNS int AS $$ SELECT 1 FROM a $$;",
    ]
    assert {(r.source, r.target) for r in analyze(script).edges.collect()} == {("b", "a"), ("w", "a"), ("f", "a")}
    assert catalog.connector("postgresql").extract("db", tables, columns, keys, views, routines, objects=["w"]).first().ddl == "CREATE VIEW public.w AS SELECT id FROM a;"

    shown = spark.createDataFrame([("d", "v", "VIEW", "CREATE VIEW `v` AS SELECT 1 FROM `t`"), ("d", "t", "TABLE", "CREATE TABLE `t` (`a` int);"), ("d", "p", "PROCEDURE", None)], "schema string, name string, kind string, definition string")
    listed, run = spark.createDataFrame([("d", "v", "VIEW"), ("d", "t", "BASE TABLE"), ("e", "z", "BASE TABLE")], "schema string, name string, kind string"), spark.createDataFrame([("d", "p", "PROCEDURE")], "schema string, name string, kind string")
    assert catalog.connector("mysql").extract("db", listed, run, shown, database="d").first().ddl == "CREATE TABLE `t` (`a` int);\n\nCREATE VIEW `v` AS SELECT 1 FROM `t`;"
    assert {r.query for r in catalog.show_create(listed, run).where("schema = 'd'").collect()} == {"SHOW CREATE VIEW `d`.`v`", "SHOW CREATE TABLE `d`.`t`", "SHOW CREATE PROCEDURE `d`.`p`"}


def test_projects_are_ensured(spark):
    old = spark.createDataFrame([("shop", "Shop", "old", "t0", "t0")], "project string, display_name string, description string, created_at string, updated_at string")
    kind = "name string, seq long, at string, metadata struct<name:string,description:string,created_at:string>"
    got = {r.project: tuple(r)[1:] for r in history.ensured(old, spark.createDataFrame([("shop", 1, "t1", None), (" new one ", 2, "t2", None), ("named", 3, "t3", ("Named", None, "t9"))], kind)).collect()}
    assert got == {"shop": ("Shop", "old", "t0", "t0"), "new_one": ("new_one", "", "t2", "t2"), "named": ("Named", "", "t9", "t9")}
    got = {r.project: tuple(r)[1:] for r in history.ensured(old, spark.createDataFrame([("shop", 1, "t1", ("S", "d", "t5"))], kind)).collect()}
    assert got == {"shop": ("S", "d", "t0", "t5")} and history.project_exists(old, "shop!").first()[0] and not history.project_exists(old, "x").first()[0]


def test_files_stream_and_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sql").write_text(LIBRARY)
    (folder / "b.sql").write_text("CREATE VIEW x AS SELECT 1 FROM y; CREATE VIEW y AS SELECT 1 FROM x;")
    (folder / "c.md").write_text("CREATE TABLE no (a INT);")
    a = analyze(read_scripts(spark, str(folder)))
    assert a.edges.count() == 10
    write_json(a.edges, str(tmp_path / "json"))
    write_text(render.to_mermaid(a), "mermaid", str(tmp_path / "text"))
    assert spark.read.json(str(tmp_path / "json")).count() == 10
    query = write_edges(stream_scripts(spark, str(folder) + "/*.sql"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    assert cli.main([str(folder / "a.sql")]) == 0 and "close_loan" in capsys.readouterr().out
    assert cli.main([str(folder / "b.sql"), "--cycles"]) == 1 and "x" in capsys.readouterr().out
    assert cli.main([str(folder / "a.sql"), "--impact", "loans"]) == 0 and "open_loans" in capsys.readouterr().out
