"""Cutting a script block by block gives what cutting it at once gives."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaweave.functions import cutting, text
from schemaweave.operators import splitting, statements
from schemaweave.sources.scripts import from_text

PIECES = [
    "CREATE TABLE t (a INT);", "CREATE FUNCTION f() RETURNS int AS $$ BEGIN x; END $$;", "$q$ a; $q$", "$", "$$", "'a;b'", "''", "'", "it''s;", "--", "-", "/*", "*/", "/", "*", "\n/\n", "\n /\t\n", "\n", " ", ";", "(", ")",
    "BEGIN", "END", "END IF", "END;", "BEGIN;", "BEGIN TRANSACTION", "CASE", "x", "CREATE OR REPLACE PROCEDURE p IS v NUMBER; BEGIN NULL; END;", "CREATE PROCEDURE p AS BEGIN", "CREATE FUNCTION f RETURN INT IS CURSOR c IS SELECT 1;",
    "CREATE", "PROCEDURE p(a INT)", "AS", "IS", "v CONSTANT INT := 3;", "LANGUAGE", "é", "0x",
]


def without_comments(script):
    return re.sub(r"--[^\n]*", " ", re.sub(r"(?s)/\*.*?\*/", " ", script))


def in_blocks(script, cuts):
    """Statements of a script that is cut at these places, each block read from the state that the one before left."""
    bounds = [0, *sorted({c % (len(script) + 1) for c in cuts}), len(script)]
    state, out, part = cutting.State(), [], ""
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        final = i == len(bounds) - 2
        pieces, state = cutting.cut_block(script[a:b], cutting.State.unpacked(state.packed()), final, script.find("*/", max(0, b - 1)) >= 0, "$" in script[b:])
        for piece, end, begun in pieces:
            part += piece
            assert bool(begun) == bool(part.strip()) and part.lstrip().startswith(begun)
            if end:
                out += [part.strip()] if part.strip() else []
                part = ""
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), st.lists(st.integers(0, 400), max_size=8))
def test_cut_anywhere(script, cuts):
    assert in_blocks(script, cuts) == cutting.cut_statements(without_comments(script))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map(" ".join))
def test_cut_everywhere(script):
    assert in_blocks(script, range(len(script))) == cutting.cut_statements(without_comments(script))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_comments(script):
    assert cutting.without_comments(script, 0, False)[0] == without_comments(script)


def dump(n):
    lines = []
    for i in range(n):
        lines += [f"CREATE TABLE t{i} (", f"  id INT DEFAULT {i}, -- it's; one", "  note TEXT DEFAULT 'a;", "b''(;'", ");"]
        lines += [f"INSERT INTO t{i} VALUES ({', '.join(map(str, range(90)))}, '{'z;' * 200}');"] if i % 3 == 0 else []
        lines += [f"CREATE FUNCTION f{i}() RETURNS void AS $body$", "BEGIN", f"  UPDATE t{i} SET id = 1; /* not ;", "   yet */ DELETE FROM t0;", "END", "$body$ LANGUAGE plpgsql;"] if i % 4 == 0 else []
        lines += [f"CREATE OR REPLACE PROCEDURE p{i} IS", "  v NUMBER := 1;", "BEGIN", "  IF v = 1 THEN NULL; END IF;", "END;", "/"] if i % 5 == 0 else []
    return lines


def test_a_large_script_is_cut_by_many_tasks(spark, tmp_path):
    lines = dump(60)
    whole = {(r.stmt_seq, r.stmt, r.kind, r.name) for r in statements.statements(from_text(spark, "\n".join(lines))).collect()}
    (tmp_path / "dump.sql").write_text("\n".join(lines))
    (tmp_path / "none.sql").write_text("")
    (tmp_path / "small.sql").write_text("CREATE TABLE a (b INT)")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        blocks = splitting.read_blocks(spark, str(tmp_path), size=300)
        assert blocks.agg(F.max(F.length("text"))).first()[0] <= 300 and blocks.count() > 40
        got = splitting.statements(blocks).withColumn("file", F.regexp_extract("script_id", r"(\w+)\.sql$", 1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.stmt_seq, r.stmt, r.kind, r.name) for r in got if r.file == "dump"} == whole
    assert [(r.stmt, r.name) for r in got if r.file == "small"] == [("CREATE TABLE a (b INT)", "a")]
    rows = spark.createDataFrame([("x", i, line) for i, line in enumerate(lines)] + [("y", 0, None), ("y", 1, "SELECT 1")], "script_id string, at int, line string")
    counts = {r.script_id: r.n_statements for r in splitting.statement_counts(splitting.line_blocks(rows, size=200)).collect()}
    one = from_text(spark, "\n".join(lines)).select(F.size(F.udf(cutting.cut_statements, "array<string>")(text.strip_comments(F.col("ddl")))).alias("n"))
    assert counts == {"x": one.first().n, "y": 1}


def test_blocks_end_where_statements_begin(spark, monkeypatch):
    """Most blocks are then entered as they are read at first: few are read again, and all by many tasks."""
    lines = [x for i in range(3000) for x in (f"CREATE TABLE t{i} ( -- it's; one", "  note TEXT DEFAULT 'a;", "b('' );');", f"CREATE FUNCTION f{i}() RETURNS void AS $$ BEGIN", "  DELETE FROM t0; /* not;", "  yet */ END $$;")]
    rows = spark.createDataFrame([("x", i, line) for i, line in enumerate(lines)], "script_id string, at int, line string")
    blocks, tried, counted = splitting.line_blocks(rows, size=2000), splitting._tried, []
    n = blocks.count()
    assert n > 200 and blocks.where("startswith(text, 'CREATE')").count() > 0.9 * n
    assert blocks.select(F.input_file_name()).distinct().count() >= 4

    def counting(blocks, pairs):
        counted.append(pairs.count())
        return tried(blocks, pairs)

    monkeypatch.setattr(splitting, "_tried", counting)
    got = {(r.stmt_seq, r.stmt) for r in splitting.statements(blocks).select("stmt_seq", "stmt").collect()}
    assert got == set(enumerate(cutting.cut_statements(without_comments("\n".join(lines)))))
    assert sum(counted) < 0.1 * n
