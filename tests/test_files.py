"""What is read and what is rejected, renderings as many files, the command line's answers, and super-nodes."""

import sys
from pathlib import Path

import pytest

from schemaweave import cli
from schemaweave.functions import storage
from schemaweave.operators import compare, render
from schemaweave.plans.analysis import analyze
from schemaweave.sources.scripts import read_checked, write_lines


def test_rejected_files(spark, tmp_path):
    files = {"a.sql": b"CREATE TABLE a (b INT);", "b.TXT": b"\xef\xbb\xbfCREATE TABLE b (b INT);", "c.sql": b"\xff\xfe bad", "d.sql": b"x" * 17_000_000, "e.pdf": b"%PDF", "f.sql": b"", "sub/g.sql": "é".encode()}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    scripts, rejects = read_checked(spark, str(tmp_path))
    short = lambda p: p.rsplit("/", 1)[1]
    assert {short(r.script_id): r.ddl for r in scripts.collect()} == {"a.sql": "CREATE TABLE a (b INT);", "b.TXT": "CREATE TABLE b (b INT);", "g.sql": "é"}
    assert {short(r.script_id): (r.size, r.reason) for r in rejects.collect()} == {"c.sql": (6, "not UTF-8"), "d.sql": (17_000_000, "size"), "e.pdf": (4, "ending")}
    assert "GreaterThanOrEqual(length" in (plan := scripts._jdf.queryExecution().executedPlan().toString()) or "LessThanOrEqual(length" in plan
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_checked(spark, str(tmp_path / "none"))


def test_renderings_in_many_files(spark, tmp_path):
    ddl = "\n".join(f"CREATE TABLE t{i:03} (id INT PRIMARY KEY, r INT REFERENCES t{(i + 1) % 40:03}); CREATE VIEW v{i:03} AS SELECT id FROM t{i:03};" for i in range(40))
    a = analyze(spark.createDataFrame([("one", ddl), ("two", "CREATE TABLE x (y INT REFERENCES z);")], "script_id string, ddl string"))
    for name, renderer, column in (("text", render.to_text, "report"), ("mermaid", render.to_mermaid, "mermaid")):
        whole = {r.script_id: r[column] for r in renderer(a).collect()}
        listed = write_lines(renderer(a, lines=True), str(tmp_path / name), files=5).collect()
        texts: dict = {}
        for r in listed:
            with open(r.file.removeprefix("file:").replace("///", "/")) as f:
                texts[r.script_id] = texts.get(r.script_id, "") + f.read()
        assert {k: v.removesuffix("\n") for k, v in texts.items()} == whole
        assert len([r for r in listed if r.script_id == "one"]) > 1


def test_command_line_answers(spark, tmp_path, capsys, monkeypatch):
    assert cli.main([str(tmp_path / "none.sql")]) == 1 and "no such file" in capsys.readouterr().err
    import io

    monkeypatch.setattr(sys, "stdin", io.StringIO("CREATE TABLE a (b INT REFERENCES c);"))
    assert cli.main(["--cycles"]) == 0 and "No circular dependencies detected." in capsys.readouterr().out


def test_super_nodes(spark):
    objects = spark.createDataFrame([("s", "f", None), ("s", "t", "f"), ("s", "u", "f"), ("s", "x", None), ("r", "t", None)], "script_id string, name string, parent string")
    links = spark.createDataFrame([("s", "x", "t"), ("s", "x", "u"), ("s", "t", "u"), ("s", "u", "x"), ("r", "t", "x")], 'script_id string, from string, to string')
    assert sorted(map(tuple, compare.collapsed(links, objects).collect())) == [("r", "t", "x"), ("s", "f", "x"), ("s", "x", "f")]


def test_a_scope_leaves_no_tables(spark):
    place = Path(storage.mounted_dir(spark))
    place.mkdir(exist_ok=True)
    before = set(place.iterdir())
    with storage.scope():
        a = analyze(spark.createDataFrame([("s", "CREATE TABLE a (b INT REFERENCES c);")], "script_id string, ddl string"))
        assert a.topological_order().count() == 2 and set(place.iterdir()) > before
    assert set(place.iterdir()) <= before


def test_a_local_session_needs_no_shared_folder(spark, monkeypatch):
    class Unset:
        def get(self, key, default=None):
            return default

    session = type("Session", (), {"conf": Unset(), "sparkContext": spark.sparkContext})()
    assert storage.shared_dir(session) == storage.shared_dir(session) and Path(storage.shared_dir(session)).is_dir()
    session.sparkContext = type("Context", (), {"master": "spark://x", "applicationId": "x"})()
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(session)


def test_merged_cycles(spark):
    ring = analyze(spark.createDataFrame([("s", "CREATE VIEW a AS SELECT 1 FROM b; CREATE VIEW b AS SELECT 1 FROM a;")], "script_id string, ddl string"))
    objects, edges, cycles = compare.merged(*[(ring.objects, ring.edges, ring.cycles())] * 2)
    assert (objects.count(), edges.count(), [r.path for r in cycles.collect()]) == (2, 2, [["a", "b", "a"]])
