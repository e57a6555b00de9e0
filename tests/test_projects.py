"""Project store, its versions and conflicts, saves as a stream, and analysis of what has changed only."""

import pytest
from pyspark.sql import functions as F

from schemaweave.operators import history, statements
from schemaweave.plans.analysis import analyze
from schemaweave.sources import versioned
from schemaweave.streaming import scripts as streaming

SAVES = "project string, seq long, action string, ddl string, state string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_writers_and_killed_writes(spark, tmp_path, monkeypatch):
    t = versioned.VersionedTable(spark, str(tmp_path), "k string, v int", "k", buckets=4)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert t.read().count() == 0 and t.append(frame(("a", 1), ("b", 2), ("c", 3), (None, 9))) == 1
    assert rows_of(t.of("b")) == [("b", 2)]
    before = set(t._folders())
    assert t.replace(frame(("b", 0)), frame(("b", 5), ("b", 6))) == 2
    bucket = t._folders()
    changed = {bucket[f] for f in set(bucket) - before}
    assert len(changed) == 1 and rows_of(t.read().where("k is not null")) == [("a", 1), ("b", 5), ("b", 6), ("c", 3)]
    assert t.read(1).where("k = 'b'").first().v == 2  # the old version is still there
    # A second writer takes the number in between: the first one starts again on what is there now.
    real, raced = versioned.VersionedTable._commit, []

    def late(self, version, added, removed):
        if not raced:
            raced.append(1)
            t.append(frame(("b", 7)))
        return real(self, version, added, removed)

    monkeypatch.setattr(versioned.VersionedTable, "_commit", late)
    assert t.replace(frame(("a", 0))) == 4
    assert rows_of(t.read().where("k is not null")) == [("b", 5), ("b", 6), ("b", 7), ("c", 3)]
    # A writer that dies before its manifest is there leaves nothing to see.
    monkeypatch.setattr(versioned.VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        t.append(frame(("z", 1)))
    assert t.version() == 4 and t.read().where("k = 'z'").count() == 0


def test_project_store(spark, tmp_path):
    store = history.Projects(spark, str(tmp_path))
    first = [("p", 1, "analysis", "a", '{"stats": {"total_objects": 3, "total_edges": 2, "has_cycles": true}}'), ("p", 2, "analysis", "a", "{}"), ("p", 3, "update", "a", "no json"), ("q", 1, "analysis", None, None)]
    store.save(spark.createDataFrame(first, SAVES))
    store.save(spark.createDataFrame([("p", 4, "analysis", "a", "{}"), ("p", 5, "analysis", "b", '{"stats": {"total_objects": 4}}'), ("q", 2, "analysis", None, "{}")], SAVES))
    assert [tuple(r)[1:] for r in store.history("p").collect()] == [(5, "analysis", 4, None, None), (3, "update", None, None, None), (1, "analysis", 3, 2, True)]
    assert [r.seq for r in store.history("q").collect()] == [1]
    assert store.load("p").first().ddl == "b" and store.entry("p", 1).select(F.to_json("state").alias("s")).first().s.startswith('{"stats"') and store.entry("p", 2).count() == 0
    at = "timestamp'2026-01-01'"
    asked = spark.sql(f"SELECT 'p!' AS name, 1 AS seq, {at} AS at, named_struct('name', 'P', 'description', 'd', 'created_at', CAST(NULL AS TIMESTAMP)) AS metadata UNION ALL SELECT 'q', 2, {at}, NULL")
    store.ensure(asked)
    store.ensure(asked.where("name = 'q'"))
    assert rows_of(store.projects.read().select("project", "display_name")) == [("p", "P"), ("q", "q")]
    store.delete(spark.createDataFrame([("p",)], "project string"))
    assert [r.project for r in store.projects.read().collect()] == ["q"] and {r.project for r in store.saves.read().collect()} == {"q"}


def test_saves_as_a_stream(spark, tmp_path):
    saves = [(p, i, "update" if i % 4 == 3 else "analysis", (None, "a", "b")[(i * 7 // 5) % 3]) for i in range(30) for p in ("x", "y")]
    for k in range(3):
        spark.createDataFrame(saves[k * 20 : k * 20 + 20], "project string, seq long, action string, ddl string").coalesce(1).write.json(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("project string, seq long, action string, ddl string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    streaming.history_stream(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    expected = history.history(spark.createDataFrame(saves, "project string, seq long, action string, ddl string"))
    assert sorted(map(repr, spark.table("kept").collect())) == sorted(map(repr, expected.collect()))


def test_only_changed_scripts_are_parsed(spark, tmp_path, monkeypatch):
    parsed, real = [], statements.statements
    monkeypatch.setattr(streaming.statements, "statements", lambda s: (parsed.extend(r.script_id for r in s.collect()), real(s))[1])
    frame = lambda *rows: spark.createDataFrame(list(rows), "script_id string, ddl string")
    one, two, three = ("1", "CREATE TABLE a (b INT REFERENCES c)"), ("2", "CREATE VIEW v AS SELECT 1 FROM a"), ("3", "SELECT 1")
    for scripts, changed in ((frame(one, two, three), ["1", "2", "3"]), (frame(one, two, three), []), (frame(one, ("2", "CREATE VIEW v AS SELECT 1 FROM d")), ["2"])):
        parsed.clear()
        a, count = streaming.refreshed(scripts, str(tmp_path))
        assert sorted(parsed) == changed and count == len(changed)
        columns = ["script_id", "source", "target", "edge_type"]
        assert rows_of(a.edges.select(*columns)) == rows_of(analyze(scripts).edges.select(*columns))
