"""Graphs of great depth take few stored rounds; large levels are numbered by ranges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from schemaweave.operators import graph

LONG = 10_000


@pytest.fixture
def rounds(monkeypatch):
    count, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, *a: (count.append(1), real(df, *a))[1])
    return count


def chain(spark, n, ring=False):
    name = lambda c: F.format_string("n_%05d", c)
    nodes = spark.range(n).select(F.lit("s").alias("script_id"), F.col("id").alias("obj_seq"), name(F.col("id")).alias("name"))
    links = spark.range(0 if ring else 1, n).select(F.lit("s").alias("script_id"), F.col("id").alias("edge_seq"), name(F.col("id")).alias("source"), name(F.pmod(F.col("id") - 1, F.lit(n))).alias("target"), F.lit("FK").alias("edge_type"))
    return nodes, links


def test_long_chain(spark, rounds):
    nodes, links = chain(spark, LONG)
    began = time.time()
    got = graph.topological_order(nodes, links)
    assert [r.name for r in got.orderBy("position").select("name").collect()] == [f"n_{i:05}" for i in range(LONG)]
    assert len(rounds) < 80, len(rounds)
    print(f"chain: {len(rounds)} stored steps, {time.time() - began:.0f} s")
    levels = {r.name: r.level for r in graph.levels(nodes, links).collect()}
    assert levels == {f"n_{i:05}": i for i in range(LONG)}


def test_long_ring_and_chain_into_it(spark, rounds):
    nodes, links = chain(spark, LONG, ring=True)
    more = links.where("edge_seq > 0").select("script_id", F.col("edge_seq") + LONG, F.concat(F.lit("t"), "source"), F.when(F.col("edge_seq") == 1, F.col("target")).otherwise(F.concat(F.lit("t"), "target")).alias("target"), "edge_type").toDF(*links.columns)
    found = graph.cyclic_nodes(links.unionByName(more))
    assert found.count() == LONG and found.where("node like 't%'").count() == 0
    assert len(rounds) < 200, len(rounds)


def reached(nodes, links):
    out = {n: set() for n in nodes}
    for n in nodes:
        todo = [b for a, b in links if a == n]
        while todo:
            x = todo.pop()
            if x not in out[n]:
                out[n].add(x)
                todo += [b for a, b in links if a == x]
    return out


def test_components_of_rings_chains_and_random_links(spark):
    rng, rows, cyclic, depth, names = random.Random(4), [], set(), {}, []
    for g in range(30):
        nodes = [f"v{i}" for i in rng.sample(range(60), 30)]
        links = set()
        for _ in range(rng.randint(1, 4)):  # paths and rings over shared nodes
            path = rng.sample(nodes, rng.randint(2, 8))
            links |= set(zip(path, path[1:], strict=False)) | ({(path[-1], path[0])} if rng.random() < 0.4 else set())
        reach = reached(nodes, links)
        cyclic |= {(str(g), n) for n in nodes if n in reach[n]}
        bad = {n for n in nodes if n in reach[n] or any(m in reach[m] for m in reach[n])}
        level = lambda n, links=links: max([level(b) + 1 for a, b in links if a == n], default=0)  # noqa: B023, E731
        depth |= {(str(g), n): None if n in bad else level(n) for n in nodes}
        rows += [(str(g), i, a, b, "FK") for i, (a, b) in enumerate(sorted(links))]
        names += [(str(g), n) for n in nodes]
    edges = spark.createDataFrame(rows, "script_id string, edge_seq long, source string, target string, edge_type string")
    assert {(r.script_id, r.node) for r in graph.cyclic_nodes(edges).collect()} == cyclic
    assert {(r.script_id, r.name): r.level for r in graph.levels(spark.createDataFrame(names, "script_id string, name string"), edges).collect()} == depth


def test_large_levels_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(graph, "ALONE", 100)
    rows = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("script_id"), F.xxhash64("id").alias("key"), F.col("id").alias("name"))
    got = graph.ranked(rows, ["script_id"], ["key", "name"], "rank", 3334)
    expected = graph.ranked(rows, ["script_id"], ["key", "name"], "rank", 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    nodes = spark.range(1000).select(F.lit("s").alias("script_id"), F.col("id").alias("obj_seq"), F.format_string("n%04d", "id").alias("name"))
    links = nodes.where("obj_seq >= 500").select("script_id", F.col("obj_seq").alias("edge_seq"), F.col("name").alias("source"), F.format_string("n%04d", 999 - F.col("obj_seq")).alias("target"), F.lit("FK").alias("edge_type"))
    order = [r.name for r in graph.topological_order(nodes, links).orderBy("position").collect()]
    assert order == [f"n{i:04}" for i in range(500)] + [f"n{i:04}" for i in range(999, 499, -1)]


def walked(objects, links):
    """The cycles that one walk over a whole graph closes, in order."""
    found, seen = [], set()

    def visit(node, path):
        if node in path:
            ring = path[path.index(node) :]
            k = ring.index(min(ring))
            found.append((*ring[k:], *ring[:k], ring[k]))
        elif node not in seen:
            seen.add(node)
            for a, b in dict.fromkeys(links):
                if a == node and a != b:
                    visit(b, [*path, node])

    for root in objects:
        visit(root, [])
    return list(dict.fromkeys(found))


def test_cycles_piece_by_piece_are_those_of_one_walk(spark, monkeypatch):
    rng, rows, objects, expected = random.Random(7), [], [], {}
    for g in range(6):
        names, links = [f"v{i:03}" for i in rng.sample(range(200), 60)], []
        for k in range(0, 60, 6):  # ten pieces of six nodes, some without a cycle
            piece = names[k : k + 6]
            links += [tuple(rng.sample(piece, 2)) for _ in range(rng.randint(4, 9))]
        rng.shuffle(names)
        rng.shuffle(links)
        links.append((names[0], names[0]))
        rows += [(str(g), i, a, b) for i, (a, b) in enumerate(links)]
        objects += [(str(g), i, n) for i, n in enumerate(names)]
        expected[str(g)] = walked(names, links)
    edges = spark.createDataFrame(rows, "script_id string, edge_seq long, source string, target string")
    nodes = spark.createDataFrame(objects, "script_id string, obj_seq long, name string")
    for alone in (graph.ALONE, 5):
        monkeypatch.setattr(graph, "ALONE", alone)
        got = {}
        for r in graph.cycles(nodes, edges).orderBy("script_id", "seq").collect():
            got.setdefault(r.script_id, []).append(tuple(r.path))
        assert got == {g: x for g, x in expected.items() if x}
    assert sum(map(len, expected.values())) > 20


def test_pieces_take_few_rounds(spark, rounds):
    _, links = chain(spark, LONG)
    name = lambda c: F.concat(F.substring(F.md5(c), 1, 6), c)
    found = graph._pieces(links.where("edge_seq <> 4000").select("script_id", name(F.col("source")).alias("from"), name(F.col("target")).alias("to")))
    assert sorted(r["count"] for r in found.groupBy("piece").count().collect()) == [4000, 6000]
    assert len(rounds) < 60, len(rounds)
