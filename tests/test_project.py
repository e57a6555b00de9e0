"""Queries on the whole shop, on tables larger than the smallest test data."""

import pytest

from schemaweave.plans import queries

N = 450


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("shop"))
    spark.createDataFrame([(i,) for i in range(5)], "r_regionkey int").write.parquet(f"{sf}/region.parquet")
    spark.createDataFrame([(i, i % 5) for i in range(25)], "n_nationkey int, n_regionkey int").write.parquet(f"{sf}/nation.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(1, N + 1)], "c_custkey int, c_nationkey int").write.parquet(f"{sf}/customer.parquet")
    return sf


def test_impact_of_every_customer(spark, shop):
    below = [(f"r_{i % 5}", f"n_{i}") for i in range(25)] + [(f"r_{i % 25 % 5}", f"c_{i}") for i in range(1, N + 1)]
    views = [(f"r_{i % 25 % 5}", f"w_{i}") for i in range(1, N + 1)]
    assert sorted(map(tuple, queries.impact_downstream(spark, shop).collect())) == sorted(below + views)
    assert sorted(map(tuple, queries.impact_fk_only(spark, shop).collect())) == sorted(below)
    above = [(f"w_{i}", x) for i in range(1, N + 1) for x in (f"c_{i}", f"n_{i % 25}", f"r_{i % 25 % 5}")]
    assert sorted(map(tuple, queries.impact_upstream(spark, shop).collect())) == sorted(above)


def test_levels_order_and_stats_of_every_customer(spark, shop):
    level = {f"r_{i}": 0 for i in range(5)} | {f"n_{i}": 1 for i in range(25)} | {f"{x}_{i}": k for x, k in (("c", 2), ("w", 3)) for i in range(1, N + 1)}
    assert sorted(map(tuple, queries.topo_levels(spark, shop).collect())) == sorted(level.items())
    order = [r.name for r in queries.topo_order(spark, shop).orderBy("position").collect()]
    assert sorted(order) == sorted(level) and [level[x] for x in order] == sorted(level.values())
    assert queries.object_stats(spark, shop).first().asDict() == {"script_id": "shop", "total_objects": 30 + 2 * N, "total_edges": 25 + 3 * N, "has_cycles": False}


def test_scripts_stay_bounded(spark, shop):
    assert max(r.ddl.count(";") for r in queries._shop(spark, shop).scripts.collect()) <= 100
