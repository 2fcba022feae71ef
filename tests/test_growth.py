"""Queries whose rows become many after reading: no size estimate sees them, so they are neither broadcast nor left to one task."""

from __future__ import annotations

from itertools import product

import pytest

from pipegrid.operators import grid as G
from pipegrid.plans import registry
from pipegrid.sources import derived as D

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["grd_dense", "j_snap_or_null", "set_corridor", "j_path_hits", "j_snap", "j_blockers"])
def test_cells_are_not_broadcast(spark, name):
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_snap_stays_merged_when_run(spark):
    """The plan as it ran, since adaptive execution may change joins: nothing goes through the driver."""
    df = registry.queries()["j_snap"](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_paths_are_spread_before_they_become_many(spark):
    assert D.paths(spark, FOLDER).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dense_of_a_shape_that_words_do_not_fill(spark):
    shape, taken = (5, 3, 7), {(1, 0, 0, 0), (1, 4, 2, 6), (1, 2, 1, 3), (2, 1, 1, 1), (2, 9, 0, 0), (2, 0, 0, 7), (3, 0, 0, 0)}
    cells = spark.createDataFrame(sorted(taken), "scene_id int, i int, j int, k int")
    got = [tuple(r) for r in G.dense(spark.createDataFrame([(1,), (2,), (2,), (4,)], "scene_id int"), cells, shape).collect()]
    assert sorted(got) == [(s, *c, (s, *c) in taken) for s in (1, 2, 4) for c in product(*map(range, shape))]


def test_snap_among_free_blocked_and_outer_cells(spark):
    shape, taken = (6, 5, 4), {(1, *c) for c in product(range(5), range(5), range(4)) if c != (2, 2, 1)} | {(2, 0, 0, 0)}
    probes = [(1, 1, 2, 2, 1), (2, 1, 1, 1, 1), (3, 1, 0, 0, 0), (4, 2, 0, 0, 0), (5, 2, 3, 3, 3), (6, 2, -1, 0, 0), (7, 2, 9, 9, 9)]

    def nearest(s, *c):
        found = [(sum(map(abs, o)), *o) for o in product(range(-1, 2), repeat=3) if all(0 <= x + d < n for x, d, n in zip(c, o, shape, strict=True)) and (s, *(x + d for x, d in zip(c, o, strict=True))) not in taken]
        return tuple(x + d for x, d in zip(c, min(found)[1:], strict=True)) if found else (None,) * 3

    rows = spark.createDataFrame(probes, "probe_id int, scene_id int, i int, j int, k int")
    cells = spark.createDataFrame(sorted(taken), "scene_id int, i int, j int, k int")
    got = G.snap(rows, cells, 1, shape, keep_blocked=False).select("probe_id", "ni", "nj", "nk").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {p: nearest(*rest) for p, *rest in probes}


def test_route_metrics_of_a_repeated_route(spark, tmp_path):
    """The smallest equipment and the smallest total of a route, whichever rows they come from."""
    spark.createDataFrame([(1, 6, 9.0), (1, 9, 5.0), (2, 16, 7.0), (3, 5, 1.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(s, f"s{s}", 0, 0.0) for s in range(100)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    own = [s for s in range(100) if s % 3 == 0 and 500 <= s % 60 * 100 <= 4000]
    orders = {1: ((6, 9.0), (9, 5.0)), 2: ((6, 7.0),), 3: ((5, 1.0),)}
    want = {(o, min(s for d, _ in rows for s in own if s % 10 == d), min(t for _, t in rows)) for o, rows in orders.items()}
    df = registry.queries()["src_route_metrics"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.rindex("Aggregate") > plan.index("Join")  # equipment is one row per digit before the join
