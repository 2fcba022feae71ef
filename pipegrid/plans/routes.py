"""Queries that route: single, independent, sequential, rip-up, tube, subset, and the design comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipegrid.functions import scalars as S
from pipegrid.operators import boxes as B
from pipegrid.operators import grid as G
from pipegrid.operators import paths as P
from pipegrid.operators.routing import Params, Plan, route_scenes
from pipegrid.plans.registry import query
from pipegrid.session import ship
from pipegrid.sources import derived as D

#: The weights of the derived scene, on its 100 mm cells.
WEIGHTS = Params(cell_mm=D.CELL_MM, w_turn=500.0, w_clear=10.0, clearance_radius=2)
#: Expansions after which a route is given up (None: never), rounds and blockers of rip-up: the reference's own defaults.
MOST, ROUNDS, BLOCKERS = None, 10, 4


def _occupied(spark, sf, without_passing: bool = False):
    boxes = D.routed_obstacles(spark, sf)
    return G.voxelize(boxes.where(~B.passes_through()) if without_passing else boxes, D.ROUTED_SHAPE, D.CELL_MM)


def _routes(spark, sf, mode: str, plan: Plan, tasks=None, **more):
    ship(spark)
    return route_scenes(D.routed_tasks(spark, sf) if tasks is None else tasks, _occupied(spark, sf), D.ROUTED_SHAPE, plan, mode, **more)


def _digest(routes):
    cells = F.transform("path", lambda c: F.concat_ws(",", c["i"], c["j"], c["k"]))
    return routes.withColumn("path", F.array_join(cells, " "))


@query("rt_single")
def rt_single(spark, sf):
    return _digest(_routes(spark, sf, "single", Plan(WEIGHTS, most=MOST)))


@query("rt_independent")
def rt_independent(spark, sf):
    return _digest(_routes(spark, sf, "independent", Plan(WEIGHTS, most=MOST)))


@query("rt_tube")
def rt_tube(spark, sf):
    return _digest(_routes(spark, sf, "tube", Plan(WEIGHTS), tube=(2, 2)))


@query("rt_sequential")
def rt_sequential(spark, sf):
    return _digest(_routes(spark, sf, "sequential", Plan(WEIGHTS, most=MOST)))


@query("rt_ripup")
def rt_ripup(spark, sf):
    return _digest(_routes(spark, sf, "ripup", Plan(WEIGHTS, most=MOST, rounds=ROUNDS, most_blockers=BLOCKERS)))


@query("rt_subset")
def rt_subset(spark, sf):
    """The tasks of one utility group routed anew; the others keep the straight estimate as their result."""
    own = D.routed_tasks(spark, sf)
    fresh = _routes(spark, sf, "single", Plan(WEIGHTS, most=MOST), own.where("utility_group = 'P'")).select("task_id", "length_mm", "success")
    kept = own.select("task_id", (S.manhattan([F.col("si"), F.col("sj"), F.col("sk")], [F.col("gi"), F.col("gj"), F.col("gk")]) * D.CELL_MM).alias("before"))
    return kept.join(fresh, "task_id", "left").select("task_id", F.coalesce("length_mm", "before").alias("length_mm"), F.col("success").isNotNull().alias("routed"))


@query("rt_metrics")
def rt_metrics(spark, sf):
    """Per scene: tasks, successes, share and length of the independent routes."""
    ok = F.col("success")
    out = _routes(spark, sf, "independent", Plan(WEIGHTS, most=MOST)).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("ok"), F.coalesce(F.sum(F.when(ok, F.col("length_mm"))), F.lit(0.0)).alias("length_mm"))
    return out.withColumn("rate", F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(0.0))


@query("rt_polylines")
def rt_polylines(spark, sf):
    """World points of the shortest routes; a failed task is its straight line."""
    routes = _routes(spark, sf, "single", Plan(WEIGHTS, most=MOST)).select("task_id", "success", "path")
    point = lambda c: F.struct(*(S.to_world(c[x], 0.0, D.CELL_MM).alias(a) for a, x in zip("xyz", "ijk", strict=True)))
    ends = F.array(*(F.struct(*(F.col(f"{e}{a}").alias(a) for a in "xyz")) for e in "sg"))
    own = D.routed_tasks(spark, sf).join(routes, "task_id")
    line = F.when(F.col("success"), F.transform("path", point)).otherwise(ends)
    return own.select("task_id", "success", F.posexplode(line).alias("pos", "p")).select("task_id", "success", "pos", "p.x", "p.y", "p.z")


@query("compare_by_group")
def compare_by_group(spark, sf):
    """Design against engine by utility group: boxes that let pipes pass are left out, routes are independent, snap 3."""
    ship(spark)
    own = D.routed_tasks(spark, sf)
    routes = route_scenes(own, _occupied(spark, sf, True), D.ROUTED_SHAPE, Plan(WEIGHTS, snap_radius=3, most=MOST), "independent")
    design = P.polylines(D.segment_details(spark, sf, "l_suppkey")).select(F.col("route_guid").alias("task_id"), F.aggregate(F.zip_with(F.slice("line", F.lit(2), F.size("line")), "line", lambda q, p: F.when(q.isNotNull(), S.distance([p["x"], p["y"], p["z"]], [q["x"], q["y"], q["z"]])).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x).alias("design_mm"), (F.size("line") - 2).alias("design_bends"))
    both = own.join(routes.drop("scene_id"), "task_id").join(design, "task_id", "left").withColumn("ratio", S.length_ratio(F.col("length_mm"), F.col("design_mm")))
    ok = F.col("success")
    return both.groupBy("utility_group").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ok, 1)).alias("ok"), F.round(F.avg(F.when(ok, F.col("length_mm"))), 3).alias("length_mm"), F.round(F.avg(F.when(ok, F.col("design_mm"))), 3).alias("design_mm"),
        F.round(F.coalesce(F.median(F.when(ok, F.col("ratio"))), F.lit(0.0)), 6).alias("median_ratio"), F.round(F.avg(F.when(ok, F.col("turns"))), 3).alias("turns"), F.round(F.avg(F.when(ok, F.col("design_bends"))), 3).alias("design_bends"),
    ).orderBy("utility_group")
