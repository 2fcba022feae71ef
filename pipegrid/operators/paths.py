"""Paths as ordered cells (task_id, scene_id, pos, i, j, k): turns, segments, sharing, polylines, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.functions.scalars import CELL, direction, manhattan, squared_distance


def _along():
    return Window.partitionBy("task_id").orderBy("pos")


def steps(path: DataFrame) -> DataFrame:
    """path with the step (di, dj, dk) that leads to each cell, null at the first."""
    return path.withColumns({f"d{c}": F.col(c) - F.lag(c).over(_along()) for c in CELL})


def turns(path: DataFrame) -> DataFrame:
    """Per task the number of changes of direction."""
    own = steps(path)
    step = F.struct("di", "dj", "dk")
    changed = own.withColumn("before", F.lag(step).over(_along())).withColumn("turn", (F.col("pos") > 1) & (step != F.col("before")))
    return changed.groupBy("task_id").agg(F.coalesce(F.sum(F.col("turn").cast("int")), F.lit(0)).cast("long").alias("turns"), (F.count(F.lit(1)) - 1).cast("long").alias("steps"))


def segments(path: DataFrame) -> DataFrame:
    """The straight pieces of each path: number, direction, first and last cell, steps."""
    own = steps(path).where("di is not null").withColumn("dir", direction(F.col("di"), F.col("dj"), F.col("dk")))
    fresh = F.coalesce((F.col("dir") != F.lag("dir").over(_along())).cast("int"), F.lit(1))
    own = own.withColumn("segment", F.sum(fresh).over(_along()))
    cell = F.struct(*CELL)
    out = own.groupBy("task_id", "segment").agg(F.first("dir").alias("dir"), F.min_by(F.struct(*((F.col(c) - F.col(f"d{c}")).alias(c) for c in CELL)), "pos").alias("a"), F.max_by(cell, "pos").alias("b"), F.count(F.lit(1)).alias("steps"))
    return out.select("task_id", F.col("segment").cast("long").alias("segment"), "dir", *(F.col(f"a.{c}").alias(f"{c}0") for c in CELL), *(F.col(f"b.{c}").alias(f"{c}1") for c in CELL), F.col("steps").cast("long").alias("steps"))


def broken(path: DataFrame) -> DataFrame:
    """Cells that are not next to the cell before them."""
    own = steps(path).where("di is not null")
    return own.where(manhattan([F.col("di"), F.col("dj"), F.col("dk")], [F.lit(0)] * 3) != 1).select("task_id", "pos")


def shared_cells(path: DataFrame) -> DataFrame:
    """Cells that several tasks of a scene use."""
    return path.groupBy("scene_id", *CELL).agg(F.countDistinct("task_id").alias("tasks")).where("tasks > 1")


def sharing_pairs(path: DataFrame) -> DataFrame:
    """Pairs of tasks of a scene (a below b) that share a cell; only cells that are shared reach the join."""
    own = path.select("scene_id", *CELL, "task_id").distinct().join(shared_cells(path).drop("tasks"), ["scene_id", *CELL], "left_semi")
    other = own.withColumnRenamed("task_id", "b")
    return own.withColumnRenamed("task_id", "a").join(other, ["scene_id", *CELL]).where("a < b").select("scene_id", "a", "b").distinct()


def hits(path: DataFrame, cells: DataFrame) -> DataFrame:
    """Per task how many of its cells are occupied."""
    taken = cells.select("scene_id", *CELL).distinct().withColumn("hit", F.lit(1))
    return path.join(taken.hint("merge"), ["scene_id", *CELL], "left").groupBy("task_id").agg(F.count("hit").alias("hits"))


def blockers(ideal: DataFrame, placed: DataFrame) -> DataFrame:
    """For each ideal path the placed paths that it crosses, in order."""
    other = placed.select("scene_id", *CELL, F.col("task_id").alias("blocker"))
    found = ideal.join(other.hint("merge"), ["scene_id", *CELL]).where("blocker <> task_id").select("task_id", "blocker").distinct()
    return found.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list("blocker")).cast("array<string>"), ",").alias("blockers"))


def polylines(details: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Per route the points of its pieces in order; a point within tolerance (squared mm) of the last kept one is left out."""
    ends = F.struct(*(F.struct(*(F.col(f"{e}_{a}").alias(a) for a in "xyz")).alias(e) for e in ("from", "to")))
    ordered = details.groupBy("route_guid").agg(F.array_sort(F.collect_list(F.struct("order_1", "order_2", ends.alias("p")))).alias("parts"))
    points = F.flatten(F.transform("parts", lambda s: F.array(s["p"]["from"], s["p"]["to"])))
    kind = "array<struct<x:double,y:double,z:double>>"

    def keep(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = squared_distance([p["x"], p["y"], p["z"]], [last["x"], last["y"], last["z"]]) > tolerance
        return F.when(F.size(kept) == 0, F.array(p)).when(far, F.concat(kept, F.array(p))).otherwise(kept)

    return ordered.select("route_guid", F.aggregate(points, F.array().cast(kind), keep).alias("line"))


def nearest_vertex(line: Column, point: list[Column]) -> Column:
    """The index of the first vertex nearest to a point."""
    far = F.transform(line, lambda p, i: F.struct(squared_distance([p["x"], p["y"], p["z"]], point).alias("d"), i.alias("i")))
    return F.array_min(far)["i"]


def trim(line: Column, a: list[Column], b: list[Column]) -> Column:
    """line between the vertices nearest to a and b; lines of up to two points and ranges under two stay as they are."""
    p, q = nearest_vertex(line, a), nearest_vertex(line, b)
    low, high = F.least(p, q), F.greatest(p, q)
    return F.when((F.size(line) <= 2) | (high - low < 1), line).otherwise(F.slice(line, low + 1, high - low + 1))


def downsample(path: DataFrame, most: int) -> DataFrame:
    """At most `most` cells of each path, evenly by position."""
    size = F.count(F.lit(1)).over(Window.partitionBy("task_id"))
    own = path.withColumn("size", size).withColumn("stride", F.greatest(F.lit(1.0), F.col("size") / most))
    rank = F.floor(F.col("pos") / F.col("stride"))
    taken = lambda n: (F.floor(n * F.col("stride")) == F.col("pos")) & (n < F.least(F.col("size"), F.lit(most)))
    return own.where(taken(rank) | taken(rank + 1)).select("task_id", "pos", *CELL)


def priority(kind: str) -> list:
    """The sort keys of a priority over tasks with label, dist, diameter_mm and task_id."""
    keys = {
        "original": [], "shortest": [F.asc("dist")], "longest": [F.desc("dist")], "utility": [F.asc("label"), F.desc("dist")], "diameter": [F.desc("diameter_mm"), F.desc("dist")],
    }
    if kind not in keys:
        raise ValueError(f"unknown priority {kind}")
    return [*keys[kind], F.asc("task_id")]
