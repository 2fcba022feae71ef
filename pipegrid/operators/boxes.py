"""Boxes: filters, overlap joins, picking, distances, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.functions.scalars import AXES, clamped_volume, squared_distance, valid_box


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def overlaps(region: dict[str, tuple[float, float]]) -> Column:
    """Whether a box and a region (low and high by axis) share a point; touching counts."""
    return all_of([(F.col(f"max_{a}") >= lo) & (F.col(f"min_{a}") <= hi) for a, (lo, hi) in region.items()])


def select_boxes(boxes: DataFrame, source_file: str | None = None, types: list[str] | None = None, region: dict | None = None, exclude_empty_type: bool = False, skip_degenerate: bool = True, limit: int | None = None) -> DataFrame:
    """Boxes of a source, of some types (none or an empty list: all), overlapping a region; limit is in order of object_id."""
    out = boxes
    if source_file is not None:
        out = out.where(F.col("source_file") == source_file)
    if types:
        out = out.where(F.col("ost_type").isin(types))
    if region is not None:
        out = out.where(overlaps(region))
    if exclude_empty_type:
        out = out.where("ost_type is not null and ost_type <> ''")
    if skip_degenerate:
        out = out.where(valid_box())
    return out if limit is None else out.orderBy("object_id").limit(limit)


def passes_through() -> Column:
    """Floors, ceilings, and structural framing made of beams, whatever case and blanks."""
    kind, works = F.lower(F.trim("ost_type")), F.upper(F.trim("ddworks_type"))
    return F.coalesce(kind.isin("ost_floors", "ost_ceilings") | ((kind == "ost_structuralframing") & (works == "BEAM_STRUCTURE")), F.lit(False))


def box_pairs(left: DataFrame, right: DataFrame, key: str, bucket_mm: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ids (left_id, right_id) of boxes that share a point, and columns on.

    Each box is dealt to the coarse buckets that it covers, which turns the overlap into an equi-join; the exact test
    follows, and a pair is kept only in the first bucket that both boxes cover, so that no distinct is needed.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        low = {a: F.floor(F.col(f"min_{a}") / bucket_mm) for a in AXES}
        high = {a: F.floor(F.col(f"max_{a}") / bucket_mm) for a in AXES}
        out = df.where(all_of([F.col(f"max_{a}") >= F.col(f"min_{a}") for a in AXES])).select(
            *(F.col(c).alias(f"{side}_{c}") for c in on), F.col(key).alias(f"{side}_id"), *(F.col(f"{e}_{a}").alias(f"{side}_{e}_{a}") for e in ("min", "max") for a in AXES), *(low[a].alias(f"{side}_low_{a}") for a in AXES), *(high[a].alias(f"{side}_high_{a}") for a in AXES)
        )
        for a in AXES:
            out = out.withColumn(f"{side}_b_{a}", F.explode(F.sequence(F.col(f"{side}_low_{a}"), F.col(f"{side}_high_{a}"))))
        return out

    a, b = dealt(left, "left"), dealt(right, "right")
    same = [F.col(f"left_{c}") == F.col(f"right_{c}") for c in on] + [F.col(f"left_b_{x}") == F.col(f"right_b_{x}") for x in AXES]
    touch = [(F.col(f"left_max_{x}") >= F.col(f"right_min_{x}")) & (F.col(f"left_min_{x}") <= F.col(f"right_max_{x}")) for x in AXES]
    first = [F.col(f"left_b_{x}") == F.greatest(f"left_low_{x}", f"right_low_{x}") for x in AXES]
    return a.join(b, all_of(same + touch + first)).select("left_id", "right_id", *(F.col(f"left_{c}").alias(c) for c in on))


def pick(points: DataFrame, boxes: DataFrame, eps: float = 1.0, bucket_mm: float = 400.0) -> DataFrame:
    """For each point (point_id, scene_id, x, y, z) the smallest box that holds it within eps; ties by layer, then id.

    Boxes are dealt to the coarse buckets that they cover, so that a point meets the boxes of its own bucket alone.
    """
    covered = boxes.withColumn("volume", clamped_volume()).withColumnRenamed("scene_id", "of")
    for a in AXES:
        low, high = (F.floor((F.col(f"{e}_{a}") + by) / bucket_mm) for e, by in (("min", -eps), ("max", eps)))
        covered = covered.where(F.col(f"max_{a}") >= F.col(f"min_{a}")).withColumn(f"b_{a}", F.explode(F.sequence(low, high)))
    inside = [(F.col(a) >= F.col(f"min_{a}") - eps) & (F.col(a) <= F.col(f"max_{a}") + eps) for a in AXES]
    same = [F.floor(F.col(a) / bucket_mm) == F.col(f"b_{a}") for a in AXES]
    found = points.join(covered, all_of([F.col("scene_id") == F.col("of"), *same, *inside]))
    first = Window.partitionBy("point_id").orderBy("volume", "layer", "object_id")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("point_id", "scene_id", "object_id", "volume")


def squared_gap(point: dict[str, Column]) -> Column:
    """The squared distance from a point to the nearest point of a box."""
    nearest = [F.greatest(F.col(f"min_{a}"), F.least(F.col(f"max_{a}"), c)) for a, c in point.items()]
    return squared_distance(list(point.values()), nearest)


def segment_clear(a: dict[str, Column], b: dict[str, Column], radius: Column) -> Column:
    """Whether a capsule about an axis-aligned segment keeps clear of a box: exact, as the gap between two boxes."""
    gap = F.lit(0.0)
    for x in AXES:
        lo, hi = F.least(a[x], b[x]), F.greatest(a[x], b[x])
        d = F.greatest(F.lit(0.0), F.col(f"min_{x}") - hi, lo - F.col(f"max_{x}"))
        gap = gap + d * d
    return gap > radius * radius


def bounds(boxes: DataFrame, *by: str) -> DataFrame:
    """The smallest box around all boxes."""
    return boxes.groupBy(*by).agg(*(F.min(f"min_{a}").alias(f"min_{a}") for a in AXES), *(F.max(f"max_{a}").alias(f"max_{a}") for a in AXES))


def build_counters(boxes: DataFrame, region: dict) -> DataFrame:
    """Boxes in all, without extent, outside the region, and the rest, in this order of tests."""
    degenerate, outside = ~valid_box(), valid_box() & ~overlaps(region)
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return boxes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("total"), one(degenerate).alias("degenerate"), one(outside).alias("outside"), one(valid_box() & overlaps(region)).alias("voxelized"))
