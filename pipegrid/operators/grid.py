"""Occupancy as a table of distinct cells (scene_id, i, j, k): voxelizing, growing, distances, layers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.functions.scalars import CELL, cell_range, in_bounds, valid_box

CELLS_LIMIT = 80_000_000


def check_grid(shape: tuple[int, int, int], cell_mm: float, limit: int = CELLS_LIMIT) -> None:
    """Raise ValueError for a grid without cells or with more than limit."""
    if cell_mm <= 0 or min(shape) <= 0:
        raise ValueError("a grid needs a positive cell size and shape")
    if shape[0] * shape[1] * shape[2] > limit:
        raise ValueError(f"the grid has more than {limit} cells")


def by_scene(df: DataFrame) -> DataFrame:
    """df dealt by scene, in as many parts as spark.sql.shuffle.partitions says: before rows become many, which no size estimate sees.

    Groups by scene and cell then need no further shuffle; the number is given, so that small parts are not put together again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id")


def box_cells(boxes: DataFrame, shape: tuple[int, int, int], cell_mm: float, origin=(0.0, 0.0, 0.0), keep: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """The cells of each box (half-open, clipped to the grid) with the columns keep; boxes without extent have none."""
    out = by_scene(boxes.where(valid_box()))
    for a, c, o, n in zip("xyz", CELL, origin, shape, strict=True):
        first, last = cell_range(F.col(f"min_{a}"), F.col(f"max_{a}"), o, cell_mm, n)
        out = out.withColumn(f"{c}0", first).withColumn(f"{c}1", last).where(F.col(f"{c}0") < F.col(f"{c}1"))
    for c in CELL:
        out = out.withColumn(c, F.explode(F.sequence(F.col(f"{c}0"), F.col(f"{c}1") - 1)))
    return out.select(*keep, *CELL)


def voxelize(boxes: DataFrame, shape, cell_mm: float, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """The occupancy of boxes."""
    return box_cells(boxes, shape, cell_mm, origin).distinct()


def newly_blocked(boxes: DataFrame, shape, cell_mm: float, order: str = "object_id") -> DataFrame:
    """How many cells each box blocks first when boxes are added in order, per scene."""
    own = box_cells(boxes, shape, cell_mm, keep=("scene_id", order))
    return own.groupBy("scene_id", *CELL).agg(F.min(order).alias(order)).groupBy("scene_id", order).agg(F.count(F.lit(1)).alias("newly"))


def ball(radius: int, connectivity: int = 6) -> list[tuple[int, int, int, int]]:
    """Offsets within radius with their distance: manhattan for 6 neighbours, the largest step for 26."""
    if connectivity not in (6, 26) or radius < 0:
        raise ValueError("connectivity is 6 or 26, and a radius is not negative")
    out = []
    for d in product(range(-radius, radius + 1), repeat=3):
        far = sum(map(abs, d)) if connectivity == 6 else max(map(abs, d))
        if far <= radius:
            out.append((*d, far))
    return out


def _grown(cells: DataFrame, radius: int, connectivity: int, shape) -> DataFrame:
    """cells moved by each offset of a ball, with the distance; a fixed list of offsets, not a join."""
    offsets = F.array(*(F.struct(*(F.lit(x).alias(a) for x, a in zip(o, ("di", "dj", "dk", "d"), strict=True))) for o in ball(radius, connectivity)))
    out = cells.withColumn("o", F.explode(offsets)).select(*(c for c in cells.columns if c not in CELL), *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in CELL), F.col("o.d").alias("d"))
    return out.where(in_bounds(F.col("i"), F.col("j"), F.col("k"), shape))


def inflate(cells: DataFrame, radius: int, connectivity: int, shape) -> DataFrame:
    """cells and all within radius of them, in one step."""
    return _grown(cells, radius, connectivity, shape).drop("d").distinct()


def clearance(cells: DataFrame, radius: int, connectivity: int, shape) -> DataFrame:
    """Cells nearer than radius to an obstacle, with that distance; all others are at radius."""
    near = _grown(cells, radius, connectivity, shape)
    return near.groupBy("scene_id", *CELL).agg(F.min("d").alias("d"))


def dense(scenes: DataFrame, cells: DataFrame, shape) -> DataFrame:
    """All cells of the scenes (rows of scene_id) with blocked. Joined by words of 64 cells, so that no cell is sorted or moved alone."""
    check_grid(shape, 1.0)
    n, (_, ny, nz) = shape[0] * shape[1] * shape[2], shape
    inside = cells.where(in_bounds(F.col("i"), F.col("j"), F.col("k"), shape)).select("scene_id", ((F.col("i") * ny + F.col("j")) * nz + F.col("k")).alias("p"))
    taken = inside.groupBy("scene_id", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("bits"))
    words = by_scene(scenes.select("scene_id").distinct()).withColumn("word", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 64))))
    out = words.join(taken.hint("merge"), ["scene_id", "word"], "left").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(63))))
    out = out.select("scene_id", (F.col("word") * 64 + F.col("b")).alias("p"), F.coalesce(F.expr("shiftrightunsigned(bits, b) & 1") == 1, F.lit(False)).alias("blocked")).where(F.col("p") < n)
    cell = {"i": F.expr(f"p div {ny * nz}"), "j": F.expr(f"p div {nz}") % ny, "k": F.col("p") % nz}
    return out.select("scene_id", *(c.cast("int").alias(a) for a, c in cell.items()), "blocked")


def blocked(probes: DataFrame, cells: DataFrame, shape) -> DataFrame:
    """probes with blocked: outside the grid, or occupied."""
    found = probes.join(cells.select("scene_id", *CELL).withColumn("hit", F.lit(True)).hint("merge"), ["scene_id", *CELL], "left")
    return found.withColumn("blocked", ~in_bounds(F.col("i"), F.col("j"), F.col("k"), shape) | F.coalesce("hit", F.lit(False))).drop("hit")


def coarse(cells: DataFrame, factor: int) -> DataFrame:
    """The coarse cells that hold any of cells."""
    return cells.select("scene_id", *(F.floor(F.col(c) / factor).cast("int").alias(c) for c in CELL)).distinct()


def mark_pipe(cells: DataFrame, path: DataFrame, radius: int, shape) -> DataFrame:
    """cells with the paths and radius steps of free cells around them: blocked cells neither join nor are grown through."""
    keys = ["scene_id", *CELL]
    edge = path.select(keys).distinct()
    taken = cells.select(keys).unionByName(edge)
    for n in range(radius):
        edge = inflate(edge, 1, 6, shape).select(keys)
        if n + 1 < radius:  # of the last round only new cells are left by the distinct
            edge = edge.join(taken.hint("merge"), keys, "left_anti")
        taken = taken.unionByName(edge)
    return taken.distinct()


def add_corridor(corridor: DataFrame, path: DataFrame, radius: int, shape) -> DataFrame:
    """corridor with the paths and radius steps around them, through any cell of the grid that is not in it yet."""
    keys = ["scene_id", *CELL]
    edge = path.select(keys).distinct()
    taken = corridor.select(keys).unionByName(edge)
    for n in range(radius):
        edge = inflate(edge, 1, 6, shape).select(keys)
        if n + 1 < radius:  # of the last round only new cells are left by the distinct
            edge = edge.join(taken.hint("merge"), keys, "left_anti")
        taken = taken.unionByName(edge)
    return taken.distinct()


def snap(probes: DataFrame, cells: DataFrame, radius: int, shape, keep_blocked: bool = True) -> DataFrame:
    """probes (probe_id, scene_id, i, j, k) with the nearest free cell within radius (per axis), as ni, nj, nk.

    Nearest by manhattan distance, then by offset. A free cell snaps to itself; without any, the cell itself or null.
    """
    steps = sorted(((sum(map(abs, d)), *d) for d in product(range(-radius, radius + 1), repeat=3)))
    offsets, own = (F.array(*(F.struct(*(F.lit(x).alias(a) for x, a in zip(o, ("d", "di", "dj", "dk"), strict=True))) for o in some)) for some in (steps, steps[:1]))
    taken = cells.select("scene_id", *CELL)
    told = blocked(probes.select("probe_id", "scene_id", *CELL), taken.distinct(), shape)  # a free cell needs no others
    near = told.withColumn("o", F.explode(F.when(F.col("blocked"), offsets).otherwise(own))).select("probe_id", "scene_id", "o", *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in CELL))
    free = near.where(in_bounds(F.col("i"), F.col("j"), F.col("k"), shape)).join(taken.hint("merge"), ["scene_id", *CELL], "left_anti")
    best = free.groupBy("probe_id").agg(F.min_by(F.struct(*CELL), F.col("o")).alias("n"))
    out = probes.join(best.hint("merge"), "probe_id", "left")
    return out.select(*probes.columns, *((F.coalesce(F.col(f"n.{c}"), F.col(c)) if keep_blocked else F.col(f"n.{c}")).alias(f"n{c}") for c in CELL))


def order_within(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
