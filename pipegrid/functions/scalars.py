"""Scalar functions over cells, boxes, labels and sizes, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CELL = ("i", "j", "k")


def to_cell(x: Column, origin: float, cell_mm: float) -> Column:
    """The cell that holds a coordinate."""
    return F.floor((x - F.lit(float(origin))) / F.lit(float(cell_mm))).cast("int")


def to_world(c: Column, origin: float, cell_mm: float) -> Column:
    """The centre of a cell."""
    return F.lit(float(origin)) + (c + F.lit(0.5)) * F.lit(float(cell_mm))


def snap_to_centre(x: Column, origin: float, cell_mm: float) -> Column:
    """The centre of the cell that holds a coordinate."""
    return to_world(to_cell(x, origin, cell_mm), origin, cell_mm)


def cell_range(lo: Column, hi: Column, origin: float, cell_mm: float, n: int) -> tuple[Column, Column]:
    """The half-open range of cells that an interval touches, within 0 to n (empty if the first is not below the second)."""
    first = F.greatest(F.floor((lo - F.lit(float(origin))) / F.lit(float(cell_mm))), F.lit(0)).cast("int")
    last = F.least(F.ceil((hi - F.lit(float(origin))) / F.lit(float(cell_mm))), F.lit(n)).cast("int")
    return first, last


def manhattan(a: list[Column], b: list[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(squared_distance(a, b))


def inches(text: Column) -> Column:
    """A mixed number of inches, such as 1-1/4, as the sum of its parts; parts that are no numbers count 0."""

    def part(p: Column) -> Column:
        top, bottom = F.get(F.split(p, "/"), F.lit(0)), F.get(F.split(p, "/"), F.lit(1))
        fraction = F.when(bottom.try_cast("double") != 0, top.try_cast("double") / bottom.try_cast("double"))
        return F.coalesce(F.when(F.contains(p, F.lit("/")), fraction).otherwise(p.try_cast("double")), F.lit(0.0))

    return F.aggregate(F.transform(F.split(F.trim(F.replace(text, F.lit("-"), F.lit(" "))), r"\s+"), part), F.lit(0.0), lambda s, x: s + x)


def pipe_size_mm(size: Column) -> Column:
    """A nominal pipe size in mm: 40A is mm, 1-1/4B inches; of a reducer (AxB) the first; a plain number is mm; else 0."""
    first = F.trim(F.get(F.split(F.upper(F.trim(size)), "X"), F.lit(0)))
    body = F.regexp_extract(first, r"^([0-9./ \-]+?)\s*[AB]?$", 1)
    unit = F.regexp_extract(first, r"([AB])$", 1)
    mm = F.coalesce(body.try_cast("double"), F.lit(0.0))
    return F.coalesce(F.when(body == "", 0.0).when(unit == "B", inches(body) * 25.4).otherwise(mm), F.lit(0.0))


def utility_label(group: Column, utility: Column) -> Column:
    """[group] utility, with ? for what is null or empty."""
    known = lambda c: F.coalesce(F.when(c != "", c), F.lit("?"))
    return F.concat(F.lit("["), known(group), F.lit("] "), known(utility))


def task_radius(diameter: Column, cell_mm: float, base: int, clearance_mm: float = 0.0) -> Column:
    """Cells around a pipe that it takes: half its diameter and the clearance, at least base; base if unknown."""
    cells = F.ceil((diameter / 2 + F.lit(float(clearance_mm))) / F.lit(float(cell_mm))).cast("int")
    return F.when(diameter > 0, F.greatest(F.lit(base), cells)).otherwise(F.lit(base))


def length_ratio(length: Column, straight: Column) -> Column:
    """length over straight, null unless straight is above 1 mm."""
    return F.when(straight > 1.0, length / straight)


def nearly(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Whether a and b agree within a relative and absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)))


def decode_null(token: Column) -> Column:
    r"""The text of a token: \N is null, the empty text stays."""
    return F.when(token != r"\N", token)


def encode_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(r"\N"))


def tier_weights(tokens: Column) -> Column:
    """A map from level to weight, from tokens z:mm separated by commas."""
    pairs = F.transform(F.filter(F.split(tokens, ","), lambda t: t != ""), lambda t: F.struct(F.get(F.split(t, ":"), F.lit(0)).cast("int").alias("z"), F.get(F.split(t, ":"), F.lit(1)).cast("double").alias("mm")))
    return F.map_from_entries(pairs)


def tier_weight(weights: Column, level: Column) -> Column:
    return F.coalesce(F.try_element_at(weights, level), F.lit(0.0))


def format_tiers(weights: Column) -> Column:
    """Tokens z:mm in order of z."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(weights)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")


def direction(di: Column, dj: Column, dk: Column) -> Column:
    """A step as text: the axis (z, then x, then y) and its sign."""
    signed = lambda d, axis: F.concat(F.lit(axis), F.when(d > 0, "+").otherwise("-"))
    return F.when(dk != 0, signed(dk, "Z")).when(di != 0, signed(di, "X")).when(dj != 0, signed(dj, "Y")).otherwise("-")


def nice_spacing(span: Column, lines: int = 10) -> Column:
    """A grid spacing of 1, 2 or 5 times a power of ten for about so many lines over a span."""
    raw = span / F.lit(float(lines))
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    rest = raw / power
    return F.when(span > 0, F.when(rest < 1.5, 1.0).when(rest < 3.5, 2.0).when(rest < 7.5, 5.0).otherwise(10.0) * power).otherwise(1.0)


def grid_cells(lo: Column, hi: Column, cell_mm: float) -> Column:
    """Cells that cover an extent, at least one."""
    return F.greatest(F.ceil((hi - lo) / F.lit(float(cell_mm))), F.lit(1)).cast("int")


def valid_box() -> Column:
    """Whether the box has an extent along every axis."""
    return (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")) & (F.col("max_z") > F.col("min_z"))


def clamped_volume() -> Column:
    """The volume of a box with no edge below 1."""
    out = F.lit(1.0)
    for a in AXES:
        out = out * F.greatest(F.lit(1.0), F.col(f"max_{a}") - F.col(f"min_{a}"))
    return out


def colour(user: Column, by_type: Column, palette: Column) -> Column:
    """The user's colour, else the type's, else the palette's."""
    return F.coalesce(user, by_type, palette)


def in_bounds(i: Column, j: Column, k: Column, shape: tuple[int, int, int]) -> Column:
    return (i >= 0) & (i < shape[0]) & (j >= 0) & (j < shape[1]) & (k >= 0) & (k < shape[2])
