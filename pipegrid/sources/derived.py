"""Scenes derived from whole order tables: boxes, tasks, existing designs and equipment on grids of 100 mm cells.

Every part is a box, every customer a task, every line item a piece of an existing design, every supplier an equipment. A scene has
200 parts and 150 customers, so that more data make more scenes, not denser ones. Routes are searched in smaller scenes of
their own (every part a box, every supplier a task): a search costs far more than a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipegrid.functions.scalars import pipe_size_mm, utility_label
from pipegrid.operators.grid import by_scene

SHAPE, CELL_MM = (64, 64, 16), 100.0
#: The grid of the scenes in which routes are searched, and how many suppliers share one.
ROUTED_SHAPE, ROUTED = (32, 32, 8), 10

#: Utilities and pipe sizes by customer number; fixed values.
UTILITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SIZES = ("40A", "1/2B", "1-1/4B", "65", "1/4BX1/2B", None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with type, name and id, one for every part; some have no type, some no height."""
    p, q = F.col("p_partkey"), F.col("p_size").cast("int")
    shift, edge = F.when(q % 2 == 1, 50).otherwise(0), (1 + q % 4) * 100
    kind = F.when(p % 11 == 0, F.lit(None)).when(p % 13 == 0, "").when(q % 3 == 0, " OST_Floors ").when(q % 3 == 1, "OST_StructuralFraming").otherwise("OST_GenericModel")
    low = {"x": p % 64 * 100 + shift, "y": (p * 7 + F.floor(p / 64) * 17) % 64 * 100 + shift, "z": F.floor(p / 8) % 16 * 100 + shift}
    scene = F.floor(p / 200)
    return read(spark, sf_dir, "part").select(
        scene.cast("int").alias("scene_id"), F.concat(F.lit("scene_"), scene.cast("string")).alias("source_file"), F.concat_ws("-", "p_partkey", "p_size").alias("object_id"), F.concat(F.lit("box "), p.cast("string")).alias("name"),
        kind.alias("ost_type"), F.when(p % 2 == 0, "beam_structure ").otherwise("COLUMN").alias("ddworks_type"),
        *(c.cast("double").alias(f"min_{a}") for a, c in low.items()), *((c + (F.when(p % 37 == 0, 0).otherwise(edge) if a == "z" else edge)).cast("double").alias(f"max_{a}") for a, c in low.items()),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections to route, one for every customer, with start and end cells and points, utility, group, size and label."""
    c = F.col("c_custkey")
    cells = {"si": F.lit(0), "sj": c % 64, "sk": c % 16, "gi": F.lit(63), "gj": (c * 3 + F.floor(c / 5)) % 64, "gk": F.floor(c / 7) % 16}
    one = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    out = read(spark, sf_dir, "customer").select(
        c.alias("task_id"), F.floor(c / 150).cast("int").alias("scene_id"), *(x.cast("int").alias(a) for a, x in cells.items()),
        F.when(c % 17 != 0, one(UTILITIES, c % 5)).alias("utility"), one("FOP", c % 3).alias("utility_group"), one(SIZES, c % 6).alias("size_text"), (F.abs("c_acctbal") * 30 + 10).alias("price"),
    )
    points = {"sx": "si", "sy": "sj", "sz": "sk", "gx": "gi", "gy": "gj", "gz": "gk"}
    out = out.withColumns({p: (F.col(a) * CELL_MM + 50.0).cast("double") for p, a in points.items()})
    return out.withColumn("label", utility_label(F.col("utility_group"), F.col("utility"))).withColumn("diameter_mm", pipe_size_mm(F.col("size_text")))


def routed_obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the scenes in which routes are searched: one for every part, of one to three cells a side."""
    p = F.col("p_partkey")
    kind = F.when(p % 9 == 0, " OST_Floors ").when(p % 7 == 0, "OST_StructuralFraming").otherwise("OST_GenericModel")
    low = {"x": p * 37 % 32, "y": F.floor(p / 3) % 32, "z": F.floor(p / 5) % 8}
    edge = {"x": p % 3 + 1, "y": F.floor(p / 2) % 3 + 1, "z": F.floor(p / 4) % 3 + 1}
    return read(spark, sf_dir, "part").select(
        F.floor(p / (20 * ROUTED)).cast("int").alias("scene_id"), p.cast("string").alias("object_id"), kind.alias("ost_type"), F.when(p % 2 == 0, "beam_structure ").otherwise("COLUMN").alias("ddworks_type"),
        *((c * CELL_MM).cast("double").alias(f"min_{a}") for a, c in low.items()), *(((low[a] + c) * CELL_MM).cast("double").alias(f"max_{a}") for a, c in edge.items()),
    )


def routed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connections to search routes for: one for every supplier, across the scene of its ten."""
    s = F.col("s_suppkey")
    cells = {"si": F.lit(0), "sj": s * 5 % 32, "sk": s % 8, "gi": F.lit(31), "gj": (s * 11 + 3) % 32, "gk": F.floor(s / 3) % 8}
    out = read(spark, sf_dir, "supplier").select(
        s.alias("task_id"), F.floor(s / ROUTED).cast("int").alias("scene_id"), *(x.cast("int").alias(a) for a, x in cells.items()),
        F.when(s % 17 != 0, F.concat(F.lit("U"), (F.col("s_nationkey") % 3).cast("string"))).alias("utility"), F.get(F.array(*map(F.lit, "FOP")), (s % 3).cast("int")).alias("utility_group"),
        F.get(F.array(*map(F.lit, SIZES)), (s % 6).cast("int")).alias("size_text"),
    )
    points = {"sx": "si", "sy": "sj", "sz": "sk", "gx": "gi", "gy": "gj", "gz": "gk"}
    out = out.withColumns({p: (F.col(a) * CELL_MM + 50.0).cast("double") for p, a in points.items()})
    return out.withColumn("label", utility_label(F.col("utility_group"), F.col("utility"))).withColumn("diameter_mm", pipe_size_mm(F.col("size_text")))


def staircase(own: DataFrame) -> DataFrame:
    """A path per task along x, then y, then z, as rows (task_id, scene_id, pos, i, j, k)."""
    run = lambda a, b: F.sequence(F.col(a), F.col(b))
    cell = lambda i, j, k: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"))
    after = lambda a, b: F.slice(run(a, b), F.lit(2), F.greatest(F.abs(F.col(b) - F.col(a)), F.lit(1)))
    path = F.concat(
        F.transform(run("si", "gi"), lambda x: cell(x, F.col("sj"), F.col("sk"))),
        F.when(F.col("sj") != F.col("gj"), F.transform(after("sj", "gj"), lambda y: cell(F.col("gi"), y, F.col("sk")))).otherwise(F.array().cast("array<struct<i:int,j:int,k:int>>")),
        F.when(F.col("sk") != F.col("gk"), F.transform(after("sk", "gk"), lambda z: cell(F.col("gi"), F.col("gj"), z))).otherwise(F.array().cast("array<struct<i:int,j:int,k:int>>")),
    )
    return by_scene(own).select("task_id", "scene_id", F.posexplode(path).alias("pos", "c")).select("task_id", "scene_id", "pos", "c.i", "c.j", "c.k")


def paths(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    """The staircase paths of all tasks, or of some."""
    return staircase(tasks(spark, sf_dir).where(which))


def segment_details(spark: SparkSession, sf_dir: str, route: str = "l_orderkey") -> DataFrame:
    """Existing designs in pieces: route_guid, order_1, order_2, and the points from and to."""
    own = read(spark, sf_dir, "lineitem")
    at = {"x": F.col("l_partkey") % 8 * 100, "y": F.col("l_suppkey") % 8 * 100, "z": F.col("l_linenumber") * 100}
    to = at | {"x": (F.col("l_partkey") + F.col("l_linenumber") % 2) % 8 * 100}
    return own.select(
        F.col(route).alias("route_guid"), F.col("l_linenumber").alias("order_1"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("order_2"),
        *(c.cast("double").alias(f"from_{a}") for a, c in at.items()), *(c.cast("double").alias(f"to_{a}") for a, c in to.items()),
    ).distinct()


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment boxes with their connection points as JSON."""
    s = F.col("s_suppkey")
    own = read(spark, sf_dir, "supplier")
    end = lambda n: F.struct(F.concat(F.lit("end"), n.cast("string")).alias("endName"), F.concat(F.lit("g"), (s * 10 + n).cast("string")).alias("endInstanceGuid"), F.array((n * 100).cast("double"), (s % 50).cast("double"), F.lit(5.0)).alias("endPocPosition"), (n % 2 == 0).alias("isConnected"))
    poc = lambda n: F.struct(
        F.concat(F.lit("p"), n.cast("string")).alias("name"), F.array((s % 64).cast("double"), n.cast("double"), F.lit(1.0)).alias("pocPosition"), F.when(n != 2, F.concat(F.lit("U"), (s % 3).cast("string"))).alias("utility"),
        F.lit("G").alias("utilityGroup"), F.lit("40A").alias("size"), F.when(n < 3, n != 1).alias("isConnected"), F.transform(F.sequence(F.lit(0), F.lit(2)), end).alias("endPocs"),
    )
    return own.select(
        s.alias("eq_id"), F.col("s_name").alias("name"), s.cast("int").alias("scene_id"), (s % 3 == 0).alias("is_main"),
        (s % 60 * 100).cast("double").alias("min_x"), (s % 50 * 100).cast("double").alias("min_y"), F.lit(0.0).alias("min_z"),
        (s % 60 * 100 + 300).cast("double").alias("max_x"), (s % 50 * 100 + 200).cast("double").alias("max_y"), F.when(s % 10 == 0, 0.0).otherwise(400.0).alias("max_z"),
        F.to_json(F.transform(F.sequence(F.lit(0), F.lit(3)), poc)).alias("poc_list"),
    )
