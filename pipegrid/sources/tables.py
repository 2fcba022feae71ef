"""Tables of a design database: connections from JSON, and JDBC options."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipegrid.functions.scalars import pipe_size_mm, utility_label

_POINT = T.ArrayType(T.DoubleType())
_END = T.StructType([T.StructField("endName", T.StringType()), T.StructField("endType", T.StringType()), T.StructField("endPocGuid", T.StringType()), T.StructField("endInstanceGuid", T.StringType()), T.StructField("endPocPosition", _POINT), T.StructField("isConnected", T.BooleanType())])
POC_LIST = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("pocPosition", _POINT), T.StructField("utility", T.StringType()), T.StructField("utilityGroup", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("isConnected", T.BooleanType()), T.StructField("endPocs", T.ArrayType(_END)),
]))


def poc_tasks(equipment: DataFrame) -> DataFrame:
    """A task for each connected start and connected end in poc_list; missing isConnected counts as not connected.

    A missing position is the origin. Malformed JSON gives no task.
    """
    starts = equipment.withColumn("poc", F.explode(F.from_json("poc_list", POC_LIST))).where(F.coalesce("poc.isConnected", F.lit(False)))
    both = starts.withColumn("end", F.explode("poc.endPocs")).where(F.coalesce("end.isConnected", F.lit(False)))
    at = lambda c, n: F.coalesce(F.get(F.col(c), F.lit(n)), F.lit(0.0))
    points = [at("poc.pocPosition", n).alias(f"s{a}") for n, a in enumerate("xyz")] + [at("end.endPocPosition", n).alias(f"g{a}") for n, a in enumerate("xyz")]
    return both.select("eq_id", "scene_id", F.col("poc.name").alias("poc_name"), utility_label(F.col("poc.utilityGroup"), F.col("poc.utility")).alias("label"), F.col("end.endName").alias("end_name"), *points, pipe_size_mm(F.col("poc.size")).alias("diameter_mm"))


def jdbc_options(**given: str) -> dict[str, str]:
    """Options for a PostgreSQL reader: what is given, else PGHOST, PGPORT, PGDATABASE, PGUSER and PGPASSWORD; no default secret."""
    value = lambda name, default: given.get(name) or os.environ.get(f"PG{name.upper()}", default)
    url = f"jdbc:postgresql://{value('host', 'localhost')}:{value('port', '5432')}/{value('database', 'postgres')}"
    return {"url": url, "user": value("user", "postgres"), "password": value("password", ""), "driver": "org.postgresql.Driver"}


def read_jdbc(spark, table: str, **given: str) -> DataFrame:
    """A table through JDBC; filters and column lists reach the database."""
    return spark.read.format("jdbc").options(**jdbc_options(**given), dbtable=table).load()
