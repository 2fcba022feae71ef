"""Spark-native spatial routing analytics: boxes, grids, joins, routes and reports as DataFrames."""

from pipegrid.session import get_spark, ship

__all__ = ["get_spark", "ship"]
