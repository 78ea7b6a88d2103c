"""Consecutive numbers in a total order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialise


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds 0, 1, 2, ... by ``order``: ranges are sorted each on its own, and each range's start is the sum of the sizes
    before it (one row per range). The ranges are stored first, so both steps see the same ones."""
    d = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = d.groupBy("_range").agg(F.count("*").alias("n"))
    start = sizes.select("_range", F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    # one row per range
    return d.withColumn("_in", within).join(F.broadcast(start), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")
