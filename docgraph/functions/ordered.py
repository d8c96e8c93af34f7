"""Numbering of all rows in an order, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed


def in_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the place of each row in the order, from 1. Rows are dealt by ranges, each range numbers its own, and the counts of the
    ranges, as many as there are partitions, say where each begins. Rows that are alike in the order are numbered in any order."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rows = ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_range")
    return rows.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_before")
