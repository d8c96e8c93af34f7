"""Markdown export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def escaped_tags(text: Column) -> Column:
    """Hash signs escaped, so that they are no tags."""
    return F.replace(text, F.lit("#"), F.lit("\\#"))


def pages(lines: DataFrame, key: str, order: list[str], line: str, folder: str) -> DataFrame:
    """path and content of one page a key: its heading and its lines in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(line).alias("_l")))), lambda x: x["_l"])
    content = F.concat(F.lit("# "), F.col(key), F.lit("\n\n"), F.array_join(listed, "\n"))
    return lines.groupBy(key).agg(content.alias("content")).select(F.concat(F.lit(folder), F.col(key), F.lit(".md")).alias("path"), "content")


def first_refs(df: DataFrame, key: str, order: list[str], ref: str, k: int) -> DataFrame:
    """The first k references of each key, and how many more there are. No task holds more than k of a key's."""
    n = df.groupBy(key).agg(F.count("*").alias("_n"))
    top = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= k)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", ref))), lambda x: x[ref]), " ")
    more = F.when(F.col("_n") > k, F.concat(F.lit(" +"), (F.col("_n") - k).cast("string"), F.lit(" more"))).otherwise("")
    return top.groupBy(key).agg(listed.alias("refs")).join(n, key).select(key, F.concat("refs", more).alias("refs"))


def cut_at_level(df: DataFrame, level: str, most: int) -> DataFrame:
    """How many records a privacy level keeps and cuts."""
    return df.groupBy(F.when(F.col(level) <= most, "kept").otherwise("cut").alias("side")).agg(F.count("*").alias("records"))
