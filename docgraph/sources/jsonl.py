"""Line-wise JSON tables by topic: append, tolerant read, byte offsets of malformed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def append_by_topic(df: DataFrame, path: str, topic: str = "topic") -> None:
    """Spark commits files as a whole, so there are no torn tails to repair."""
    df.write.partitionBy(topic).mode("append").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of line-wise JSON."""
    all_ = spark.read.schema(schema.add("_corrupt", "string") if "_corrupt" not in schema.names else schema).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    return all_.filter("_corrupt IS NULL").drop("_corrupt"), all_.filter("_corrupt IS NOT NULL").select("_corrupt")


def malformed(lines: DataFrame, file: str, order: list[str], line: str) -> DataFrame:
    """Lines that are no JSON, with the byte offset at which each begins in its file."""
    w = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length(line) + 1).over(w), F.lit(0)).cast("long")
    return lines.withColumn("byte_offset", at).filter(F.try_parse_json(line).isNull())
