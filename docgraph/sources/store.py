"""The vector store as tables: records with their vectors, and edges. Written as Parquet by kind, so lookups of a kind read its files alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("kind", "record_id", "text", "file_id", "source_ref", "section_path", "topic", "char_offset", "extra_json", "display_text")


def aligned(records: DataFrame, vectors: DataFrame, dim: int, key: tuple[str, ...] = ("kind", "record_id")) -> DataFrame:
    """records with their vectors; reading it fails where a record has no vector, a vector no record, or another dimension."""
    both = records.withColumn("_r", F.lit(True)).join(vectors.withColumn("_v", F.lit(True)), list(key), "full_outer")
    bad = F.col("_r").isNull() | F.col("_v").isNull() | (F.size("embedding") != dim)
    name = F.concat_ws("/", *key)
    fine = F.when(bad, F.raise_error(F.concat(F.lit("record and vector do not align: "), name)).cast("boolean")).otherwise(F.lit(True))
    return both.filter(fine).drop("_r", "_v")


def add(records: DataFrame, vectors: DataFrame, dim: int, path: str) -> None:
    aligned(records, vectors, dim).write.mode("append").partitionBy("kind").parquet(f"{path}/records")


def first_labels(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each pair of ends, with the label that came first."""
    ends = ("src_kind", "src_id", "dst_kind", "dst_id")
    return edges.groupBy(*ends).agg(F.min_by("edge_kind", order).alias("edge_kind"))


def add_edges(edges: DataFrame, path: str, order: str) -> int:
    """Append edges whose ends no stored edge joins; how many came. An empty list still makes the table."""
    spark = edges.sparkSession
    new = first_labels(edges, order)
    old = stored_edges(spark, path)
    if old is not None:
        new = new.join(old.select("src_kind", "src_id", "dst_kind", "dst_id"), ["src_kind", "src_id", "dst_kind", "dst_id"], "left_anti")
    before = 0 if old is None else old.count()
    new.write.mode("append").parquet(f"{path}/edges")
    return stored_edges(spark, path).count() - before


def stored_edges(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/edges")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema("src_kind string, src_id string, dst_kind string, dst_id string, edge_kind string").parquet(f"{path}/edges")


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records")


def counts_by_kind(stored: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Records of each kind, known kinds without any included."""
    spark = stored.sparkSession
    kinds = spark.range(1).select(F.explode(F.array(*map(F.lit, known))).alias("kind"))
    found = stored.groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.join(found, "kind", "full_outer").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
