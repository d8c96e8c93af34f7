"""Shared plumbing of the training-data operators: tables in the shared folder, Arrow limits, ordered numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows and bytes of one Arrow batch that a Python worker holds.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20

#: A side is broadcast only after its rows were counted and found to be no more than this.
BROADCAST_ROWS = 200_000


#: Share of a mean partition beyond which the rows of one key are dealt over several tasks.
HOT = 1 / 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bound the bytes that a Python worker gets at once. The settings stay: results do not depend on them, and plans read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # unions of differently dealt sides may else fail to plan


def settle(keep: str = "") -> None:
    """Give back what a worker holds from earlier tasks: caches other than keep's, Arrow's pool, the allocator's free pages."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    tokens = sys.modules.get("docgraph.llm.tokens")
    if tokens is not None and keep != "tokens":
        tokens._OPEN.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | T.StructType, keep: str = "", rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow in batches of so many rows at most, with workers that settle() before and after a task."""
    arrow_limits(df.sparkSession)

    def task(batches: Iterator) -> Iterator:
        settle(keep)
        yield from run(b.slice(at, rows) for b in batches for at in range(0, max(1, b.num_rows), rows))
        settle(keep)

    return df.mapInArrow(task, schema)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it. Where none is set, an own one is made on one machine (in
    tests), and on a cluster that is an error."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="docgraph-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def stored(df: DataFrame, name: str, done: Sequence[DataFrame] = ()) -> DataFrame:
    """Write df as a table into the shared folder and read it back: lineage ends there and a lost executor costs nothing already written.
    done: tables of stored() that nothing reads after df is written; they are deleted then."""
    spark = df.sparkSession
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    spark.conf.set(setting, "true")  # shuffle files go when the table is there
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than limit rows (counted), else df as it is, for a shuffled join that AQE may split."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, _salts) of the keys whose rows in df outweigh HOT of a mean partition, to be broadcast: partitions / HOT of them at
    most, whatever the data."""
    return hot_counts(df.groupBy(key).agg(F.count("*").alias("_k")), key, "_k", df.count())


def hot_counts(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The same from counts (key, n) that are there already."""
    most = max(32, int(total / int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * HOT))
    return F.broadcast(counts.select(key, F.ceil(F.col(n) / most).cast("int").alias("_salts")).filter("_salts > 1"))


def dealt_join(rows: DataFrame, keyed: DataFrame, key: str, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with the one row of keyed for each key; rows of hot keys, and those without a key, are dealt by the hash of column by."""
    salts = F.when(F.col(key).isNull(), 1024).otherwise(F.coalesce("_salts", F.lit(1)))
    rows = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    keyed = keyed.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return rows.join(keyed, [key, "_salt"], how).drop("_salt")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def range_bucket(df: DataFrame, key: str, parts: int) -> Column:
    """The number of key's range among about equal ranges, ascending; null keys come first (-1).

    The bounds are quantiles of key alone (a scan of one column), so they are the same whenever the plan runs again."""
    bounds = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).head()[0] or []
    cuts = F.array(*[F.lit(x) for x in sorted(set(bounds))]) if bounds else F.array(F.lit(0).cast("long"))
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda x: x < F.col(key)))).cast("int")


def offsets_before(df: DataFrame, order: Sequence[str], sums: dict[str, str], bucket: str) -> DataFrame:
    """Add, for each name: column of sums, the sum of column over all rows before this one in the order (bucket, *order).

    Two levels: sums inside a bucket by a window, and sums of whole buckets, of which there are few."""
    totals = df.groupBy(bucket).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(bucket, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()])
    out = out.join(F.broadcast(totals), bucket, "left")  # as many rows as there are buckets
    for n in sums:
        out = out.withColumn(n, (F.col(f"_i_{n}") + F.col(f"_b_{n}")).cast("long"))
    return out.drop(*[f"_{k}_{n}" for k in "ib" for n in sums])
