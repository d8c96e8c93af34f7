"""The event fold and its roll-ups as streams. Watermarks are an extension: without them state would grow without end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder


def event_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def timed(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, width: str = "1 day", ts: str = "ts") -> DataFrame:
    """Counts by event-time window and type."""
    by = events.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.round("value", 2).cast("decimal(18,2)")).alias("value"))
    return by.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.col("value").cast("double").alias("value"))


def sessions(events: DataFrame, gap: str = "6 hours", ts: str = "ts") -> DataFrame:
    """Sessions of each user by silence alone."""
    by = events.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return by.select("user_id", F.unix_micros("w.start").alias("start_us"), "events")


def fold(events: DataFrame) -> DataFrame:
    """By user, the fold of all events: first and last event, counts; the state is a row a user."""
    return events.groupBy("user_id").agg(
        F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


#: Keyed state with timers is kept by this provider.
KEYED = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def persisted(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", settings: dict[str, str] | None = None):
    """The started query that writes each micro-batch to the table at path as soon as it is there. A batch is a partition of its own and
    replaces itself when it runs again, so a restart leaves no row twice. settings hold for this query alone."""
    conf = stream.sparkSession.conf

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = {k: conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            conf.set(k, v)
        return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def caught_up(stream: DataFrame, mode: str, settings: dict[str, str] | None = None) -> DataFrame:
    """All that is available now, as a table in the shared folder: the rows of all batches with their number (`batch`), in complete mode those of the last."""
    spark, name = stream.sparkSession, f"stream-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    query = persisted(stream, f"{path}/rows", f"{path}/state", mode, settings)
    query.awaitTermination()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")
    return rows.filter(F.col("batch") == rows.agg(F.max("batch").alias("b")).scalar()).drop("batch") if mode == "complete" else rows
