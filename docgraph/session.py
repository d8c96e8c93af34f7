"""The session settings that the engine's results rely on, and what helps at scale."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
}


def session(app: str = "docgraph", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where none is set, one is made on a single machine, and on a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        there = context.getConf().get("spark.checkpoint.dir")
        if not there and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(there or tempfile.mkdtemp(prefix="docgraph-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder that spark.checkpoint.dir names, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df as a table in the shared folder, in folders by the values of some columns, so that readers of one value scan no other."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has no more than so many narrow rows (counted), else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of rows that a Python worker gets at once.
ARROW_BYTES = 4 << 20


def python_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInPandas in batches of so many bytes, whatever the length of a row's texts and the size of a partition. The setting stays: results do not depend on it, and
    plans read it when they run."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInPandas(run, schema)
