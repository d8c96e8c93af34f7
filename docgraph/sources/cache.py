"""Replies and vectors kept between runs: a table by stage and bucket of keys, of which a run reads and replaces the buckets that its own keys fall into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

ENTRY = "cache_key string, stored_at timestamp, value string, vector array<float>, gone boolean, stage string, bucket int"


@dataclass(frozen=True)
class CacheStore:
    """Entries (stage, cache_key, value, vector) at a path that driver and executors share. An entry older than `days` is none. One run writes at a time; of two that write the
    same bucket the later one counts."""

    spark: SparkSession
    where: str
    days: float = 30
    buckets: int = 64

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def entries(self) -> DataFrame:
        """All entries, those that are gone or expired included."""
        return self.spark.read.schema(ENTRY).parquet(self.where) if self._there() else self.spark.createDataFrame([], ENTRY)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("cache_key"), F.lit(self.buckets)).cast("int"))

    def _live(self, now: Column) -> Column:
        return (F.col("stored_at") >= now - F.make_dt_interval(secs=F.lit(self.days * 86400.0))) & ~F.col("gone")

    def lookup(self, calls: DataFrame, now: Column | None = None) -> DataFrame:
        """calls (stage, cache_key, ...) with value, vector and hit. Calls of one key share an entry; a call without a key is a miss."""
        kept = self.entries().filter(self._live(F.current_timestamp() if now is None else now)).select("stage", "bucket", "cache_key", "value", "vector", F.lit(True).alias("hit"))
        found = self._bucketed(calls).join(kept, ["stage", "bucket", "cache_key"], "left")
        return found.withColumn("hit", F.coalesce("hit", F.lit(False))).drop("bucket")

    def _replace(self, new: DataFrame, now: Column) -> None:
        """Put new entries in; in the buckets that they touch, the latest of a key stays and what is expired goes."""
        new = checkpointed(self._bucketed(new).select(*[F.col(f.split()[0]) for f in ENTRY.split(", ")]))
        if new.isEmpty():
            return
        touched = new.select("stage", "bucket").distinct()
        old = self.entries().join(F.broadcast(touched), ["stage", "bucket"], "left_semi")  # stages x buckets rows at most
        old = old.filter(self._live(now)).select(*new.columns)
        ranked = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        best = ranked.groupBy("stage", "bucket", "cache_key").agg(F.max_by(F.struct("stored_at", "value", "vector", "gone"), F.struct("_new", "stored_at", "value")).alias("e"))
        rows = best.select("cache_key", "e.*", "stage", "bucket")
        # dynamic: only folders that get rows are replaced, after all are written; each touched one gets the new entry at least
        rows.repartition("stage", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "bucket").parquet(self.where)

    def store(self, entries: DataFrame, now: Column | None = None) -> None:
        """Keep entries (stage, cache_key, value and, where there is one, vector)."""
        now = F.current_timestamp() if now is None else now
        vector = F.col("vector") if "vector" in entries.columns else F.lit(None)
        self._replace(entries.filter("cache_key IS NOT NULL").select("stage", "cache_key", now.alias("stored_at"), F.col("value").cast("string"), vector.cast("array<float>").alias("vector"), F.lit(False).alias("gone")), now)

    def bust(self, keys: DataFrame, now: Column | None = None) -> None:
        """Forget entries (stage, cache_key): replies that turned out to be of no use."""
        now = F.current_timestamp() if now is None else now
        known = self.entries().filter(self._live(now)).select("stage", "cache_key")
        gone = keys.select("stage", "cache_key").distinct().join(known, ["stage", "cache_key"], "left_semi")
        self._replace(gone.select("stage", "cache_key", now.alias("stored_at"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("array<float>").alias("vector"), F.lit(True).alias("gone")), now)


def through(store: CacheStore, calls: DataFrame, answer, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(replies, counters): calls (stage, cache_key, call_id, prompt) answered from the store or, where it has none, by answer(calls), which gives (call_id, status, value); only good
    replies are kept. replies: call_id, stage, status, value, cached. counters: stage, hits, misses, stores."""
    found = checkpointed(store.lookup(calls, now))
    hits = found.filter("hit").select("call_id", "stage", F.lit("OK").alias("status"), "value", F.lit(True).alias("cached"))
    asked = found.filter("NOT hit").select("call_id", "stage", "cache_key", "prompt")
    got = checkpointed(answer(asked.select("call_id", "prompt")).select("call_id", "status", "value").join(asked.select("call_id", "stage", "cache_key"), "call_id"))
    good = got.filter("status = 'OK' AND value IS NOT NULL")
    store.store(good.select("stage", "cache_key", "value"), now)
    counts = found.groupBy("stage").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    kept = good.groupBy("stage").agg(F.count_distinct("cache_key").alias("stores"))
    counters = counts.join(kept, "stage", "left").select("stage", "hits", "misses", F.coalesce("stores", F.lit(0)).cast("long").alias("stores"))
    return hits.unionByName(got.select("call_id", "stage", "status", "value", F.lit(False).alias("cached"))), counters
