"""Sharding: minimax contiguous partition with DataFrame functions only.

Rows of one text stay together. The ordered atomic groups are the BUCKETS hash ranges of texts, so their number never
grows with the data: each holds whole groups of equal texts, and a group that outweighs a shard is a bucket of its own
weight. The smallest feasible shard capacity is found by binary search, each candidate checked greedily. The order is cut within
that capacity: each cut is the one nearest to an equal share that leaves no more than what a greedy pass from the other end
fits into the shards that are left, so the last shard is not starved. Slots count from 0 without gaps inside a shard.

Null texts are one group and have size 1 (no bytes); empty texts are another. Repeated rows get a slot each. Empty tables
give empty results. Columns of the input are kept; size, text_crc32, shard and slot replace columns of those names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh

#: Atomic groups: hash ranges of texts. At 16 shards each weighs 1/4096 of a shard, unless one text alone weighs more.
BUCKETS = 1 << 16
#: Parts of a shard that are numbered on their own, so that no task holds a shard.
CELLS = 256
BUCKET = "_bucket"


def _bucket(rows: DataFrame) -> str:
    """The column of the atomic group: sized() gives it more underscores than any column called like it."""
    return max((c for c in rows.columns if c.startswith("_") and c.lstrip("_") == BUCKET.lstrip("_")), key=len)


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, text_crc32 and the atomic group."""
    return docs.withColumns(
        {
            "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
            "text_crc32": F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))),
            fresh(docs, BUCKET): F.shiftright(F.xxhash64("text"), 48).cast("int") + BUCKETS // 2,
        }
    )


def capacity(sizes: Column, shards: int) -> Column:
    """The least capacity with which a greedy pass over sizes needs at most so many shards."""
    state = lambda used, held: F.struct(used.cast("long").alias("used"), held.cast("long").alias("held"))

    def needed(cap: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            over = acc["held"] + x > cap
            return state(acc["used"] + F.when(over, 1).otherwise(0), F.when(over, x).otherwise(acc["held"] + x))

        return F.aggregate(sizes, state(F.lit(1), F.lit(0)), step)["used"]

    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    low = F.greatest(F.array_max(sizes), F.ceil(total / shards).cast("long"))
    bounds = lambda lo, hi: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("long")
        tried = F.struct(middle.alias("mid"), (needed(middle) <= shards).alias("fits"))
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.transform(F.array(tried), lambda t: F.when(t["fits"], bounds(acc["lo"], t["mid"])).otherwise(bounds(t["mid"] + 1, acc["hi"])))[0]
        )

    # ceil(total / shards) + largest always suffices, so the search spans less than the largest size
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.array_max(sizes) + 2)).cast("int") + 1))
    return F.aggregate(steps, bounds(low, low + F.array_max(sizes)), halve)["lo"]


def cuts(rows: DataFrame, shards: int) -> DataFrame:
    """One row: the capacity, and the atomic groups at which a new shard begins (at most shards - 1 of them)."""
    bucket = _bucket(rows)
    groups = rows.groupBy(bucket).agg(F.sum("size").alias("s"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct(F.col(bucket).alias("b"), "s"))).alias("g"))  # BUCKETS entries at most
    listed = listed.filter(F.size("g") > 0).withColumn("sizes", F.col("g.s"))
    listed = listed.select("g", capacity(F.col("sizes"), shards).alias("cap"))

    none = F.array().cast("array<int>")

    def from_right(acc: Column, x: Column) -> Column:
        over = acc["held"] + x["s"] > F.col("cap")
        return F.struct(
            F.when(over, F.concat(acc["at"], F.array(acc["b"]))).otherwise(acc["at"]).alias("at"),
            F.when(over, x["s"]).otherwise(acc["held"] + x["s"]).alias("held"),
            x["b"].alias("b"),
        )

    start = F.struct(none.alias("at"), F.lit(0).cast("long").alias("held"), F.lit(0).alias("b"))
    total = F.aggregate("g", F.lit(0).cast("long"), lambda acc, x: acc + x["s"])
    # right: where the last shard, the last two and so on begin at the earliest; a cut before that would leave too much
    listed = listed.select("g", "cap", total.alias("total"), F.aggregate(F.reverse("g"), start, from_right)["at"].alias("right"))

    def step(acc: Column, x: Column) -> Column:
        k = F.size(acc["at"])  # cuts so far
        full = acc["held"] + x["s"] > F.col("cap")
        rest_fits = x["b"] >= F.coalesce(F.get("right", F.lit(shards - 2) - k), F.lit(0))
        due = acc["all"] + x["s"] / 2 >= F.col("total") * (k + 1) / shards  # this cut is nearer to an equal share than the next
        over = (k < shards - 1) & (acc["held"] > 0) & (full | (rest_fits & due))
        return F.struct(
            F.when(over, F.concat(acc["at"], F.array(x["b"]))).otherwise(acc["at"]).alias("at"),
            F.when(over, x["s"]).otherwise(acc["held"] + x["s"]).alias("held"),
            (acc["all"] + x["s"]).alias("all"),
        )

    start = F.struct(none.alias("at"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("all"))
    return listed.select("cap", F.aggregate("g", start, step)["at"].alias("at"))


def assign(rows: DataFrame, shards: int = 16) -> DataFrame:
    """rows of sized() with shard and slot."""
    bucket = _bucket(rows)
    plan = cuts(rows, shards).select(F.coalesce(F.col("at"), F.array().cast("array<int>")).alias("at"))
    at = fresh(rows, "_at")
    placed = rows.withColumn(at, plan.scalar())
    begun = [F.when(F.get(at, F.lit(k)) <= F.col(bucket), 1).otherwise(0) for k in range(shards - 1)]
    placed = placed.withColumn("shard", reduce(lambda x, y: x + y, begun, F.lit(0)).cast("int")).drop(at)
    cell, n, first, nth = (fresh(placed, x) for x in ("_cell", "_n", "_before", "_rn"))
    placed = placed.withColumn(cell, F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int"))
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", cell).agg(F.count("*").alias(n)).select("shard", cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy("shard", cell).orderBy("doc_id", "text_crc32")
    placed = placed.withColumn(nth, F.row_number().over(inside))
    placed = placed.join(F.broadcast(starts), ["shard", cell])  # shards x CELLS rows
    return placed.withColumn("slot", F.col(first) + F.col(nth) - 1).drop(nth, first, cell, bucket)
