"""Exact order statistics of groups of any size, and what is made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bounded, checkpointed

#: Bins of one refinement.
BINS = 1024


def order_statistics(df: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, n and, by name, the value at each rank (from 1, as a function of n) among the group's values, which are finite; nulls do not count.

    A selection by histograms: each rank's range of values is cut into BINS, rows are counted by bin before they are shuffled, and the bin that
    holds the rank is the next range, until one value is left. No group is sorted, held or sent to one task: what a round shuffles is a count a bin."""
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*group).alias("_g") if group else F.struct(F.lit(0).alias("_all")).alias("_g"), F.col(value).alias("_v"))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("n")).cast("long").alias("_k")) for name, rank in ranks.items()])
    open_ = checkpointed(sizes.select("_g", "n", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.explode(wanted).alias("_w")).select("_g", "n", "_lo", "_hi", "_before", "_w._name", "_w._k"))
    found = []
    while True:
        found.append(open_.filter("_lo = _hi"))
        open_ = open_.filter("_lo < _hi")
        if open_.isEmpty():
            break
        # bins by doubles keep the order of values; where two values are one double, by their difference
        lo, hi, v = (F.col(c).cast("double") for c in ("_lo", "_hi", "_v"))
        at = F.when(hi > lo, F.floor((v - lo) / (hi - lo) * BINS)).otherwise(F.expr("CAST(_v - _lo AS BIGINT)"))
        target = bounded(open_.withColumnRenamed("_g", "_t"))
        hits = rows.join(target, F.col("_g").eqNullSafe(F.col("_t")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        keys = ["_g", "n", "_name", "_k", "_before"]
        counts = hits.groupBy(*keys, F.least(at, F.lit(BINS - 1)).cast("int").alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy("_g", "_name").orderBy("_bin"))  # BINS rows at most
        counts = counts.withColumn("_upto", F.col("_before") + upto).filter((F.col("_k") <= F.col("_upto")) & (F.col("_k") > F.col("_upto") - F.col("_c")))
        open_ = checkpointed(counts.select("_g", "n", "_lo", "_hi", (F.col("_upto") - F.col("_c")).alias("_before"), "_name", "_k"))
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    by_name = done.groupBy("_g", "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in ranks])
    return by_name.select(*[F.col(f"_g.{g}") for g in group], "n", *ranks)


def nearest_ranks(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """group, n and, by name, the value at rank ceil(share * n)."""
    return order_statistics(df, group, value, {name: lambda n, q=q: F.greatest(F.lit(1), F.ceil(q * n)) for name, q in shares.items()})


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, total, avg, median, p95 (at the rank 0.95 (n - 1) rounded half to even), min and max, rounded half to even to 2 places."""
    r = lambda x: F.bround(x, 2)
    sums = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(r(F.sum(value)).alias("total"), r(F.avg(value)).alias("avg"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"))
    ranks = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1, "p95": lambda n: F.bround(0.95 * (n - 1)) + 1}
    at = order_statistics(df, group, value, ranks).withColumns({"median": r((F.col("_low") + F.col("_high")) / 2), "p95": r(F.col("p95"))})
    names = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    both = sums.alias("l").join(at.alias("r"), names) if group else sums.alias("l").crossJoin(at.alias("r"))  # one row each
    return both.select(*[f"l.{g}" for g in group], "l.total", "l.avg", "r.median", "r.p95", "l.min", "l.max")


def stage_statistics(calls: DataFrame, labels: Column, values: list[str]) -> DataFrame:
    """By stage: calls, outcomes (label and number, in order of the labels), categories without a success, and of each value its distribution as a struct.
    calls: stage, category, success and the values."""
    counts = calls.groupBy("stage", labels.alias("_label")).agg(F.count("*").alias("_n"))
    named = counts.groupBy("stage").agg(F.sum("_n").alias("calls"), F.array_sort(F.collect_list(F.struct(F.col("_label").alias("label"), F.col("_n").alias("n")))).alias("outcomes"))
    by = calls.groupBy("stage", "category").agg(F.bool_or(F.coalesce("success", F.lit(False))).alias("_ok"))
    out = named.join(by.groupBy("stage").agg(F.count_if(~F.col("_ok")).alias("lost")), "stage")
    for v in values:
        own = distribution(calls, ["stage"], v)
        out = out.join(own.select("stage", F.struct("total", "avg", "median", "p95", "min", "max").alias(v)), "stage", "left")
    return out
