"""Mixing sources to target weights: tokens by source, repetition rates, floor(rate) copies and one hash-seeded Bernoulli copy.

Sources in code point order (null is a source, the last) weigh WEIGHTS, repeating. They share `share` times all tokens by
weight; a source stops at `most` times its own tokens and its excess is shared among the others by weight until none is
above. Each source draws with the one of DRAWS seeds whose draw comes nearest to its target; a document's number of copies
depends on its doc_id, its source's rate and that seed, so reruns agree and repeated rows are copied alike. Null and empty texts have no tokens and are copied like others; a source without tokens has target
0 and no copies. Empty tables give empty results. The mix has the columns of the input, whatever their names; the plan has
numbers only. Sources are taken to be few (their totals meet in one task): a few million at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, small, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 20240229
#: Seeds that are tried for each source.
DRAWS = 16
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """For each source: source_size, target and rate. Water-filling in closed form: sources in the order of the level at
    which they are full; one is full if that level is no higher than the level that all not yet full ones share."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    by = by.withColumn("_n", nth).withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_n") - 1, F.lit(len(weights))).cast("int") + 1))
    by = by.withColumn("_cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    ahead = Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0))
    by = by.withColumn("_level", left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))))
    by = by.withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_level"))
    by = by.withColumn("_common", F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything))
    by = by.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_common") * F.col("_w")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return by.select("source", "source_size", "target", rate.alias("rate"))


def _extra(draw: Column) -> Column:
    """Whether a document's Bernoulli copy is drawn."""
    u = F.xxhash64("doc_id", draw).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return u < F.col("rate") - F.floor("rate")


def _on_source(rows: DataFrame, by: DataFrame) -> DataFrame:
    by = by.withColumnRenamed("source", "_source")
    return rows.join(small(by), rows["source"].eqNullSafe(F.col("_source")), "left").drop("_source")


def with_draws(rows: DataFrame, by: DataFrame, seed: int, draws: int) -> DataFrame:
    """by with the seed of each source: of so many the one whose draw comes nearest to the target, the least of equal ones."""
    extra = _on_source(rows, by).groupBy("source").agg(*[F.sum(F.when(_extra(F.lit(seed + k).cast("long")), F.col("size")).otherwise(0)).alias(f"_e{k}") for k in range(draws)])
    extra = extra.select(F.col("source").alias("_s"), F.array(*[f"_e{k}" for k in range(draws)]).alias("_e"))
    off = F.transform("_e", lambda x, k: F.struct(F.abs(F.floor("rate") * F.col("source_size") + x - F.col("target")).alias("off"), k.alias("k")))
    joined = by.join(extra, by["source"].eqNullSafe(F.col("_s")), "left")
    return joined.select(*by.columns, (F.coalesce(F.array_min(off)["k"], F.lit(0)) + seed).cast("long").alias("_draw"))


def drawn(sizes: DataFrame, seed: int = SEED, draws: int = DRAWS, **kw) -> DataFrame:
    """For each source of sizes (doc_id, source, size): source_size, target, rate and the seed that its documents draw with."""
    by = stored(targets(sizes, **kw), "mixing-targets")
    return stored(with_draws(sizes, by, seed, draws), "mixing-draws")


def _copies() -> Column:
    return (F.floor("rate") + _extra(F.col("_draw")).cast("int")).cast("int")


def planned(docs: DataFrame, seed: int = SEED, draws: int = DRAWS, **kw) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of every row of docs. Texts are read once, for their sizes."""
    sizes = stored(sized(docs.select("doc_id", "text", "source")).drop("text"), "mixing-sizes")
    return _on_source(sizes, drawn(sizes, seed, draws, **kw)).withColumn("copies", _copies()).drop("_draw")


def mix(docs: DataFrame, seed: int = SEED, draws: int = DRAWS, **kw) -> DataFrame:
    """The mix itself: every row of docs as often as planned, with the columns of docs."""
    sizes = stored(sized(docs.select("doc_id", "text", "source")).drop("text"), "mixing-sizes")
    by = drawn(sizes, seed, draws, **kw)
    discard(sizes)
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = _on_source(rows, by).select(_copies().alias("_n"), "_row").filter("_n > 0")
    return rows.select(F.explode(F.array_repeat("_row", F.col("_n"))).alias("_row")).select("_row.*")
