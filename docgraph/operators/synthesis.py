"""Patterns, insights and actions: reference resolution, gates, halving, sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab


def resolved_refs(refs: DataFrame, owner: str, ref: str, conf: str, n: int) -> DataFrame:
    """References from 1 as indices from 0: those out of range go, each index keeps its highest confidence, ordered by it."""
    by = refs.filter(F.col(ref).between(1, n)).groupBy(owner, (F.col(ref) - 1).alias("fact")).agg(F.max(conf).alias(conf))
    return by.withColumn("pos", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(conf), "fact")))


def fanned_out(refs: DataFrame, members: DataFrame, idx: str) -> DataFrame:
    """References to deduplicated facts as references to every original of theirs, each with its highest confidence."""
    rows = refs.join(members.select(idx, F.explode("members").alias("original")), idx)
    return rows.groupBy("pattern", "original").agg(F.max("conf").alias("conf"))


def cross_domain(refs: DataFrame, owner: str, topic: str, ref: str) -> DataFrame:
    """Insights with references into two topics or more."""
    return refs.groupBy(owner).agg(F.countDistinct(topic).alias("topics"), F.count(ref).alias("refs")).filter("topics >= 2 AND refs >= 2")


def capped(df: DataFrame, scope: list[str], order: list, cap: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).filter(F.col("_r") <= cap).drop("_r")


def halved(df: DataFrame, topic: list[str], confidence: str, idx: str) -> DataFrame:
    """The more confident half of each topic, two at least; topics of fewer than four stay."""
    w = Window.partitionBy(*topic)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(confidence), idx)), "_n": F.count("*").over(w)})
    return rows.filter((F.col("_n") < 4) | (F.col("_r") <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2)))).drop("_r", "_n")


def sampled_to_fit(rows: DataFrame, cap_tokens: int) -> DataFrame:
    """topic and idx of the evenly spaced facts of each topic whose texts (n characters each) fit a prompt, the last always
    among them. Sizes and indices alone go through it, no texts."""

    def spaced(n: int, k: int) -> list[int]:
        return list(range(n)) if k >= n else [n - 1] if k == 1 else sorted({int((i + 0.5) * n / k) for i in range(k - 1)} | {n - 1})

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable").reset_index(drop=True)
        sizes, n = pdf["n"].to_numpy(), len(pdf)
        fits = lambda idx: int(sizes[idx].sum()) // vocab.CHARS_PER_TOKEN <= cap_tokens
        if fits(list(range(n))):
            return pdf[["topic", "idx"]]
        lo, hi, best = 2, n, 2
        while lo <= hi:
            mid = (lo + hi) // 2
            lo, hi, best = (mid + 1, hi, mid) if fits(spaced(n, mid)) else (lo, mid - 1, best)
        return pdf.loc[spaced(n, best), ["topic", "idx"]]

    return rows.groupBy("topic").applyInPandas(run, "topic string, idx long")
