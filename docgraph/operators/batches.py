"""Batches: documents joined under one id with offsets, embeddings in batches, halves, first pieces, records as they go to disk."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line between entries of a batch, texts of one request, the least patterns told in detail.
BATCH_OF_TEXTS = 32
DETAIL_FLOOR = 4


def separator(date: Column, title: Column, doc_id: Column) -> Column:
    date = F.when(F.coalesce(date, F.lit("")) == "", "unknown").otherwise(date)
    title = F.when(F.coalesce(title, F.lit("")) == "", doc_id).otherwise(title)
    return F.concat(F.lit("\n\n--- ENTRY: "), date, F.lit(" | "), title, F.lit(" ["), doc_id, F.lit("] ---\n\n"))


def batch_documents(docs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One document for each group of few documents (doc_id, title, date, content): its text, its entries with begin and end in
    it, the span of dates, and a title. Groups are batches under a token budget, so one is a row's worth."""
    part = F.struct(*order, F.col("doc_id").cast("string").alias("_id"), F.coalesce("title", F.lit("")).alias("_title"), F.coalesce("date", F.lit("")).alias("_date"), F.col("content").alias("_text"))
    rows = docs.groupBy(*group).agg(F.array_sort(F.collect_list(part)).alias("p"))
    parts = F.transform("p", lambda x, i: F.concat(F.when(i > 0, separator(x["_date"], x["_title"], x["_id"])).otherwise(""), x["_text"]))
    rows = rows.withColumn("_parts", parts).withColumn("content", F.array_join("_parts", ""))
    ends = F.transform("_parts", lambda _, i: F.aggregate(F.slice("_parts", F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))
    rows = rows.withColumn("ends", ends)
    entries = F.transform("p", lambda x, i: F.struct(x["_id"].alias("id"), (F.get("ends", i) - F.length(x["_text"])).alias("begin"), F.get("ends", i).alias("end")))
    dates = F.array_sort(F.array_distinct(F.filter(F.transform("p", lambda x: x["_date"]), lambda d: d != "")))
    titles = F.filter(F.transform("p", lambda x: x["_title"]), lambda t: t != "")
    rows = rows.withColumns({"entries": entries, "_d": dates, "_t": titles})
    date = F.when(F.size("_d") > 1, F.concat(F.element_at("_d", 1), F.lit(".."), F.element_at("_d", -1))).otherwise(F.coalesce(F.get("_d", F.lit(0)), F.lit("")))
    span = F.concat(F.get("_t", F.lit(0)), F.lit(" → "), F.try_element_at("_t", F.lit(-1)), F.lit(" ("), F.size("p").cast("string"), F.lit(" entries)"))
    title = F.when(F.size(F.array_distinct("_t")) == 1, F.get("_t", F.lit(0))).when(F.size("_t") > 1, span).otherwise("")
    return rows.select(*group, "content", "entries", date.alias("date"), title.alias("title"))


def halved_batch(items: Column) -> Column:
    """The two halves of a batch, the first the smaller one; one item is not halved."""
    n = F.size(items)
    half = F.floor(n / 2).cast("int")
    return F.when(n < 2, F.array(items)).otherwise(F.array(F.slice(items, F.lit(1), half), F.slice(items, half + 1, n - half)))


def detailed(patterns: DataFrame, rank: Column, n: Column, floor: int = DETAIL_FLOOR) -> DataFrame:
    """The patterns that stay detailed after one more halving; none at all where the floor leaves nothing to reduce."""
    keep = F.greatest(F.lit(floor), F.floor(n / 2))
    return patterns.filter((keep < n) & (rank <= keep))


def mentions(facts: DataFrame) -> DataFrame:
    """One row for each entity of each fact (fact_id, topics, summary, confidence, entities), with the other entities of the fact."""
    rows = facts.select("*", F.posexplode("entities").alias("_at", "_e"))
    others = F.filter("entities", lambda e, i: i != F.col("_at"))
    return rows.select(
        "fact_id", F.col("_e.name").alias("name"), F.col("_e.type").alias("entity_type"), F.col("_e.role").alias("role"), F.coalesce(F.get("topics", F.lit(0)), F.lit("")).alias("topic"),
        F.col("summary").alias("fact_summary"), "confidence", F.transform(others, lambda e: e["name"]).alias("co_entities"),
    )


def stub_vectors(texts: list[str], dim: int = 4) -> list[list[float]]:
    """Components in [0, 1] from a digest of the text: deterministic."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dim]] for t in texts]


def embedded(texts: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]] = stub_vectors, batch: int = BATCH_OF_TEXTS) -> DataFrame:
    """(text, embedding) of each distinct text, in requests of `batch`; a request that fails is tried text by text, and a text that fails
    alone has no vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame[text].iloc[at : at + batch].tolist()
                try:
                    vectors = embed(part)
                except Exception:  # noqa: BLE001 - whatever a provider raises
                    vectors = []
                    for t in part:
                        try:
                            vectors += embed([t])
                        except Exception:  # noqa: BLE001
                            vectors.append(None)
                yield pd.DataFrame({text: part, "embedding": vectors})

    return texts.select(text).distinct().mapInPandas(run, f"`{text}` string, embedding array<double>")
