"""The store of replies between runs, the ladder's log, and pairs that share hot items."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from docgraph.operators import graph, model, telemetry
from docgraph.sources import cache

CALLS = "stage string, cache_key string, call_id string, prompt string"


def at(text):
    return F.lit(text).cast("timestamp")


def test_store_between_runs(spark, tmp_path):
    kept = cache.CacheStore(spark, str(tmp_path / "cache"), days=30, buckets=3)
    calls = spark.createDataFrame([("a", f"k{i % 5}", str(i), f"p{i % 5}") for i in range(8)] + [("b", "k0", "b0", "p0"), ("a", None, "n", "p"), ("a", "bad", "x", "bad")], CALLS)
    asked = []

    def answer(rows):
        asked.append(sorted(r.call_id for r in rows.collect()))
        return rows.select("call_id", F.when(F.col("prompt") == "bad", "CAP_HIT").otherwise("OK").alias("status"), F.upper("prompt").alias("value"))

    replies, counters = cache.through(kept, calls, answer, at("2024-01-01"))
    assert {(r.call_id, r.value, r.cached) for r in replies.collect()} >= {("0", "P0", False), ("b0", "P0", False), ("x", "BAD", False)} and replies.count() == 11
    assert {tuple(r) for r in counters.collect()} == {("a", 0, 10, 5), ("b", 0, 1, 1)}
    replies, counters = cache.through(kept, calls, answer, at("2024-01-20"))
    assert {r.call_id for r in replies.collect() if not r.cached} == {"n", "x"} and asked[1] == ["n", "x"]
    assert {tuple(r) for r in counters.collect()} == {("a", 8, 2, 0), ("b", 1, 0, 0)}
    kept.bust(spark.createDataFrame([("a", "k1"), ("a", "none"), ("b", "k1")], "stage string, cache_key string"), at("2024-01-21"))
    found = {(r.stage, r.cache_key): r.hit for r in kept.lookup(calls, at("2024-01-21")).collect()}
    assert not found["a", "k1"] and found["a", "k0"] and found["b", "k0"]
    kept.store(spark.createDataFrame([("a", "k0", "new")], "stage string, cache_key string, value string"), at("2024-01-25"))
    rows = {(r.stage, r.cache_key): r.value for r in kept.lookup(calls, at("2024-02-10")).collect() if r.hit}
    assert rows == {("a", "k0"): "new"}  # all else has expired
    kept.store(spark.createDataFrame([("a", f"k{i}", "x") for i in range(5)] + [("b", "k0", "y")], "stage string, cache_key string, value string"), at("2024-03-01"))
    assert kept.entries().count() == 6 and {r.value for r in kept.entries().collect()} == {"x", "y"}  # what had expired is gone from disk


def test_vectors_are_kept(spark, tmp_path):
    kept = cache.CacheStore(spark, str(tmp_path / "cache"))
    assert kept.lookup(spark.createDataFrame([("e", "k")], "stage string, cache_key string")).head().hit is False
    kept.store(spark.createDataFrame([("e", "k", None, [1.0, 2.5])], "stage string, cache_key string, value string, vector array<double>"))
    assert kept.lookup(spark.createDataFrame([("e", "k")], "stage string, cache_key string")).head().vector == [1.0, 2.5]
    kept.store(spark.createDataFrame([], "stage string, cache_key string, value string"))
    assert kept.entries().count() == 1


def test_ladder_tells_each_attempt_once(spark):
    calls = spark.createDataFrame([("a", "x" * 100), ("b", "y")], "call_id string, prompt string")

    def provider(b):
        return [{"error_class": "RateLimitError"} if r == "b" and t else {"payload": "{}", "duration": 1.5} for r, t in zip(b["root_id"], b["thinking"], strict=True)]

    done, log = model.logged_ladder(calls, provider, stage="extract")
    events = log.collect()
    assert Counter((r.event, r.call_id) for r in events) == Counter([(e, c) for e in ("begin", "end") for c in ("a#0", "b#0", "b#1", "b#2")])
    folded = {r.call_id: r for r in telemetry.folded(log).collect()}
    assert [folded[c].retry_of_call_id for c in ("a#0", "b#0", "b#1", "b#2")] == [None, None, "b#0", "b#1"] and [folded[f"b#{i}"].category for i in range(3)] == ["extract", "extract/retry", "extract/reasoning-off"]
    assert folded["b#0"].success is False and folded["b#0"].llm_status == "LOAD" and folded["a#0"].duration_ms == 1500 and not folded["b#2"].aborted
    assert {(r.root_id, r.status) for r in done.collect()} == {("a", "OK"), ("b", "SUCCESS_REASONING_OFF")}


def test_pairs_of_hot_items(spark):
    rows = [(i, "hot") for i in range(60)] + [(i, f"i{i % 7}") for i in range(40)] + [(1, "hot"), (None, "hot"), (3, None)]
    left = spark.createDataFrame(rows, "a int, item string")
    right = spark.createDataFrame([(i + 100, x) for i, x in rows[:50] if i is not None], "b int, item string")
    want = Counter({(x, i, j) for i, x in rows for j, y in [(i + 100, x) for i, x in rows[:50]] if x == y and x is not None})
    for block in (1000, 7):
        got = Counter((r.item, r.a, r.b) for r in graph.shared_pairs(left, right, "a", "b", "item", block).collect())
        assert got == want
