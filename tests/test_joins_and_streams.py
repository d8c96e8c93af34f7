"""Sources of every shape, interval joins, spans of quotes and keyed streams against brute force."""

from __future__ import annotations

import difflib
import json
import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from docgraph.operators import display, facts, graph, search, telemetry
from docgraph.plans import registry
from docgraph.sources import exports, files
from docgraph.streaming import calls, events

SF = f"{DATA}/sf0.001"


def jsonl(*rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


SHAPES = {
    "code.jsonl": jsonl({"type": "user", "sessionId": "s", "message": {"content": "typed"}}),
    "codex.jsonl": jsonl({"timestamp": "2024-01-02T00:00:00Z", "type": "event_msg", "payload": {"type": "user_message", "message": "asked"}}),
    "history.jsonl": jsonl({"display": "b", "project": "/p", "timestamp": 1709632800000}, {"display": " a ", "project": "", "timestamp": 1709546400000}, {"display": "c", "project": "/p", "timestamp": "2024-05-01T00:00:00Z"}, {"display": " ", "project": "/p", "timestamp": 1}),
    "prompts.jsonl": jsonl({"session_id": "0123456789", "text": "one", "ts": 1709632800}, {"session_id": "x", "text": "two", "ts": "no time"}),
    "conversations.json": json.dumps([{"uuid": "u", "name": "N", "created_at": "2024-01-02", "chat_messages": [{"sender": "human", "text": "hi"}]}]),
    "project.json": json.dumps({"name": "P", "prompt_template": "do", "description": ""}),
    "gpt.json": json.dumps([{"title": "T", "conversation_id": "c", "create_time": 1.7e9, "mapping": {"1": {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["q", "", "r"]}, "create_time": 1.0}}}}]),
    "Journal.json": '{"entries": [{"uuid": "a", "text": "old \\\\- day", "creationDate": "2022-12-31T23:30:00Z", "timeZone": "UTC"}, {"uuid": "b", "text": "new", "creationDate": "2023-12-31T23:30:00Z", "timeZone": "Europe/Berlin"}, {"text": "undated"},]}',
    "plain.json": '{"k": 1}',
    "odd.jsonl": '{"what": 1}\n',
    "note.md": "# t",
    "silent.jsonl": jsonl({"type": "assistant", "sessionId": "s"}),
    "blank.txt": "  \n",
    "talk.txt": "1/2/24, 9:00 - A: hello\n1/2/24, 9:01 - A: <Media omitted>\n",
}


def test_every_file_has_a_document_or_a_reason(spark, tmp_path):
    for name, text in SHAPES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "x.exe").write_text("x")
    read = {r.file_id.rsplit("/", 1)[-1]: (r.source_type, r.content) for r in files.read_text(spark, str(tmp_path)).collect()}
    assert read == {
        "code.jsonl": ("code_session", "# typed\n\ntyped"), "codex.jsonl": ("codex_session", "# asked\n\nasked"),
        "history.jsonl::month_2024-03": ("code_history", "# Code prompts — 2024-03\n\n[_unknown] a\n\n[/p] b"), "history.jsonl::month_2024-05": ("code_history", "# Code prompts — 2024-05\n\n[/p] c"),
        "prompts.jsonl::month_2024-03": ("codex_history", "# Codex prompts — 2024-03\n\n[session 01234567] one"), "prompts.jsonl::month_no time": ("codex_history", "# Codex prompts — no time\n\n[session x] two"),
        "conversations.json::conv_u": ("web_conversation", "# N\n\nhi"), "project.json": ("web_project", "# Project: P\n\nCustom instructions:\ndo"), "gpt.json::conv_c": ("chatgpt_conversation", "# T\n\nq\n\nr"),
        "Journal-2022.json::entry_000": ("journal", "old - day"), "Journal.json::entry_000": ("journal", "new"), "Journal.json::entry_001": ("journal", "undated"),
        "plain.json": ("json", '{"k": 1}'), "odd.jsonl": ("jsonl", '{"what": 1}'), "note.md": ("markdown", "# t"), "talk.txt": ("whatsapp", "1/2/24, 9:00 - A: hello"),
    }
    reasons = {r.file_id.rsplit("/", 1)[-1]: r.reason for r in files.outcomes(spark, str(tmp_path)).collect()}
    assert set(reasons) == {*SHAPES, "x.exe"} and {k: v for k, v in reasons.items() if v} == {"silent.jsonl": "empty", "blank.txt": "empty", "x.exe": "unsupported"}
    assert files.unpacked(spark, str(tmp_path)).count() == len(SHAPES)


def test_months(spark):
    at = [(0.0, "1970-01"), (1709632800, "2024-03"), (1709632800000, "2024-03"), ("2024-05-01T00", "2024-05"), ("soon", "unknown"), (None, "1970-01"), (1e300, "unknown")]
    got = spark.createDataFrame([(str(t) if t is not None else None,) for t, _ in at], "t string").select(exports.month_key(F.col("t")).alias("m")).collect()
    assert [r.m for r in got] == [m for _, m in at]


# intervals


def test_located_over_many_ranges(spark):
    """Disjoint segments with gaps; one file holds most rows."""
    rng = random.Random(5)
    segments, points = [], []
    for f in range(4):
        at = 0
        for k in range(1000 if f == 0 else 5):
            b = at + rng.choice([0, 0, 3])
            e = b + rng.choice([1, 5, 10**6])
            segments.append((f, k, b, e))
            at = e
        points += [(f, i, rng.randrange(at + 5)) for i in range(1500 if f == 0 else 20)]
    points += [(9, 0, 5), (None, 1, 5), (0, -1, -3)]
    p = spark.createDataFrame(points, "f int, id int, at long").repartition(7)
    s = spark.createDataFrame(segments, "f int, k int, b long, e long").repartition(5)
    got = {(r.f, r.id): (r.at, r.k) for r in graph.located(p, s, "f", "at", "b", "e").collect()}
    assert len(got) == len(points)
    by = {}
    for f, k, b, e in segments:
        by.setdefault(f, []).append((b, e, k))
    for f, i, at in points:
        assert got[f, i] == (at, next((k for b, e, k in by.get(f, []) if b <= at < e), None))
    assert graph.located(p.limit(0), s, "f", "at", "b", "e").count() == 0
    assert graph.located(p, s.limit(0), "f", "at", "b", "e").filter("k IS NULL").count() == len(points)


def test_contained_of_any_length(spark):
    rng = random.Random(6)
    spans = [(rng.randrange(3), k, b := rng.randrange(10**6), b + 10 ** rng.randrange(7)) for k in range(300)] + [(0, 300, 5, 5), (0, 301, 0, 1 << 20)]
    points = [(rng.randrange(4), i, rng.randrange(2 * 10**6)) for i in range(300)] + [(0, 300, 0), (0, 301, (1 << 20) - 1), (0, 302, 1 << 20)]
    got = graph.contained(spark.createDataFrame(points, "f int, id int, at long"), spark.createDataFrame(spans, "f int, k int, b long, e long"), "f", "at", "b", "e")
    assert sorted((r.id, r.k) for r in got.collect()) == sorted((i, k) for f, i, at in points for g, k, b, e in spans if f == g and b <= at < e)
    binned = spark.createDataFrame([(0, 0, 0, 1 << 40)], "f int, k int, b long, e long")
    assert graph.contained(spark.createDataFrame([(0, 0, 7)], "f int, id int, at long"), binned, "f", "at", "b", "e").count() == 1


@pytest.mark.parametrize("needle", ["a\\Eb", "(x", "\n", "$1", "é."])
def test_needles_are_literal(spark, needle):
    texts = [(1, f"{needle} and {needle}{needle}"), (2, "none"), (3, "")]
    got = sorted((r.doc_id, r.begin) for r in display.found_in(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", "text", needle).collect())
    assert got == sorted((i, m.start()) for i, t in texts for m in re.finditer(re.escape(needle), t))


# spans of quotes


def plainly(text, quote):
    """The four tiers, the last one by difflib."""
    if not quote.strip():
        return None
    if quote in text:
        return text.index(quote), text.index(quote) + len(quote), False
    alike = str.maketrans("‘’“”", "''\"\"")
    words = quote.translate(alike).split()
    if not words:
        return None
    m = re.search(r"\s+".join(map(re.escape, words)), text.translate(alike))
    if m:
        return m.start(), m.end(), False
    head = quote[:40].strip()
    if head and head in text:
        return text.index(head), min(len(text), text.index(head) + len(quote)), False
    m = difflib.SequenceMatcher(None, text, quote, autojunk=False).find_longest_match()
    if m.size < max(12, len(quote) // 4):
        return None
    return m.a, min(len(text), m.a + max(m.size, min(len(quote), 200))), True


def test_tiers_of_spans(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    kinds = set()
    for r in registry.QUERIES["fact_edited_spans"](spark, SF).collect():
        text = texts[r.doc_id][:6000]
        if len(texts[r.doc_id]) > 6000:
            continue
        want = plainly(text, r.quote)
        assert (want or (None, None, None)) == (r.start_char, r.end_char, r.approximate), (r.doc_id, r.quote)
        kinds.add((r.doc_id % 5, r.start_char is not None, r.approximate))
    assert {(0, True, False), (1, True, False), (2, True, False), (3, True, True), (4, False, None)} <= kinds


@pytest.mark.parametrize("seed", range(30))
def test_longest_match(seed, monkeypatch):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab" if seed % 3 else "a") for _ in range(rng.randrange(400)))
    at = rng.randrange(len(text) + 1)
    quote = "x" + text[at : at + rng.randrange(80)] + "y" + text[: rng.randrange(30)]
    m = difflib.SequenceMatcher(None, text, quote, autojunk=False).find_longest_match()
    want = (m.a, m.size) if m.size >= 12 else None
    assert facts.longest_match(facts.Source(text), quote) == want
    monkeypatch.setattr(facts, "SEED_PAIRS", 3)  # row by row
    assert facts.longest_match(facts.Source(text), quote) == want


def test_odd_quotes():
    s = facts.Source("He said “no way”,  twice.")
    assert facts.resolve(s, "") is None and facts.resolve(s, "   ") is None and facts.resolve(s, '"no way", twice') == (8, 24, False)
    assert facts.resolve(facts.Source(""), "x") is None
    long = facts.Source("word " * 200_000 + "a needle of some length")
    assert facts.resolve(long, "zz a needle of some length zz")[0] == 200_000 * 5 - 1


# keyed streams

LOG = "event string, call_id string, ts timestamp, pos long, stage string, success boolean, error_class string, completion_tokens long, ttft_ms long, duration_ms long, finish_reason string"


def line(event, call, minute, pos, **given):
    day, minute = divmod(minute, 1440)
    return {"event": event, "call_id": call, "ts": f"2024-01-{day + 1:02d}T{minute // 60:02d}:{minute % 60:02d}:00Z", "pos": pos, **given}


def run(spark, folder, tmp_path):
    schema = spark.createDataFrame([], LOG).schema
    stream = calls.call_states(events.event_files(spark, str(folder), schema, per_trigger=1), "1 hour", "10 minutes")
    events.persisted(stream, str(tmp_path / "rows"), str(tmp_path / "state"), "update", events.KEYED).awaitTermination()
    return {r.call_id: r.asDict() for r in calls.latest(spark.read.schema(stream.schema).parquet(str(tmp_path / "rows"))).collect()}


def test_call_states_and_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    first = [
        line("begin", "a", 0, 0, stage="s"), line("begin", "a", 1, 1, stage="again"), line("stream_progress", "a", 1, 2, completion_tokens=5, ttft_ms=9), line("begin", "b", 2, 3, stage="t"),
        line("end", "orphan", 3, 4, success=True), line("begin", "c", 3, 5, stage="u"), line("end", "c", 4, 6, success=True, completion_tokens=0, duration_ms=70, finish_reason="stop"),
        line("end", "late", 4, 8, success=False, error_class="E", duration_ms=3),
    ]
    (tmp_path / "in" / "1.json").write_text(jsonl(*first))
    got = run(spark, tmp_path / "in", tmp_path)
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["state"], got["a"]["stage"], got["a"]["completion_tokens"], got["a"]["ttft_ms"], got["a"]["success"]) == ("running", "s", 5, 9, None)
    assert (got["c"]["state"], got["c"]["success"], got["c"]["completion_tokens"], got["c"]["duration_ms"]) == ("ended", True, 0, 70)
    (tmp_path / "in" / "2.json").write_text(jsonl(line("end", "a", 30, 20, success=True, completion_tokens=50, duration_ms=5), line("begin", "late", 31, 7, stage="v"), line("stream_progress", "c", 31, 5)))
    (tmp_path / "in" / "3.json").write_text(jsonl(line("begin", "z", 1440, 30, stage="w")))  # a day on: what runs is given up
    got = run(spark, tmp_path / "in", tmp_path)
    assert (got["a"]["state"], got["a"]["completion_tokens"]) == ("ended", 50) and got["z"]["state"] == "running"
    assert (got["b"]["state"], got["b"]["success"], got["b"]["duration_ms"]) == ("aborted", False, 3_600_000)
    assert (got["late"]["state"], got["late"]["error_class"], got["late"]["stage"]) == ("ended", "E", "v") and "orphan" not in got
    assert run(spark, tmp_path / "in", tmp_path) == got  # nothing new, nothing twice
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    log = spark.createDataFrame([{**dict.fromkeys(LOG.replace(" ", ",").split(",")[::1], None), **r} for r in first if r["call_id"] in "abc"], "event string, call_id string, pos long, stage string, success boolean, completion_tokens long, duration_ms long, finish_reason string")
    batch = {r.call_id: (r.stage, r.success, r.duration_ms) for r in telemetry.folded(log).collect()}
    assert batch["c"] == ("u", True, 70) and batch["a"][0] == "s"


def test_nothing_to_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], "event_id long, user_id long, event_type string").schema
    assert events.caught_up(events.fold(events.event_files(spark, str(tmp_path / "in"), schema)), "complete").count() == 0


def test_held_counts_spans_without_pairs(spark):
    rng = random.Random(5)
    spans = [(rng.randrange(3), b, b + rng.choice((0, 1, 2, 3, 7, 64, 100, 1000))) for b in (rng.randrange(-500, 1500) for _ in range(400))]
    spans += [(0, 10, 900)] * 50_000  # one place under many
    points = [(i, rng.randrange(4), rng.randrange(-600, 2600)) for i in range(300)] + [(1000 + i, 0, 100 + i) for i in range(2000)]
    s = spark.createDataFrame(spans, "file int, b long, e long")
    p = spark.createDataFrame(points, "id int, file int, at long")
    found = graph.held(p, s, "file", "at", "b", "e")
    got = {r.id: (r.spans, r.shortest, r.longest) for r in found.collect()}
    want = {}
    for i, f, at in points:
        sizes = [e - b for g, b, e in spans[:400] if g == f and b <= at < e] + [890] * (50_000 if f == 0 and 10 <= at < 900 else 0)
        if sizes:
            want[i] = (len(sizes), min(sizes), max(sizes))
    assert got == want


def test_held_broadcasts_nothing(spark, tmp_path, monkeypatch):
    """Points in small files, each looked up in 20 sizes: what is made of them is never gathered on the driver, and sizes looked up in several passes find the same."""
    monkeypatch.setattr(graph, "SIZES", 3)
    rng = random.Random(8)
    spans = [(rng.randrange(2), b, b + rng.choice((1, 2, 5, 8, 500, 4096, 10**5, 10**6))) for b in (rng.randrange(-(10**5), 10**6) for _ in range(300))]
    points = [(i, rng.randrange(3), rng.randrange(-(10**5), 2 * 10**6)) for i in range(300)] + [(1000 + i, 1, 5000) for i in range(500)] + [(7777, 1, 6000)] * 2 + [(8888, None, 1), (8889, 1, None)]
    spark.createDataFrame(points, "id int, file int, at long").write.parquet(f"{tmp_path}/points")
    store = spark._jsparkSession.sharedState().statusStore()
    ran = lambda: {(e := store.executionsList().apply(i)).executionId(): e.physicalPlanDescription() for i in range(store.executionsList().size())}
    before = ran()
    found = graph.held(spark.read.parquet(f"{tmp_path}/points"), spark.createDataFrame(spans, "file int, b long, e long"), "file", "at", "b", "e")
    got = sorted((r.id, r.spans, r.shortest, r.longest) for r in found.collect())
    want = []
    for i, f, at in sorted({p for p in points if None not in p}):
        sizes = [e - b for g, b, e in spans if g == f and b <= at < e]
        want += [(i, len(sizes) * (2 if i == 7777 else 1), min(sizes), max(sizes))] if sizes else []
    assert got == want and len(got) > 600
    plans = [text for k, text in ran().items() if k not in before]
    assert plans and not any("Broadcast" in text for text in plans)


def test_tiles_of_vectors_against_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE", 40)
    monkeypatch.setattr(search, "BLOCK", 7)
    rng = random.Random(6)
    vectors = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(60)]
    rows = [(i, vectors[i % 60] if i < 150 else vectors[3]) for i in range(300)]  # copies, and one vector half the time
    records = spark.createDataFrame([*rows, (999, None)], "rowid long, embedding array<float>")
    asked = records.filter("rowid % 20 = 0")
    from docgraph.functions.scalar import cosine_distance

    pairs = records.crossJoin(asked.select(F.col("rowid").alias("query_id"), F.col("embedding").alias("query")))
    pairs = pairs.withColumn("d", cosine_distance(F.col("embedding"), F.col("query"))).filter("d IS NOT NULL").select("query_id", "rowid", "d", (F.round("d", 6) + F.lit(0.0)).alias("r")).collect()
    found = search.nearest_each(records, asked.select(F.col("rowid").alias("query_id"), F.col("embedding").alias("query")), 5)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    want = {q: [(r, i) for r, i in sorted((p.r, p.rowid) for p in pairs if p.query_id == q)[:5]] for q in {p.query_id for p in pairs}}
    got: dict = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.rowid))
    assert got == want
    hits = {r.lookup: (r.hits, r.nearest, r.farthest) for r in search.hits_each(records, asked.select(F.col("rowid").alias("lookup"), F.col("embedding").alias("query")), 0.9).collect()}
    near = {q: [p.d for p in pairs if p.query_id == q and p.d <= 0.9] for q in want}
    assert {q: h[0] for q, h in hits.items()} == {q: len(x) for q, x in near.items() if x}
    assert all(abs(hits[q][1] - min(x)) < 1e-12 and abs(hits[q][2] - max(x)) < 1e-12 for q, x in near.items() if x)


def test_rounded_like_spark(spark):
    import numpy as np

    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, 0.1234565, 0.1234575, 1.0000005, -0.9999995, 0.7, 1 - 1e-17, 2.0]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", (F.round("x", 6) + F.lit(0.0)).alias("r")).collect()
    assert search.rounded(np.array(values)).tolist() == [r.r for r in sorted(rows)]


def test_calls_of_a_bucket_are_stored_at_once():
    from pyspark.sql import Row

    class Store:
        value, timers, touched = None, [], 0

        def getValueState(self, *_):
            return self

        def registerTimer(self, at):
            self.timers.append(at)

        def get(self):
            self.touched += 1
            return self.value

        def update(self, value):
            self.touched, self.value = self.touched + 1, value

        def clear(self):
            self.touched, self.value = self.touched + 1, None

        def getCurrentWatermarkInMs(self):
            return self.now

        def getExpiryTimeInMs(self):
            return self.timers[0]

    def event(kind, call, pos):
        return Row(event=kind, call_id=call, pos=pos, at_ms=1000 + pos, stage="s", **{**dict.fromkeys(calls.FIELDS), "success": True if kind == "end" else None})

    store = Store()
    store.now = 0
    states = calls.CallStates(5000)
    states.init(store)
    rows = [event("begin", f"c{i}", i) for i in range(1000)] + [event("end", f"c{i}", 1000 + i) for i in range(0, 1000, 2)]
    first = list(states.handleInputRows((0,), iter(rows), store))
    assert len(first) == 1000 and sum(r.state == "ended" for r in first) == 500
    assert store.touched == 2 and store.timers == [6000]
    store.now = 6499  # of the first half
    given_up = list(states.handleExpiredTimer((0,), store, store))
    assert [r.call_id for r in given_up] == [f"c{i}" for i in range(1, 500, 2)] and {r.duration_ms for r in given_up} == {5000}
    assert store.timers[-1] == 6500 and store.touched == 4
