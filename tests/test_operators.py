"""Operators on small fixtures with edge cases that the tables do not have."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docgraph.functions import scalar as S
from docgraph.operators import batches, display, facts, graph, knowledge, markers, model, phase, search, split, telemetry, turn
from docgraph.operators import entities as E
from docgraph.sources import chats, exports, files, jsonl, store
from docgraph.streaming import events


def test_greedy_bounds_prefer_paragraphs():
    text = "a" * 300 + ". " + "b" * 300 + "\n\n" + "c" * 1200
    bounds = split.greedy_bounds(text, 250)
    assert bounds[0] == (0, text.index("c"))
    assert [a for a, _ in bounds[1:]] == [b for _, b in bounds[:-1]] and bounds[-1][1] == len(text)
    assert split.greedy_bounds("short", 10) == [(0, 5)] and split.greedy_bounds("", 10) == [(0, 0)]


def test_gap_bounds_cut_at_largest_silence():
    lines = ["[1/1/24, 9:00:00 AM] A: " + "x" * 200, "[1/1/24, 9:05:00 AM] B: " + "y" * 200, "[2/1/24, 9:00:00 AM] A: " + "z" * 200]
    text = "\n".join(lines)
    assert split.gap_bounds(text, 160)[0] == (0, text.index(lines[2]))


def test_section_spans():
    spans = split.section_spans("intro\n# A\nx\n## B\ny\n# C\nz")
    assert [p for _, _, p in spans] == [[], ["A"], ["A", "B"], ["C"]]
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_resolve_tiers():
    text = "He said “hello  there” and left the building in a hurry on Tuesday."
    assert facts.resolve(text, "left the") == (text.index("left"), text.index("left") + 8, False)
    start, end, approximate = facts.resolve(text, '"hello there"')
    assert text[start:end] == "“hello  there”" and not approximate
    assert facts.resolve(text, "left the building in a rush on Monday evening, later")[2] is True
    assert facts.resolve(text, "zzz") is None and facts.resolve(text, "  ") is None


def test_balanced():
    assert json.loads(facts.balanced('{"items": [{"a": 1}, {"b": "x]"}, {"c": ')) == {"items": [{"a": 1}, {"b": "x]"}]}
    assert facts.balanced('{"a": 1} tail') == '{"a": 1}' and facts.balanced('{"a') is None


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "abdc", True), ("smith", "smyth", True), ("a", "ab", True), ("abcd", "acbx", False), ("", "", True), ("ab", "ba", True)])
def test_one_edit(spark, a, b, want):
    row = spark.range(1).select(S.one_edit(F.lit(a), F.lit(b)).alias("r")).head()
    assert row.r is want


def test_names_overlap(spark):
    pairs = [("sir thomas hale", "t hale", True), ("mom", "anna lee", True), ("duke", "lord", False), ("martin cook", "bristol", False), ("king", "king harold iii", True), ("the king", "the queen", False), ("king", "the king", True), ("snow", "anna lee", False), ("hendricks", "hendriks", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select(E.names_overlap(F.col("a"), F.col("b")).alias("got"), "want").collect())


def test_evenly_spaced(spark):
    want = {(10, 3): [1, 5, 9], (3, 5): [0, 1, 2], (5, 1): [4], (0, 2): []}
    df = spark.createDataFrame([(*k,) for k in want], "n int, k int")
    for r in df.select("n", "k", S.evenly_spaced(F.col("n"), F.col("k")).alias("i")).collect():
        assert r.i == want[r.n, r.k]


def test_folded_names(spark):
    df = spark.createDataFrame([("Éva  Müller-Straße",), (None,), ("ＡＢ①",)], "n string")
    assert [r.n for r in df.select(facts.folded_name("n").alias("n")).collect()] == ["eva muller straße", "", "ab1"]


def test_lookup_validation():
    call = search.tool_call({"lookups": [{"count": "99", "entry_type": ["fact", "nonsense"]}, {}, "x", {"has_neighbor": ["fact/1"]}]})
    assert [x.count for x in call.lookups] == [20, 15] and call.lookups[0].entry_type == ("fact",) and call.lookups[1].neighbors == (("fact", "1"),)
    assert len(call.dropped) == 2


def test_search_run_empty_anchor_gives_nothing(spark):
    records = spark.createDataFrame([(1, "fact", "1", "Hello", "f", [1.0, 0.0]), (2, "fact", "2", "World", "f", [0.0, 1.0])], "rowid int, kind string, record_id string, text string, file_id string, embedding array<double>")
    edges = spark.createDataFrame([("fact", "1", "fact", "2", "sibling")], "src_kind string, src_id string, dst_kind string, dst_id string, edge_kind string")
    run = lambda **k: [r.record_id for r in search.run(search.ToolCall((search.Lookup(**k),)), records, edges).collect()]
    assert run(query=(1.0, 0.1), entry_type=("fact",)) == ["1"]
    assert run(query=(1.0, 0.1), neighbors=()) == [] and run(neighbors=(("fact", "1"),)) == ["2"]
    assert run(exact_match=("WOR",)) == ["2"] and run(query=(1.0, 1.0), entry_type=("fact",)) == []


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(graph.components(links, "a", "b").collect())
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_ladder_ends(spark):
    calls = spark.createDataFrame([("a", "x" * 6000), ("b", "short")], "call_id string, prompt string")
    rows = model.run_ladder(calls, model.stub_provider).collect()
    assert {r.root_id for r in rows} == {"a", "b"} and all(r.attempt <= model.MOST_HALVES for r in rows)


def test_chain_cycle_is_its_own_root(spark):
    calls = spark.createDataFrame([("a", "b", "x", "success"), ("b", "a", "x", "success"), ("c", None, "x", "success")], "call_id string, retry_of_call_id string, category string, outcome string")
    assert {r.call_id for r in telemetry.chains(calls).filter("root = call_id").collect()} >= {"c"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" hello ")
    (tmp_path / "b.html").write_text("<p>")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("n.md", "# t")
        z.writestr("__MACOSX/._n.md", "x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.zip", inner.getvalue())
    got = {r.file_id.rsplit("/", 1)[-1]: r.content for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "hello", "z.zip::in.zip::n.md": "# t"}


def test_chats(spark):
    web = [{"uuid": "u", "name": "T", "summary": "", "created_at": "2024-01-02T03:04:05Z", "chat_messages": [{"sender": "human", "content": [{"type": "text", "text": "KEEP"}, {"type": "tool", "text": "DROP"}]}, {"sender": "assistant", "content": [], "text": "DROP"}]}]
    gpt = [{"title": "t", "conversation_id": "c", "create_time": 1.7e9, "mapping": {"1": {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["B"]}, "create_time": 2.0}}, "2": {"message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["A"]}, "create_time": 1.0}}, "3": {"message": None}}}]
    df = spark.createDataFrame([(json.dumps(web),)], "content string")
    row = chats.web_conversations(df).head()
    assert row.text == "# T\n\nKEEP" and row.date == "2024-01-02"
    assert spark.createDataFrame([(json.dumps(web),)], "c string").select(chats.shape(F.col("c")).alias("s")).head().s == "web_conversations"
    assert chats.chatgpt(spark.createDataFrame([(json.dumps(gpt),)], "content string")).head().text == "# t\n\nA\n\nB"


def test_journal_years(spark):
    entries = {"entries": [{"text": "new", "creationDate": "2024-05-01T23:30:00Z", "timeZone": "Europe/Berlin"}, {"text": "old", "creationDate": "2022-05-01T10:00:00Z"}, {"text": "undated"}]}
    got = {r.text: (r.entry_id, r.date) for r in chats.journal(spark.createDataFrame([("j.json", json.dumps(entries))], "file_id string, content string")).collect()}
    assert got["new"] == ("j.json::entry_000", "2024-05-02") and got["undated"][0] == "j.json::entry_001" and got["old"][0] == "j-2022.json::entry_000"


def test_rewritten_anchors():
    assert knowledge.rewritten_anchors(["[2]", "fact/9", "[7]", "x"], [("fact", "1"), ("entity", "bob")]) == (["entity/bob", "fact/9"], ["out_of_range", "malformed"])


def test_halves():
    text = "a" * 140 + "\n\n" + "b" * 150
    assert knowledge.halves(text) == (text[:142], text[142:]) and knowledge.halves("short") is None
    assert [len(h) for h in knowledge.halves("c" * 300)] == [150, 150]


def test_date_slices_fit(spark):
    rows = spark.createDataFrame([(o, i, 100) for o in range(2) for i in range(3 + 20 * o)], "o int, i int, n int")
    got = knowledge.date_slices(rows, "o", ["i"], "n", 400).groupBy("o", "slice").agg(F.sum("n").alias("t")).collect()
    assert max(r.t for r in got) <= 400 and len({r.slice for r in got if r.o == 0}) == 1


def test_jsonl_round_trip(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    path = str(tmp_path / "facts")
    jsonl.append_by_topic(spark.createDataFrame([("work", 1), ("home", 2)], "topic string, idx int"), path)
    jsonl.append_by_topic(spark.createDataFrame([("work", 3)], "topic string, idx int"), path)
    (tmp_path / "facts" / "topic=work" / "torn.json").write_text('{"idx": 4}\n{"idx": ')
    good, bad = jsonl.read_tolerant(spark, path, StructType([StructField("idx", IntegerType()), StructField("topic", StringType())]))
    assert sorted((r.topic, r.idx) for r in good.cache().collect()) == [("home", 2), ("work", 1), ("work", 3), ("work", 4)]


def test_entity_records_unknown_ends_dropped(spark):
    rows = spark.createDataFrame([("g1", "g2", "Works With", 1), ("g1", "g2", "later", 2), ("g1", "g9", "x", 3), ("g1", "g1", "x", 4)], "gid string, to_gid string, verb string, pos int")
    groups = spark.createDataFrame([("g1",), ("g2",)], "gid string")
    assert [(r.to_gid, r.verb) for r in knowledge.annotations(rows, groups).collect()] == [("g2", "works_with")]


def test_stub_streams_agree(spark, tmp_path):
    from docgraph.streaming import events

    spark.createDataFrame([(i, i % 3, "error" if i % 4 == 0 else "view") for i in range(40)], "event_id long, user_id long, event_type string").repartition(4).write.json(str(tmp_path / "log"))
    schema = spark.read.json(str(tmp_path / "log")).schema
    got = {r.user_id: (r.events, r.errors) for r in events.caught_up(events.fold(events.event_files(spark, str(tmp_path / "log"), schema, per_trigger=1)), "complete").collect()}
    assert got == {u: (sum(i % 3 == u for i in range(40)), sum(i % 3 == u and i % 4 == 0 for i in range(40))) for u in range(3)}


def test_sampled_to_fit_is_largest(spark):
    from docgraph.operators import synthesis

    sizes = [((i * 37) % 50 + 1) * 30 for i in range(60)]
    rows = spark.createDataFrame([("t", i, n) for i, n in enumerate(sizes)] + [("small", 0, 10)], "topic string, idx long, n long")
    spaced = lambda k: [59] if k == 1 else sorted({int((i + 0.5) * 60 / k) for i in range(k - 1)} | {59})
    got = [r.idx for r in synthesis.sampled_to_fit(rows, 5000).filter("topic = 't'").orderBy("idx").collect()]
    assert got == spaced(len(got)) and sum(sizes[i] for i in got) // 3 <= 5000 and got[-1] == 59
    assert synthesis.sampled_to_fit(rows, 5000).filter("topic = 'small'").count() == 1


def test_vector_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    records = spark.createDataFrame([("fact", "1", "a"), ("chunk", "2", "b")], "kind string, record_id string, text string")
    vectors = spark.createDataFrame([("fact", "1", [1.0, 0.0]), ("chunk", "2", [0.0, 1.0])], "kind string, record_id string, embedding array<double>")
    store.add(records, vectors, 2, path)
    assert {(r.kind, r.record_id, r.text, tuple(r.embedding)) for r in store.records(spark, path).collect()} == {("fact", "1", "a", (1.0, 0.0)), ("chunk", "2", "b", (0.0, 1.0))}
    assert {r.kind: r.n for r in store.counts_by_kind(store.records(spark, path), ("fact", "pattern")).collect()} == {"fact": 1, "chunk": 1, "pattern": 0}
    for bad in (vectors.limit(1), vectors.withColumn("embedding", F.array(F.lit(1.0)))):
        with pytest.raises(Exception, match="do not align"):
            store.aligned(records, bad, 2).collect()
    kind = "src_kind string, src_id string, dst_kind string, dst_id string, edge_kind string, nth int"
    edges = spark.createDataFrame([("a", "1", "b", "2", "late", 2), ("a", "1", "b", "2", "first", 1), ("b", "2", "a", "1", "back", 3)], kind)
    assert store.stored_edges(spark, path) is None and store.add_edges(edges.limit(0), path, "nth") == 0 and store.stored_edges(spark, path).count() == 0
    assert store.add_edges(edges, path, "nth") == 2 and store.add_edges(edges, path, "nth") == 0
    assert sorted(r.edge_kind for r in store.stored_edges(spark, path).collect()) == ["back", "first"]


def test_chat_dispatch_of_odd_files(spark):
    lines = ['{"type": "user", "sessionId": "0123456789", "message": {"content": [{"type": "tool_result", "text": "no"}, {"type": "text", "text": " one "}]}}', "", "no json", '{"type": "custom-title", "customTitle": " Named "}', '{"type": "assistant", "message": {"content": "no"}}']
    rows = [
        ("a.jsonl", ".jsonl", "\n".join(lines)), ("b.jsonl", ".jsonl", '{"type": "assistant", "sessionId": "x"}'), ("c.jsonl", ".jsonl", '{"other": 1}'), ("d.jsonl", ".jsonl", " \n"), ("e.json", ".json", "[]"),
        ("f.json", ".json", json.dumps([{"uuid": "abcdefghij", "name": "Talk", "summary": "", "created_at": "2024-02-03T00:00:00Z", "chat_messages": [{"sender": "human", "text": "hi", "content": [], "created_at": ""}]}])),
        ("g.json", ".json", '{"name": "", "prompt_template": "", "description": ""}'), ("h.json", ".json", "{broken"), ("i.json", ".json", None),
    ]
    got = {r.doc_id: r for r in exports.parsed(spark.createDataFrame(rows, "file_id string, suffix string, content string")).collect()}
    assert set(got) == {"a.jsonl", "f.json::conv_abcdefgh"}
    assert got["a.jsonl"].content == "# Named\n\none" and got["a.jsonl"].session_id == "0123456789" and got["a.jsonl"].title == "Named"
    assert got["f.json::conv_abcdefgh"].content == "# Talk\n\nhi" and got["f.json::conv_abcdefgh"].date == "2024-02-03"


def test_markers_without_free_text(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "ok", "0001"), ("2024-01-01T00:00:00Z", "free text", "0001"), ("0001", "ok", "12")], "ts string, state string, call_id string")
    assert [r.n for r in rows.select(markers.free_leaves(rows.schema, ["ok"]).alias("n")).collect()] == [0, 1, 2]
    assert markers.content_free(rows.limit(1), ["ok"]).count() == 1
    with pytest.raises(Exception, match="free text"):
        markers.content_free(rows, ["ok"]).collect()


def test_embedding_batches(spark):
    asked = spark.sparkContext.accumulator(0)

    def flaky(texts):
        asked.add(1)
        if len(texts) > 1 or texts == ["bad"]:
            raise TimeoutError
        return [[1.0]]

    df = spark.createDataFrame([("x",), ("x",), ("bad",), (None,)], "text string").filter("text is not null").coalesce(1)
    got = {r.text: r.embedding for r in batches.embedded(df, "text", flaky).collect()}
    assert got["x"] == [1.0] and got["bad"] is None and len(got) == 2


def test_numbers_and_durations(spark):
    shown = [r.d for r in spark.createDataFrame([(None,), (5,), (1500,), (61_000,), (3_661_000,)], "ms long").select(display.duration(F.col("ms")).alias("d")).collect()]
    assert shown == ["—", "5ms", "1.5s", "1m 1s", "1h 1m 1s"]
    shown = [r.d for r in spark.createDataFrame([(None,), (1234.0,), (1234.5,)], "n double").select(display.grouped_number(F.col("n")).alias("d")).collect()]
    assert shown == ["—", "1,234", "1,234.50"]


def test_outcomes_of_odd_files(spark, tmp_path):
    def packed(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    deep = packed({"last.txt": "never"})
    for k in range(9):
        deep = packed({f"{k}.zip": deep})
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    (tmp_path / "bad.docx").write_bytes(b"no document")
    (tmp_path / "deep.zip").write_bytes(deep)
    (tmp_path / "mixed.zip").write_bytes(packed({"a.txt": "kept", "b.docx": b"broken", "c.exe": b"x"}))
    (tmp_path / "talk.jsonl").write_text('{"type": "user", "sessionId": "s", "message": {"content": "typed"}}\n')
    (tmp_path / "plain.json").write_text('{"k": 1}')
    got = {r.file_id.rsplit("/", 1)[-1]: r.reason for r in files.outcomes(spark, str(tmp_path)).collect()}
    assert got["bad.zip"] == got["bad.docx"] == "damaged" and got["mixed.zip::a.txt"] is None and got["mixed.zip::b.docx"] == "damaged" and got["mixed.zip::c.exe"] == "unsupported"
    assert [v for k, v in got.items() if k.startswith("deep.zip")] == ["nested"]
    read = {r.file_id.rsplit("/", 1)[-1]: (r.source_type, r.content) for r in files.read_text(spark, str(tmp_path)).collect()}
    assert read == {"mixed.zip::a.txt": ("text", "kept"), "talk.jsonl": ("code_session", "# typed\n\ntyped"), "plain.json": ("json", '{"k": 1}')}


def test_chat_turn(spark):
    records = spark.createDataFrame([("fact", str(i), i, f"text {i}", "f") for i in range(5)], "kind string, record_id string, rowid int, text string, file_id string")
    edges = spark.createDataFrame([], "src_kind string, src_id string, dst_kind string, dst_id string, edge_kind string")
    replies = iter([{"lookups": [{"exact_match": ["text 1"]}]}, "{ no json", {"lookups": [{"exact_match": ["text 1", "text 3"]}]}, "done"])
    turn_ = turn.run("what?", records, edges, lambda *_: next(replies))
    assert (turn_.answer, turn_.hops, turn_.retrieved, turn_.notes) == ("done", 2, [("fact", "1"), ("fact", "3")], [turn.MALFORMED])
    asked = []
    stuck = turn.run("what?", records, edges, lambda q, r, n, final: asked.append(final) or ("forced" if final else "{"))
    assert stuck.answer == "forced" and asked == [False, False, True] and turn.run(" ", records, edges, None).answer == ""


def test_job_of_phases(spark):
    class Counts:
        name = "counts"

        def build_calls(self, tables):
            return tables["docs"].select(F.col("id").alias("call_id"), F.col("text").alias("prompt"))

        def parse(self, replies):
            return replies.select("root_id", "status", F.length("payload").alias("n"))

        def reduce(self, rows, tables):
            return {self.name: rows}

    docs = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string")
    out = phase.run_job([Counts()], {"docs": docs}, lambda b: [{"payload": p} for p in b["prompt"]])
    assert {(r.root_id, r.status, r.n) for r in out["counts"].collect()} == {("a", "OK", 3), ("b", "OK", 3)}
    assert "counts" not in phase.run_job([Counts()], {"docs": docs}, None, done=["counts"])


def test_stream_is_persisted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"event_id": k}))
    schema = spark.createDataFrame([], "event_id long").schema
    for _ in range(2):  # a restart adds nothing
        events.persisted(events.event_files(spark, str(tmp_path / "in"), schema, per_trigger=1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_numbers_in_order(spark):
    rows = spark.range(200).select((F.col("id") * 37 % 200).alias("k")).repartition(5)
    got = E.numbered(rows, [F.desc("k")]).collect()
    assert {r.k: r.gid for r in got} == {k: f"g{200 - k}" for k in range(200)} and E.numbered(rows.limit(0), ["k"]).count() == 0


def test_data_address_is_one_line(spark):
    import base64

    data = [bytes(range(n % 256)) * (1 + n // 256) for n in (0, 1, 56, 57, 58, 200, 1000)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x binary").select("i", S.data_address(F.col("x"), "image/png").alias("a")).collect()
    assert {r.i: r.a for r in rows} == {i: "data:image/png;base64," + base64.b64encode(x).decode() for i, x in enumerate(data)}


def test_batches_of_python_are_bounded_by_bytes(spark):
    from docgraph.session import ARROW_BYTES, python_map

    rows = spark.range(4000, numPartitions=1).withColumn("text", F.repeat(F.lit("x"), F.lit(10_000)))
    sizes = python_map(rows, lambda batches: (b.head(1).assign(n=b["text"].str.len().sum())[["n"]] for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 40_000_000 and max(r.n for r in sizes) <= ARROW_BYTES + 10_000


def test_chunks_are_handed_on_before_a_batch_ends(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"# a{i}\n" + "word " * 4000 + "\n## b\nend") for i in range(8)], "doc_id long, text string").coalesce(1)
    held = split.chunk(docs, limit=1)
    want = {(r.doc_id, r.char_offset): (r.section_path, r.chunk) for r in held.collect()}
    assert len(want) > 2 * split.PIECES and held.count() == len(want)
    monkeypatch.setattr(split, "PIECES", 37)
    assert {(r.doc_id, r.char_offset): (r.section_path, r.chunk) for r in split.chunk(docs, limit=1).collect()} == want


def test_candidates_are_resolved_without_all_groups_of_a_name(spark):
    groups = [("ann", t, m, n) for t, m, n in ((1, 5, "Ann"), (2, 9, "ANN b"), (3, 9, "ann C"))] + [("bob", 1, 1, "Bob")]
    g = spark.createDataFrame(groups, "name string, entity_type int, mention_count long, canonical_name string")
    c = spark.createDataFrame([(1, "ann", 1), (2, "ann", 7), (3, "bob", 2), (4, "eve", 1), (5, "ann", 2), (6, "bob", 9), (6, "ann", 1), (7, "ann", None), (8, None, 1)], "candidate int, name string, kind int")
    found = E.resolved(c, g, "name", "kind")
    assert {r.candidate: r.canonical_name for r in found.collect()} == {1: "Ann", 2: "ann C", 3: "Bob", 5: "ANN b", 6: "Ann", 7: "ann C"}
    assert "Window" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1000, 5])
def test_pairs_are_counted_where_they_are_made(spark, block):
    import random
    from collections import Counter

    rng = random.Random(2)
    rows = [(rng.randrange(30), rng.randrange(60)) for _ in range(400)] + [(i, 77) for i in range(25)] + [(None, 1), (1, None)]
    df = spark.createDataFrame(rows, "id int, item int")
    found = graph.pair_counts(df, "id", "item", block=block)
    plan = found._jdf.queryExecution().executedPlan().toString()
    own = {r for r in rows if None not in r}
    want = Counter((a, b) for a, i in own for b, j in own if i == j and a != b)
    assert {(r.entity, r.other): r.shared for r in found.collect()} == want
    if block == 1000:  # what is shuffled are members with their lists: no exchange above the counts, and no join
        assert "Join" not in plan and plan.count("Exchange") == 2


def test_edges_are_dealt_over_partitions_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS", 10)
    fe = spark.createDataFrame([(i, i % 3) for i in range(100)], "fact int, entity int")
    pairs = lambda a, b: spark.createDataFrame([(0, 0), (1, 1)], f"{a} int, {b} int")
    found = knowledge.build_edges(pairs("chunk", "fact"), pairs("a", "b"), fe, pairs("pattern", "fact"), pairs("a", "b"), pairs("insight", "pattern"), pairs("action", "insight"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dst_id" in plan and ", 40), REPARTITION_BY_NUM" in plan
    assert found.filter("src_kind = 'fact' AND dst_kind = 'entity'").count() == 100
