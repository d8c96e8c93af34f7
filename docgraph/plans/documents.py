"""Queries over documents: chunking, splitting, packing, fact validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import facts, split
from .registry import query, table


@query("spl_tokens", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS tokens FROM documents")
def spl_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", S.count_tokens(F.col("text")).alias("tokens"))


@query(
    "spl_slide_chunks",
    """WITH w AS (SELECT doc_id, source, text, length(text) AS n FROM documents WHERE lang = 'en'),
    c AS (SELECT doc_id, source, o AS char_offset, trim(substr(text, CAST(o AS BIGINT) + 1, 1536)) AS chunk FROM (
      SELECT doc_id, source, text, n, unnest(generate_series(0, CASE WHEN n <= 1536 THEN 0 ELSE CAST(ceil((n - 1536) / 1344.0) AS BIGINT) * 1344 END, 1344)) AS o FROM w WHERE n > 0))
    SELECT doc_id, source, CAST(char_offset AS INTEGER) AS char_offset, chunk FROM c WHERE contains(lower(chunk), 'tion') ORDER BY source, doc_id, char_offset LIMIT 50""",
)
def spl_slide_chunks(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "source", "text")
    chunks = split.slide(docs).drop("text").filter(F.contains(F.lower("chunk"), F.lit("tion")))
    return chunks.orderBy("source", "doc_id", "char_offset").limit(50)


@query(
    "spl_chunk_counts",
    """SELECT doc_id, CASE WHEN length(text) <= 1536 THEN 1 ELSE CAST(ceil((length(text) - 1536) / 1344.0) AS BIGINT) + 1 END AS chunks FROM documents WHERE length(trim(text)) > 0""",
)
def spl_chunk_counts(spark, d):
    docs = table(spark, d, "documents").filter(F.length(F.trim("text")) > 0).select("doc_id", "text")
    return split.slide(docs).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("spl_sections")
def spl_sections(spark, d):
    return split.chunk(table(spark, d, "documents"))


@query("spl_greedy_split")
def spl_greedy_split(spark, d):
    return split.split(table(spark, d, "documents"), budget=500).select("doc_id", "part", "n_parts", "origin_char", F.length("text").alias("n"))


@query(
    "spl_report",
    """SELECT source, count(*) AS docs, CAST(sum(CASE WHEN length(text) // 3 <= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS fits, CAST(sum(CAST(ceil(length(text) / 3000.0) AS BIGINT)) AS BIGINT) AS pieces, max(length(text)) AS largest FROM documents GROUP BY source""",
)
def spl_report(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("docs"), F.count_if(F.floor(n / 3) <= 1000).alias("fits"), F.sum(F.ceil(n / 3000)).alias("pieces"), F.max(n).alias("largest")
    )


@query(
    "spl_islands",
    """WITH c AS (SELECT doc_id, source, lang, CASE WHEN lang IS NOT DISTINCT FROM lag(lang) OVER (PARTITION BY source ORDER BY doc_id) THEN 0 ELSE 1 END AS ch FROM documents),
    i AS (SELECT *, sum(ch) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
    SELECT source, CAST(island AS BIGINT) AS island, min(lang) AS lang, min(doc_id) AS first_doc, count(*) AS docs FROM i GROUP BY source, island""",
)
def spl_islands(spark, d):
    rows = split.islands(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source"], ["doc_id"], F.col("lang"))
    return rows.groupBy("source", "island").agg(F.min("lang").alias("lang"), F.min("doc_id").alias("first_doc"), F.count("*").alias("docs"))


@query(
    "spl_greedy_pack",
    """WITH RECURSIVE r AS (SELECT source, doc_id, greatest(1, length(text) // 3) AS tok, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    p AS (SELECT source, doc_id, tok, rn, CAST(0 AS BIGINT) AS bin, CAST(tok AS BIGINT) AS load FROM r WHERE rn = 1
      UNION ALL SELECT r.source, r.doc_id, r.tok, r.rn, CASE WHEN p.load + r.tok > 4000 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.load + r.tok > 4000 THEN r.tok ELSE p.load + r.tok END
      FROM p JOIN r ON r.source = p.source AND r.rn = p.rn + 1)
    SELECT source, doc_id, CAST(tok AS BIGINT) AS tok, bin FROM p""",
)
def spl_greedy_pack(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 3)).cast("long").alias("tok"))
    return split.greedy_pack(rows, ["source"], ["doc_id"], "tok", 4000)


@query(
    "spl_combined",
    """WITH RECURSIVE u AS (SELECT source, doc_id, lang, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END AS tok, length(lang) + 9 AS sep FROM documents),
    f AS (SELECT *, coalesce(CASE WHEN tok < 400 THEN lang END, '/' || doc_id) AS k FROM u),
    c AS (SELECT *, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER (PARTITION BY source ORDER BY doc_id) THEN 0 ELSE 1 END AS cut FROM f),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY doc_id) AS rn, sum(tok + sep) OVER (PARTITION BY source, run) - first_value(sep) OVER (PARTITION BY source, run ORDER BY doc_id) AS total FROM r),
    p AS (SELECT source, run, doc_id, rn, total, CAST(0 AS BIGINT) AS bin, CAST(tok AS BIGINT) AS load FROM n WHERE rn = 1
      UNION ALL SELECT n.source, n.run, n.doc_id, n.rn, n.total, CASE WHEN p.load + n.tok + n.sep > 500 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.load + n.tok + n.sep > 500 THEN n.tok ELSE p.load + n.tok + n.sep END
      FROM p JOIN n ON n.source = p.source AND n.run = p.run AND n.rn = p.rn + 1)
    SELECT source, doc_id, CAST(run AS BIGINT) AS run, CASE WHEN total <= 800 THEN 0 ELSE bin END AS bin FROM p""",
)
def spl_combined(spark, d):
    """Small documents of one language that follow each other in a source, joined within 800 tokens where all of a run fit, else within 500."""
    units = table(spark, d, "documents").select("source", "doc_id", "lang", "text")
    tokens = S.count_tokens(F.col("text"))
    found = split.combined(units, ["source"], ["doc_id"], F.when(tokens < 400, F.col("lang")), tokens, F.length("lang") + 9, 800, most=500)
    return found.select("source", "doc_id", "run", "bin")


@query("spl_carved")
def spl_carved(spark, d):
    """The first document of more than 300 tokens leads: its head within 150 tokens, the rest in parts of 200."""
    docs = table(spark, d, "documents").filter(F.length("text") > 900)
    return split.carved(docs.select("doc_id", "text"), "doc_id", cap=150, budget=200).select("doc_id", "piece", "kind", "origin_char", "text")


@query(
    "spl_running_offsets",
    """SELECT source, doc_id, CAST(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_char,
    CAST(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - (length(text) + 2) AS BIGINT) AS begin_char FROM documents""",
)
def spl_running_offsets(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("n"))
    return split.running_offsets(rows, ["source"], ["doc_id"], F.col("n") + 2).drop("n")


@query(
    "spl_chat_gap_sessions",
    """WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, 1 + sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY user_id, session""",
)
def spl_chat_gap_sessions(spark, d):
    rows = split.gap_sessions(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"])
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query("spl_batches", "SELECT source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch, doc_id FROM documents")
def spl_batches(spark, d):
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("source", F.floor((n - 1) / 32).alias("batch"), "doc_id")


@query(
    "spl_batchable",
    "SELECT doc_id, (source IN ('src0', 'src1', 'src2')) AND (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 3) END) < 1000 AS batchable FROM documents",
)
def spl_batchable(spark, d):
    docs = table(spark, d, "documents")
    kind = F.when(F.col("source").isin("src0", "src1", "src2"), "text").otherwise("chat")
    return docs.select("doc_id", split.batchable(kind, F.col("text"), budget=4000).alias("batchable"))


@query(
    "fact_validate_json",
    """WITH e AS (SELECT event_id, event_type, value, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, event_type AS item_type, k, least(1.0, greatest(0.0, value / 100.0)) AS confidence FROM e WHERE event_type IN ('click', 'view', 'purchase') AND k IS NOT NULL""",
)
def fact_validate_json(spark, d):
    events = table(spark, d, "events").withColumn("item", F.from_json("props", "k bigint"))
    valid = facts.valid_items(events, F.col("event_type"), ("click", "view", "purchase"), F.col("item.k").isNotNull())
    return valid.select("event_id", F.col("event_type").alias("item_type"), F.col("item.k").alias("k"), S.clamp01(F.col("value") / 100.0).alias("confidence"))


@query(
    "fact_explode_topics",
    """WITH t AS (SELECT doc_id, unnest(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN [d.source, d.lang] WHEN l.quality = 1 THEN [d.source] ELSE CAST([] AS VARCHAR[]) END) AS topic, n_chars FROM documents d JOIN labels l USING (doc_id))
    SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY n_chars, doc_id) - 1 AS idx FROM t""",
)
def fact_explode_topics(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    none = F.expr("CAST(array() AS array<string>)")
    topics = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.array("source", "lang")).when(F.col("quality") == 1, F.array("source")).otherwise(none)
    out = facts.by_topic(rows.withColumn("topics", topics), ["n_chars", "doc_id"])
    return out.select("topic", "doc_id", F.col("idx").cast("long").alias("idx"))


@query(
    "fact_dedup_first",
    r"""WITH n AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[.,!?|]', '', 'g') AS norm FROM documents)
    SELECT min(doc_id) AS doc_id, count(*) AS copies, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS members FROM n WHERE norm <> '' GROUP BY norm""",
)
def fact_dedup_first(spark, d):
    norm = F.regexp_replace(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), "[.,!?|]", "")
    out = facts.dedup_first(table(spark, d, "documents").select("doc_id", norm.alias("norm")), "norm", "doc_id")
    return out.select("doc_id", "copies", F.array_join("members", ",").alias("members"))


@query(
    "fact_order",
    "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, coalesce(n_chars, 0), doc_id) - 1 AS idx FROM documents",
)
def fact_order(spark, d):
    w = Window.partitionBy("source").orderBy("lang", F.coalesce("n_chars", F.lit(0)), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query(
    "fact_small_topic_gate",
    "SELECT source, lang, count(*) AS facts FROM documents GROUP BY source, lang HAVING count(*) >= 3",
)
def fact_small_topic_gate(spark, d):
    return facts.large_topics(table(spark, d, "documents"), ["source", "lang"], 3)


@query(
    "fact_first_person",
    r"SELECT doc_id, regexp_matches(lower(text), '\b(i|me|my|mine|je|moi|ich|mich|yo)\b') AS first_person FROM documents",
)
def fact_first_person(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower("text").rlike(r"\b(i|me|my|mine|je|moi|ich|mich|yo)\b").alias("first_person"))


@query("fact_spans")
def fact_spans(spark, d):
    quote = F.substring("text", 11, 60)
    return facts.resolved_spans(table(spark, d, "documents").select("doc_id", "text", quote.alias("quote"))).drop("quote")


@query("fact_edited_spans")
def fact_edited_spans(spark, d):
    """Quotes as models give them, by doc_id: exact, with other white space, with another end, of a middle alone, and of nothing there."""
    part = lambda a, n: F.substring("text", a, n)
    edits = (part(21, 80), F.regexp_replace(part(31, 90), " ", "\n  "), F.concat(part(11, 50), F.lit(" and so on, as they say")), F.concat(F.lit("zzz qqq "), part(41, 60), F.lit(" qqq")), F.lit("0000 no such words 0000"))
    kind = F.pmod("doc_id", F.lit(len(edits))).cast("int")
    docs = table(spark, d, "documents").select("doc_id", "text")
    return facts.quoted_spans(docs, docs.select("doc_id", F.element_at(F.array(*edits), kind + 1).alias("quote")))


@query("fact_salvaged_json")
def fact_salvaged_json(spark, d):
    cut = F.concat(F.lit('{"items": ['), F.col("props"), F.lit(', {"k": 1')).alias("payload")
    return facts.salvaged(table(spark, d, "events").select("event_id", cut))
