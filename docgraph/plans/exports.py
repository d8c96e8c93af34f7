"""Queries over chat exports, the vector store, batches and records as they go to disk."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import batches, display, vault
from ..session import shared_folder
from ..sources import exports, pages, store
from .registry import query, table

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ANCHOR = "rtrim(substr(trim(split_part({}, chr(10), 1)), 1, 80), '.')"


@query(
    "src_chat_dispatch",
    f"""WITH t AS (SELECT conv_id, turn, role, {STRIP.format('text')} AS t FROM conversations),
    h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, CAST(TIMESTAMP '2024-03-05 10:00:00' + INTERVAL 20 DAY * turn AS DATE) AS day, 2022 + turn % 3 AS year FROM t WHERE role = 'user' AND t <> ''),
    u AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS body, arg_min(t, turn) AS first, count(*) AS typed FROM h GROUP BY 1),
    s AS (SELECT conv_id, {ANCHOR.format('first')} AS head, body, typed FROM u WHERE conv_id % 8 < 2),
    p AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 8 = 2 GROUP BY 1),
    m AS (SELECT conv_id, strftime(day, '%Y-%m') AS month, min(day) AS day, count(*) AS typed, string_agg('[/p' || turn % 2 || '] ' || t, chr(10) || chr(10) ORDER BY turn) AS code,
      string_agg('[session ' || substr('session-' || conv_id, 1, 8) || '] ' || t, chr(10) || chr(10) ORDER BY turn) AS codex FROM h WHERE conv_id % 8 IN (3, 4) GROUP BY 1, 2),
    j AS (SELECT conv_id, turn, year, t, max(year) OVER (PARTITION BY conv_id) AS newest, row_number() OVER (PARTITION BY conv_id, year ORDER BY turn) - 1 AS n FROM h WHERE conv_id % 8 = 5)
    SELECT 'f' || conv_id || '.jsonl' AS doc_id, CASE conv_id % 8 WHEN 0 THEN 'code_session' ELSE 'codex_session' END AS source_type, head AS title, '2024-03-05' AS date,
      CASE WHEN head <> '' THEN '# ' || head || chr(10) || chr(10) ELSE '' END || 'cwd: /home/u' || chr(10) || chr(10) || body AS content, 's' || conv_id AS session_id, typed FROM s
    UNION ALL SELECT 'f' || conv_id || '.json', 'web_project', 'Project ' || conv_id, '2024-03-05', '# Project: Project ' || conv_id || chr(10) || chr(10) || 'Custom instructions:' || chr(10) || 'Turns: ' || n, 'u' || conv_id, 0 FROM p
    UNION ALL SELECT 'f' || conv_id || '.jsonl::month_' || month, CASE conv_id % 8 WHEN 3 THEN 'code_history' ELSE 'codex_history' END, CASE conv_id % 8 WHEN 3 THEN 'Code' ELSE 'Codex' END || ' prompts ' || month, CAST(day AS VARCHAR),
      '# ' || CASE conv_id % 8 WHEN 3 THEN 'Code' ELSE 'Codex' END || ' prompts \u2014 ' || month || chr(10) || chr(10) || CASE conv_id % 8 WHEN 3 THEN code ELSE codex END, '', typed FROM m
    UNION ALL SELECT 'f' || conv_id || CASE WHEN year < newest THEN '-' || year ELSE '' END || '.json::entry_' || lpad(CAST(n AS VARCHAR), 3, '0'), 'journal', 'Journal ' || year || '-05-02', year || '-05-02', t, 'u' || turn, 0 FROM j
    UNION ALL SELECT 'f' || conv_id || '.json::conv_' || substr(CASE conv_id % 8 WHEN 6 THEN 'uuid-' ELSE 'gpt-' END || conv_id, 1, 8), CASE conv_id % 8 WHEN 6 THEN 'web_conversation' ELSE 'chatgpt_conversation' END,
      'Talk ' || conv_id, '2024-03-05', '# Talk ' || conv_id || chr(10) || chr(10) || body, CASE conv_id % 8 WHEN 6 THEN 'uuid-' ELSE 'gpt-' END || conv_id, 0 FROM u WHERE conv_id % 8 > 5""",
)
def src_chat_dispatch(spark, d):
    """Conversations written as files of all eight known shapes, by conv_id, and read back by the dispatch."""
    turns = table(spark, d, "conversations")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    k, turn, said, user = F.col("conv_id") % 8, F.col("turn"), F.col("text"), F.col("role") == "user"
    own, typed = F.col("conv_id").cast("string"), F.when(user, "user").otherwise("assistant")
    stamp, seconds = F.format_string("2024-03-05T10:%02d:00Z", "turn"), F.lit(1709632800) + turn * (20 * 86400)
    session = (text("s", own).alias("sessionId"), stamp.alias("timestamp"))
    code = F.struct(typed.alias("type"), *session, F.lit("/home/u").alias("cwd"), F.struct(said.alias("content")).alias("message"))
    blocks = F.struct(typed.alias("type"), *session, F.struct(F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))).alias("content")).alias("message"))
    event = F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.when(user, "user_message").otherwise("agent_message").alias("type"), said.alias("message")).alias("payload"))
    prompt = F.struct(F.when(user, said).otherwise("").alias("display"), text("/p", (turn % 2).cast("string")).alias("project"), (seconds * 1000).alias("timestamp"))
    typed_in = F.struct(text("session-", own).alias("session_id"), F.when(user, said).otherwise("").alias("text"), seconds.alias("ts"))
    entry = F.struct(text("u", turn.cast("string")).alias("uuid"), F.when(user, said).otherwise("").alias("text"), text((2022 + turn % 3).cast("string"), "-05-01T23:30:00Z").alias("creationDate"), F.lit("Europe/Berlin").alias("timeZone"))
    message = F.struct(F.when(user, "human").otherwise("assistant").alias("sender"), said.alias("text"))
    node = F.struct(F.struct(F.struct(typed.alias("role")).alias("author"), F.struct(F.lit("text").alias("content_type"), F.array(said).alias("parts")).alias("content"), seconds.alias("create_time")).alias("message"))
    shapes = (code, event, code, prompt, typed_in, entry, message, node)
    line = F.when((k == 0) & (turn % 2 == 1), F.to_json(blocks))
    for i, shape in enumerate(shapes):
        line = line.when(k == i, F.to_json(shape))
    files = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"), F.count("*").alias("n"))
    listed = F.transform("x", lambda r: r["l"])
    title = F.to_json(F.struct(F.lit("summary").alias("type"), text("s", own).alias("sessionId"), F.lit("/home/u").alias("cwd")))
    meta = F.to_json(F.struct(F.lit("2024-03-05T09:00:00Z").alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(text("s", own).alias("id"), F.lit("/home/u").alias("cwd")).alias("payload")))
    project = F.to_json(F.struct(text("Project ", own).alias("name"), text("u", own).alias("uuid"), F.concat(F.lit("Turns: "), "n").alias("prompt_template"), F.lit("").alias("description"), F.lit("2024-03-05T08:00:00Z").alias("created_at")))
    content = F.when(k < 2, F.array_join(F.concat(F.array(F.when(k == 0, title).otherwise(meta), F.lit("no json")), listed), "\n")).when(k == 2, project).when(k < 5, F.array_join(listed, "\n"))
    content = content.when(k == 5, text('{"entries": [', F.array_join(listed, ", "), ",]}"))
    content = content.when(k == 6, text('[{"uuid": "uuid-', own, '", "name": "Talk ', own, '", "summary": "", "created_at": "2024-03-05T10:00:00Z", "chat_messages": [', F.array_join(listed, ", "), "]}]"))
    nodes = F.array_join(F.transform("x", lambda r: F.concat(F.lit('"'), r["turn"].cast("string"), F.lit('": '), r["l"])), ", ")
    content = content.otherwise(text('[{"title": "Talk ', own, '", "conversation_id": "gpt-', own, '", "create_time": 1709632800.5, "mapping": {', nodes, "}}]"))
    suffix = F.when(k.isin(0, 1, 3, 4), ".jsonl").otherwise(".json")
    files = files.select(F.concat(F.lit("f"), "conv_id", suffix).alias("file_id"), suffix.alias("suffix"), content.alias("content"))
    return exports.parsed(files).select("doc_id", "source_type", "title", "date", "content", "session_id", F.col("typed").cast("long").alias("typed"))


@query(
    "vec_store_added",
    """WITH k AS (SELECT unnest(['chunk', 'fact', 'entity', 'pattern']) AS kind), r AS (SELECT CASE label % 3 WHEN 0 THEN 'chunk' WHEN 1 THEN 'fact' ELSE 'entity' END AS kind FROM embeddings)
    SELECT kind, (SELECT count(*) FROM r WHERE r.kind = k.kind) AS n FROM k""",
)
def vec_store_added(spark, d):
    rows = table(spark, d, "embeddings").withColumn("kind", F.element_at(F.array(*map(F.lit, ("chunk", "fact", "entity"))), F.col("label") % 3 + 1)).withColumn("record_id", F.col("vec_id").cast("string"))
    both = store.aligned(rows.select("kind", "record_id"), rows.select("kind", "record_id", "embedding"), 64)
    return store.counts_by_kind(both, ("chunk", "fact", "entity", "pattern"))


@query(
    "vec_first_edge_labels",
    """SELECT 'order' AS src_kind, CAST(l_orderkey AS VARCHAR) AS src_id, 'supplier' AS dst_kind, CAST(l_suppkey AS VARCHAR) AS dst_id, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS edge_kind FROM lineitem GROUP BY l_orderkey, l_suppkey""",
)
def vec_first_edge_labels(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("order").alias("src_kind"), F.col("l_orderkey").cast("string").alias("src_id"), F.lit("supplier").alias("dst_kind"), F.col("l_suppkey").cast("string").alias("dst_id"), F.col("l_returnflag").alias("edge_kind"), F.struct("l_linenumber", "l_returnflag").alias("nth"))
    return store.first_labels(rows, "nth")


@query(
    "vec_embedded_texts",
    """WITH t AS (SELECT DISTINCT text FROM conversations)
    SELECT sha256(text) AS id, [('0x' || substr(sha256(text), 1, 2))::INT / 255.0::DOUBLE, ('0x' || substr(sha256(text), 3, 2))::INT / 255.0::DOUBLE] AS v FROM t""",
)
def vec_embedded_texts(spark, d):
    def flaky(texts: list[str]) -> list[list[float]]:
        if len(texts) > 1 and any("a" in t for t in texts):
            raise ConnectionError("a request of several texts")
        return batches.stub_vectors(texts)

    rows = batches.embedded(table(spark, d, "conversations"), "text", flaky)
    return rows.select(F.sha2("text", 256).alias("id"), F.slice("embedding", 1, 2).alias("v"))


@query(
    "spl_batch_documents",
    """WITH t AS (SELECT conv_id, turn, 't' || conv_id || '_' || turn AS id, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS title, '2024-01-0' || (1 + turn % 5) AS date, text FROM conversations),
    s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN '' ELSE chr(10) || chr(10) || '--- ENTRY: ' || date || ' | ' || CASE WHEN title = '' THEN id ELSE title END || ' [' || id || '] ---' || chr(10) || chr(10) END AS sep FROM t),
    o AS (SELECT *, CAST(sum(length(sep) + length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS stop FROM s)
    SELECT conv_id, string_agg(sep || text, '' ORDER BY turn) AS content, string_agg(id || ':' || (stop - length(text)) || '-' || stop, ' ' ORDER BY turn) AS entries,
      CASE WHEN min(date) = max(date) THEN min(date) ELSE min(date) || '..' || max(date) END AS date,
      CASE WHEN count(DISTINCT nullif(title, '')) = 1 THEN max(title) WHEN count(DISTINCT nullif(title, '')) > 1 THEN arg_min(title, turn) FILTER (title <> '') || ' → ' || arg_max(title, turn) FILTER (title <> '') || ' (' || count(*) || ' entries)' ELSE '' END AS title
    FROM o GROUP BY conv_id""",
)
def spl_batch_documents(spark, d):
    doc_id = F.concat(F.lit("t"), "conv_id", F.lit("_"), "turn")
    title = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", doc_id.alias("doc_id"), title.alias("title"), F.concat(F.lit("2024-01-0"), (1 + F.col("turn") % 5).cast("string")).alias("date"), F.col("text").alias("content"))
    made = batches.batch_documents(rows, ["conv_id"], ["turn"])
    spans = F.array_join(F.transform("entries", lambda e: F.concat(e["id"], F.lit(":"), e["begin"].cast("string"), F.lit("-"), e["end"].cast("string"))), " ")
    return made.select("conv_id", "content", spans.alias("entries"), "date", "title")


@query(
    "spl_halved_batches",
    """WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS x FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN len(x) < 2 THEN [x] ELSE [x[1:len(x) // 2], x[len(x) // 2 + 1:len(x)]] END AS halves FROM l""",
)
def spl_halved_batches(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("x"))
    return rows.select("l_orderkey", batches.halved_batch(F.col("x")).alias("halves"))


@query(
    "syn_detailed_patterns",
    """WITH p AS (SELECT event_type AS topic, user_id AS name, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY c DESC, name) AS rn, count(*) OVER (PARTITION BY topic) AS n FROM p)
    SELECT topic, name, c FROM r WHERE greatest(4, n // 2) < n AND rn <= greatest(4, n // 2)""",
)
def syn_detailed_patterns(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("topic"), F.col("user_id").alias("name")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("topic")
    rows = rows.withColumns({"_rn": F.row_number().over(w.orderBy(F.desc("c"), "name")), "_n": F.count("*").over(w)})
    return batches.detailed(rows, F.col("_rn"), F.col("_n")).select("topic", "name", "c")


@query(
    "exp_entity_mentions",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_linestatus) AS rn FROM lineitem),
    l AS (SELECT l_orderkey, list('p' || l_partkey ORDER BY rn) AS x FROM n GROUP BY 1)
    SELECT n.l_orderkey AS fact_id, 'p' || l_partkey AS name, l_linestatus AS role, array_to_string(list_concat(x[1:rn - 1], x[rn + 1:len(x)]), ',') AS co_entities FROM n JOIN l USING (l_orderkey)""",
)
def exp_entity_mentions(spark, d):
    e = F.struct("l_linenumber", "l_partkey", F.col("l_linestatus").alias("role"), F.concat(F.lit("p"), "l_partkey").alias("name"), F.lit("part").alias("type"))
    facts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fact_id")).agg(F.array_sort(F.collect_list(e)).alias("entities"))
    facts = facts.withColumns({"topics": F.array(F.lit("work")), "summary": F.lit("an order"), "confidence": F.lit(1.0)})
    return batches.mentions(facts).select("fact_id", "name", "role", F.array_join("co_entities", ",").alias("co_entities"))


@query(
    "fact_unfenced",
    """SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN '{"n": ' || n_chars || ', ' ELSE '{"n": ' || n_chars || '}' END AS payload FROM documents""",
)
def fact_unfenced(spark, d):
    """Payloads bare, fenced, cut off within a fence, and fenced twice, of which the last counts."""
    json = F.concat(F.lit('{"n": '), F.col("n_chars").cast("string"), F.lit("}"))
    k = F.col("doc_id") % 4
    fenced = F.concat(F.lit("  ```json\n"), json, F.lit("\n```"))
    raw = F.when(k == 0, F.concat(F.lit(" "), json, F.lit("\n"))).when(k == 1, fenced).when(k == 2, F.concat(F.lit('```json\n{"n": '), F.col("n_chars").cast("string"), F.lit(", ")))
    raw = raw.otherwise(F.concat(F.lit('```\n{"draft": 1}\n```\nOnce more:\n'), fenced))
    out = display.without_fences(raw)
    return table(spark, d, "documents").select("doc_id", F.when(k == 2, F.concat(out, F.lit(" "))).otherwise(out).alias("payload"))


@query(
    "src_described_images",
    "SELECT page_id, 'A page of ' || length(html) || ' characters' AS description FROM pages WHERE page_id % 5 <> 4",
)
def src_described_images(spark, d):
    """Descriptions with one to three layers of preamble; images whose description failed are dropped."""
    said = F.concat(F.lit("A page of "), F.length("html").cast("string"), F.lit(" characters"))
    k = F.col("page_id") % 5
    raw = F.when(k == 0, said).when(k == 1, F.concat(F.lit("Sure, here it is.\n"), said)).when(k == 2, F.concat(F.lit("Okay! Got it.\n\nThis image shows text.\n"), said))
    raw = raw.when(k == 3, F.concat(F.lit("  I'll transcribe this page.\n"), said, F.lit("\n")))
    rows = table(spark, d, "pages").select("page_id", display.without_preamble(raw).alias("description"))
    return rows.filter("description IS NOT NULL")


_FACTS = """d AS (SELECT doc_id, 'topic' || (doc_id % 20) AS topic, lang, translate(text, '<>"\\`', '') AS text FROM documents WHERE length(text) >= 40 AND lang IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id) - 1 AS idx, lang || '-' || row_number() OVER (PARTITION BY topic, lang ORDER BY doc_id) AS anchor,
      replace(substr(text, 1, 30), chr(10), ' ') AS summary, regexp_replace(replace(substr(text, 11, 20), chr(10), ' '), '^\s+|\s+$', '', 'g') AS quote FROM d)"""


def _vault(spark, d):
    """Documents as facts under twenty topics, one pattern a topic over its first facts, one insight over all patterns and one action."""
    docs = table(spark, d, "documents").filter("length(text) >= 40 AND lang IS NOT NULL")
    docs = docs.select("doc_id", F.concat(F.lit("topic"), (F.col("doc_id") % 20).cast("string")).alias("topic"), (F.col("doc_id") % 20).cast("int").alias("topic_no"), F.col("lang").alias("type"), F.translate("text", '<>"\\`', "").alias("text"))
    own = F.concat(F.lit("doc"), "doc_id")
    excerpt = F.struct(F.substring("text", 11, 20).alias("text"), own.alias("file_path"), F.lit(10).cast("long").alias("file_offset"), F.lit(20).cast("long").alias("file_length"), F.lit(False).alias("approximate"))
    none = F.lit(None)
    facts = docs.withColumn("idx", (F.row_number().over(Window.partitionBy("topic").orderBy("doc_id")) - 1).cast("long")).select(
        "topic", "topic_no", "idx", "type", F.replace(F.substring("text", 1, 30), F.lit("\n"), F.lit(" ")).alias("summary"), none.cast("string").alias("occurred_at"), (F.col("doc_id") % 100 / 100).alias("confidence"),
        F.array().cast("array<struct<name:string,type:string,role:string>>").alias("entities"), F.array("topic").alias("topics"), F.array().cast("array<string>").alias("tags"), F.array(excerpt).alias("evidence"),
    )
    first = F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(c).alias("conf")) for i, c in enumerate((0.9, 0.8, 0.7))])
    patterns = facts.groupBy("topic").agg(F.count("*").alias("n")).filter("n >= 3").select(
        "topic", F.lit(0).cast("long").alias("idx"), F.concat(F.lit("Habit of "), "topic").alias("name"), F.lit("habit").alias("kind"), F.lit(3).cast("long").alias("count"), none.cast("string").alias("domain"),
        F.lit("What the first three say.").alias("description"), first.alias("source_facts"), F.lit(0).cast("long").alias("hallucinated"),
    )
    run = vault.Run(facts, patterns, *[spark.createDataFrame([], schema) for schema in (
        "scope string, idx long, name string, domains array<string>, description string, mechanism string, implication string, proposed_actions array<string>, source_patterns array<struct<topic:string,idx:long,conf:double>>, hallucinated long",
        "idx long, recommendation string, kind string, objective string, why string, immediate_action string, habit string, success_metric string, horizon string, review_date string, regret_reduction double, leverage double, consequence double, generativity double, decisiveness double, time_to_feedback double, constraint_fit double, confidence double, score double, source_insights array<struct<scope:string,idx:long,conf:double>>, hallucinated long",
        "canonical_id string, canonical_name string, entity_type string, role string, description string, aliases array<string>, refs array<struct<topic:string,idx:long>>",
        "from_id string, to_id string, relation string, confidence double", "position int, name string, value long",
    )], docs.select(own.alias("file_id"), "text"))
    return run


@query(
    "exp_vault_pages",
    f"""WITH {_FACTS}, c AS (SELECT *, CASE WHEN idx < 3 AND count(*) OVER (PARTITION BY topic) >= 3 THEN '0.' || (9 - idx) || '0' END AS conf FROM f),
    s AS (SELECT topic, idx, '## [' || anchor || '] ' || summary || chr(10) || '*undated · ' || lang || ' · confidence ' || printf('%.2f', (doc_id % 100) / 100.0::DOUBLE) || '* ^' || anchor || chr(10) || chr(10) || '**Topics:** `' || topic || '`' || chr(10) || chr(10) || '**Source:**'
      || chr(10) || '- [[0-inputs/doc' || doc_id || '#^offset-10|doc' || doc_id || ' @ 10:20]]' || chr(10) || '  > ' || quote || CASE WHEN conf IS NULL THEN '' ELSE chr(10) || chr(10) || '**Cited by (patterns):**' || chr(10) || '- [[3-patterns/' || topic || '#^habit-1|patterns/' || topic || '/habit-1]] · confidence ' || conf END AS body,
      '- **' || (90 - 10 * idx) || '% match**  [[1-facts/' || topic || '#^' || anchor || '|T' || substr(topic, 2) || ' ' || upper(substr(lang, 1, 1)) || substr(lang, 2) || ' ' || split_part(anchor, '-', 2) || ']]' || CASE WHEN summary = '' THEN '' ELSE ': *"' || regexp_replace(summary, '^\s+|\s+$', '', 'g') || '"*' END
        || chr(10) || '  - **' || (90 - 10 * idx) || '% match**  [[0-inputs/doc' || doc_id || '#^offset-10|doc' || doc_id || ' @ 10:20]]' || CASE WHEN quote = '' THEN '' ELSE ': *"' || quote || '"*' END AS walk, conf FROM c),
    p AS (SELECT '1-facts/' || topic || '.md' AS path, '---' || chr(10) || 'topic: ' || topic || chr(10) || 'layer: facts' || chr(10) || 'count: ' || count(*) || chr(10) || '---' || chr(10) || chr(10) || '# T' || substr(topic, 2) || ' — facts' || chr(10) || chr(10)
        || string_agg(body || chr(10) || chr(10), chr(10) ORDER BY idx) AS page FROM s GROUP BY topic
      UNION ALL SELECT '3-patterns/' || topic || '.md', '---' || chr(10) || 'topic: ' || topic || chr(10) || 'layer: patterns' || chr(10) || 'count: 1' || chr(10) || '---' || chr(10) || chr(10) || '# T' || substr(topic, 2) || ' — patterns' || chr(10) || chr(10)
        || '## [habit-1] Habit of ' || topic || chr(10) || '*habit · count 3 · domain ' || topic || '* ^habit-1' || chr(10) || chr(10) || 'What the first three say.' || chr(10) || chr(10) || '**Provenance:**' || chr(10) || string_agg(walk, chr(10) ORDER BY idx) || chr(10) || chr(10) FROM s WHERE conf IS NOT NULL GROUP BY topic)
    SELECT path, sha256(page) AS sha, CAST(length(page) AS BIGINT) AS n_chars FROM p""",
)
def exp_vault_pages(spark, d):
    """The pages of facts and patterns as they are on disk after the export."""
    where = f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}"
    run = _vault(spark, d)
    facts, patterns = vault.anchored(run)
    pages.write_pages(vault.facts_pages(run, facts, patterns).unionByName(vault.patterns_pages(run, patterns, run.insights, vault.fact_trees(run, facts, patterns))), where)
    read = spark.read.option("recursiveFileLookup", True).text(where, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.col("value").alias("page"))
    return read.select(F.regexp_extract("f", "([0-9]-[a-z]+/[^/]+)$", 1).alias("path"), F.sha2("page", 256).alias("sha"), F.length("page").cast("long").alias("n_chars"))


@query(
    "exp_anchored_inputs",
    f"""WITH {_FACTS}, m AS (SELECT *, 30 + length(regexp_extract(substr(text, 31), '^[.!?,;:"''\)\]}}]*')) AS mark, CASE WHEN strpos(substr(text, 31), chr(10)) > 0 THEN 29 + strpos(substr(text, 31), chr(10)) ELSE length(text) END AS stop FROM f),
    w AS (SELECT *, CASE WHEN strpos(reverse(substr(text, 1, CAST(stop AS BIGINT))), chr(10)) > 0 THEN stop - strpos(reverse(substr(text, 1, CAST(stop AS BIGINT))), chr(10)) + 1 ELSE 0 END AS start FROM m),
    b AS (SELECT *, start >= 2 AND substr(text, start - 1, 1) <> chr(10) AS above, stop + 1 < length(text) AND substr(text, stop + 2, 1) <> chr(10) AS below, ' [[1-facts/' || topic || '#^' || anchor || '|[' || topic || '/' || anchor || ']]]' AS marker FROM w),
    o AS (SELECT doc_id, substr(text, 1, start) || CASE WHEN start = mark THEN marker || CASE WHEN above THEN chr(10) ELSE '' END ELSE CASE WHEN above THEN chr(10) ELSE '' END || substr(text, start + 1, mark - start) || marker END
      || substr(text, mark + 1, stop - mark) || ' ^offset-10' || substr(text, stop + 1, 1) || CASE WHEN below THEN chr(10) ELSE '' END || substr(text, stop + 2) AS body FROM b)
    SELECT 'doc' || doc_id AS file_id, '---' || chr(10) || 'layer: input' || chr(10) || 'file_id: doc' || doc_id || chr(10) || 'cited_facts: 1' || chr(10) || '---' || chr(10) || chr(10) || '# doc' || doc_id || chr(10) || body AS page FROM o""",
)
def exp_anchored_inputs(spark, d):
    """Every document with the marker of its excerpt and an anchor at the end of that line."""
    run = _vault(spark, d)
    facts, _ = vault.anchored(run)
    made = vault.input_pages(run, facts)
    return made.select(F.regexp_extract("path", "/(.*)[.]md$", 1).alias("file_id"), F.col("text").alias("page"))
