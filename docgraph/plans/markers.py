"""Queries over markers, call summaries, display texts and provenance lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import display, markers
from .registry import query, table

KIND = "CASE WHEN event_id % 7 = 0 THEN 'begin' WHEN event_id % 7 < 5 THEN 'stream_progress' ELSE 'end' END"


def _calls(spark, d):
    """Events as calls: id, stage, tokens and time."""
    e = table(spark, d, "events")
    tokens = F.floor(F.col("value")).cast("long")
    return e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("stage"), tokens.alias("prompt_tokens"), F.when(F.col("event_id") % 3 == 0, None).otherwise(tokens + 1).alias("completion_tokens"), (F.col("value") * 1000).alias("duration_ms"), "user_id", "ts")


@query(
    "tel_calls_block",
    """SELECT event_type AS stage, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN floor(value) + 1 END), 0) AS BIGINT) AS completion_tokens, sum(value * 1000) AS wall_ms,
      CAST(sum(floor(value)) + coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN floor(value) + 1 END), 0) AS BIGINT) AS total_tokens FROM events WHERE event_id > 100 GROUP BY 1""",
)
def tel_calls_block(spark, d):
    return markers.calls_block(_calls(spark, d), 100, ["stage"])


@query(
    "tel_report",
    """WITH s AS (SELECT event_type AS stage, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens, CAST(floor(sum(floor(value) * 1000)) AS BIGINT) AS ms FROM events GROUP BY 1)
    SELECT stage, rpad(stage, 16, ' ') || '  calls ' || format('{:,}', calls) || '  tokens ' || format('{:,}', tokens) || '  time ' ||
      CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN format('{:.1f}s', ms / 1000) WHEN ms < 3600000 THEN (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' ELSE (ms // 3600000) || 'h ' || (ms // 1000 % 3600 // 60) || 'm ' || (ms // 1000 % 60) || 's' END AS line FROM s""",
)
def tel_report(spark, d):
    tokens = F.floor("value").cast("long")
    stats = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("total_tokens"), F.sum(tokens * 1000).alias("wall_ms"))
    return markers.report(stats, "stage")


@query(
    "tel_payload_join",
    """SELECT e.event_id AS call_id, p.props AS full_prompt, p.event_type AS full_response FROM events e LEFT JOIN (SELECT event_id, props, event_type FROM events WHERE event_id % 4 = 1) p ON p.event_id = e.event_id""",
)
def tel_payload_join(spark, d):
    e = table(spark, d, "events")
    side = e.filter("event_id % 4 = 1").select(F.col("event_id").alias("call_id"), F.col("props").alias("full_prompt"), F.col("event_type").alias("full_response"), F.lit(1).alias("pos"))
    older = side.withColumns({"full_prompt": F.lit("older"), "pos": F.lit(0)})  # the side file is appended to; the latest counts
    return markers.with_payloads(e.select(F.col("event_id").alias("call_id")), side.unionByName(older))


def _log(spark, d):
    k = F.col("event_id") % 7
    kind = F.when(k == 0, "begin").when(k < 5, "stream_progress").otherwise("end")
    return table(spark, d, "events").select(F.floor(F.col("event_id") / 7).cast("long").alias("call_id"), kind.alias("event"), F.floor("value").cast("long").alias("tokens"), (F.col("value") * 10).alias("ttft_ms"), F.col("event_type").alias("stage"), "user_id", "event_id")


@query(
    "tel_live_counts",
    f"""WITH e AS (SELECT event_id // 7 AS call_id, {KIND} AS event, CAST(floor(value) AS BIGINT) AS tokens, value * 10 AS ttft FROM events WHERE event_id % 7 < 5 OR event_id % 2 = 0)
    SELECT call_id, coalesce(max(tokens) FILTER (event = 'end'), max(tokens) FILTER (event = 'stream_progress'), 0) AS tokens, CASE WHEN count(*) FILTER (event = 'end') > 0 THEN 'ended' ELSE 'running' END AS state, min(ttft) FILTER (event = 'stream_progress') AS ttft_ms
    FROM e GROUP BY 1 HAVING count(*) FILTER (event = 'begin') > 0""",
)
def tel_live_counts(spark, d):
    return markers.live_counts(_log(spark, d).filter("event <> 'end' OR event_id % 2 = 0"))


@query(
    "tel_tracker",
    f"""WITH e AS (SELECT event_type AS stage, {KIND} AS event, event_id % 3 <> 0 AS success FROM events), c AS (SELECT stage, count(*) FILTER (event = 'begin') AS b, count(*) FILTER (event = 'end' AND success) AS g, count(*) FILTER (event = 'end' AND NOT success) AS f FROM e GROUP BY 1)
    SELECT stage, greatest(50, b) AS expected, b AS begun, g AS completed, f AS failed, b - g - f AS running FROM c""",
)
def tel_tracker(spark, d):
    rows = _log(spark, d).withColumns({"success": F.col("event_id") % 3 != 0, "estimate": F.lit(50)})
    return markers.tracker(rows, "stage")


@query(
    "tel_replayed_eta",
    """SELECT event_id AS call_id, count(*) OVER u - count(*) OVER w AS calls_left, avg(value) OVER w * (count(*) OVER u - count(*) OVER w) AS predicted, round(sum(value) OVER u - sum(value) OVER w, 6) + 0.0 AS actual FROM events
    WINDOW u AS (PARTITION BY user_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def tel_replayed_eta(spark, d):
    rows = markers.replayed(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rows.select(F.col("event_id").alias("call_id"), "calls_left", "predicted", (F.round("actual", 6) + 0.0).alias("actual"))


@query(
    "tel_cycles",
    "SELECT user_id, greatest(1, count(*) FILTER (event_type = 'login')) AS cycles FROM events GROUP BY 1",
)
def tel_cycles(spark, d):
    kind = F.when(F.col("event_type") == "login", "cycle_start").otherwise(F.col("event_type"))
    return markers.cycles(table(spark, d, "events").select("user_id", kind.alias("event")), "user_id")


@query(
    "tel_resume_point",
    """WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderstatus = 'F' AS done FROM orders),
    g AS (SELECT *, min(CASE WHEN NOT done THEN pos END) OVER (PARTITION BY o_custkey) AS gap FROM s)
    SELECT o_custkey, max(CASE WHEN gap IS NULL OR pos < gap THEN pos END) AS resume_after FROM g GROUP BY 1""",
)
def tel_resume_point(spark, d):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select("o_custkey", nth.alias("pos"), (F.col("o_orderstatus") == "F").alias("done"))
    return markers.resume_point(rows, "o_custkey", "pos", "done")


@query(
    "tel_content_free",
    """SELECT count(*) AS markers, count(*) FILTER (event_type NOT IN ('click', 'view')) AS with_other_words, count(*) FILTER (event_id >= 1000) AS with_call_ids FROM events""",
)
def tel_content_free(spark, d):
    e = table(spark, d, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = e.select(stamp.alias("ts"), F.struct(F.col("event_type").alias("stage"), F.lpad(F.col("event_id").cast("string"), 4, "0").alias("call_id")).alias("call"), F.array("event_type").alias("seen"), "event_id", "event_type")
    schema = rows.select("ts", "call", "seen").schema
    free = markers.free_leaves(schema, ["click", "view"])
    other = markers.free_leaves(T.StructType([schema["ts"]]), [])
    return rows.agg(F.count_if((other == 0) & (free <= 2)).alias("markers"), F.count_if(free == 2).alias("with_other_words"), F.count_if(F.col("event_id") >= 1000).alias("with_call_ids"))


@query(
    "tel_stage_models",
    """SELECT * FROM (VALUES ('extract', 'small'), ('entities', 'common'), ('entities_dedupe', 'common'), ('patterns', 'large'), ('insights', 'common'), ('actions', 'common')) v(stage, model)""",
)
def tel_stage_models(spark, d):
    config = spark.createDataFrame([("extract", "small"), ("patterns", "large"), ("*", "common")], "stage string, model string")
    return markers.stage_models(config, "standard")


@query(
    "tel_round_robin",
    """SELECT event_id AS call_id, ['a', 'b', 'c'][CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 3 AS INT) + 1] AS model FROM events""",
)
def tel_round_robin(spark, d):
    return markers.round_robin(table(spark, d, "events"), ["event_type"], ["event_id"], ["a", "b", "c"]).select(F.col("event_id").alias("call_id"), "model")


@query(
    "src_ingestion_guard",
    """WITH t AS (SELECT source, bool_or(length(trim(text)) > 0) AS has FROM documents GROUP BY 1), c AS (SELECT d.source, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE d.source <> (SELECT min(source) FROM documents) GROUP BY 1)
    SELECT t.source, coalesce(n, 0) AS chunks, has AND coalesce(n, 0) = 0 AS again FROM t LEFT JOIN c ON c.source = t.source""",
)
def src_ingestion_guard(spark, d):
    docs = table(spark, d, "documents")
    least = docs.agg(F.min("source").alias("m")).scalar()
    chunks = docs.join(table(spark, d, "labels"), "doc_id").withColumn("_m", least).filter("source <> _m")
    return markers.needs_embedding(docs.select("source", "text"), chunks, "source")


@query(
    "chat_store_binding",
    "SELECT arg_max('run_' || c_custkey, (n_, c_custkey)) AS path FROM (SELECT c_custkey, c_nationkey AS n_, c_acctbal FROM customer) WHERE c_acctbal > 0",
)
def chat_store_binding(spark, d):
    runs = table(spark, d, "customer").select(F.struct("c_nationkey", "c_custkey").alias("created"), F.concat(F.lit("run_"), "c_custkey").alias("path"), F.greatest(F.lit(0), F.ceil("c_acctbal")).alias("records"))
    return markers.newest_store(runs, "created", "path", "records")


@query(
    "chat_turn_caps",
    "SELECT event_id, CASE WHEN event_type = 'click' THEN 10 ELSE 15 END AS k, CASE WHEN event_type = 'click' THEN 15 ELSE 20 END AS most, CASE WHEN event_type = 'click' THEN 2 ELSE 3 END AS lookups, CASE WHEN event_type = 'click' THEN 120 ELSE 240 END AS accumulated FROM events",
)
def chat_turn_caps(spark, d):
    mode = F.when(F.col("event_type") == "click", "local").otherwise("cloud")
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in markers.turn_caps(mode).items()])


@query(
    "chat_lookup_diagnostics",
    """SELECT vec_id AS lookup, length('find ' || label) AS query_chars, 2 AS kinds, len(embedding) AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings""",
)
def chat_lookup_diagnostics(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("lookup"), F.concat(F.lit("find "), "label").alias("query"), F.array(F.lit("fact"), F.lit("chunk")).alias("kinds"), "embedding")
    return markers.lookup_diagnostics(rows)


@query(
    "graph_record_displays",
    """SELECT 'order' || o_orderkey AS id, trim(o_orderpriority) || chr(10) || 'date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'topics: ' || o_orderstatus || ', work' AS display FROM orders
    UNION ALL SELECT 'part' || p_partkey, trim(p_name) || chr(10) || p_type || ' · ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'aliases: ' || p_brand || ', ' || p_size ELSE '' END FROM part
    UNION ALL SELECT 'nation' || n_nationkey, n_name || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'kind · ' ELSE '' END || 'region ' || n_regionkey || chr(10) || 'Held by ' || n_nationkey FROM nation
    UNION ALL SELECT 'region' || r_regionkey, 'Source: r.md' || chr(10) || 'Section: world › ' || r_name || chr(10) || chr(10) || 'Text of ' || r_name FROM region""",
)
def graph_record_displays(spark, d):
    facts = table(spark, d, "orders").select(F.concat(F.lit("order"), "o_orderkey").alias("id"), display.fact_text(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.array("o_orderstatus", F.lit("work")), F.array().cast("array<string>")).alias("display"))
    aliases = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", F.col("p_size").cast("string"))).otherwise(F.array().cast("array<string>"))
    entities = table(spark, d, "part").select(F.concat(F.lit("part"), "p_partkey").alias("id"), display.entity_text(F.col("p_name"), F.col("p_type"), F.col("p_brand"), aliases, F.lit("")).alias("display"))
    kind = F.when(F.col("n_nationkey") % 2 == 0, "kind")
    patterns = table(spark, d, "nation").select(F.concat(F.lit("nation"), "n_nationkey").alias("id"), display.pattern_text(F.col("n_name"), kind, F.concat(F.lit("region "), "n_regionkey"), F.concat(F.lit("Held by "), "n_nationkey")).alias("display"))
    chunks = table(spark, d, "region").select(F.concat(F.lit("region"), "r_regionkey").alias("id"), display.chunk_text(F.lit("r.md"), F.array(F.lit("world"), "r_name"), F.concat(F.lit("Text of "), "r_name")).alias("display"))
    return facts.unionByName(entities).unionByName(patterns).unionByName(chunks)


@query(
    "graph_document_displays",
    """WITH s AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY i) AS rn FROM (SELECT source, substr(text, 1, 1) AS text, min(doc_id) AS i FROM documents WHERE trim(substr(text, 1, 1)) <> '' GROUP BY 1, 2))
    SELECT 'File: ' || d.source || chr(10) || 'Date: 2024-01-01' || chr(10) || count(*) || CASE WHEN count(*) = 1 THEN ' chunk' ELSE ' chunks' END || coalesce(chr(10) || chr(10) || 'Summary:' || chr(10) || (SELECT string_agg('- ' || text, chr(10) ORDER BY rn) FROM s WHERE s.source = d.source), '') AS display FROM documents d WHERE d.source IS NOT NULL GROUP BY d.source""",
)
def graph_document_displays(spark, d):
    """Summaries of splits in first-seen order, each once, under their file."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL").withColumn("s", F.substring("text", 1, 1))
    seen = docs.filter(F.trim("s") != "").groupBy("source", "s").agg(F.min("doc_id").alias("i"))
    summaries = seen.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("summaries"))
    rows = docs.groupBy("source").agg(F.count("*").alias("n")).join(summaries, "source", "left")
    none = F.array().cast("array<string>")
    return rows.select(display.document_text(F.col("source"), F.lit("2024-01-01"), F.lit(None).cast("string"), F.col("n"), none, F.coalesce("summaries", none)).alias("display"))


@query(
    "exp_graph_lines",
    """SELECT l_orderkey, l_linenumber, repeat('  ', l_linenumber) || '- **' || CAST(l_quantity AS INT) || '% match**  ' || CASE WHEN l_returnflag = 'R' THEN '≈ ' ELSE '' END || '[[p' || l_partkey || ']]' || CASE WHEN l_linestatus = 'O' THEN ': *"line ' || l_linenumber || ' of it"*' ELSE '' END AS line,
      '  - *↳ ' || l_linenumber || CASE WHEN l_linenumber = 1 THEN ' fact' ELSE ' facts' END || ' below the privacy cut (not exported)*' AS boundary FROM lineitem""",
)
def exp_graph_lines(spark, d):
    c = F.col
    quote = F.when(c("l_linestatus") == "O", F.concat(F.lit("line "), "l_linenumber", F.lit("\nof it")))
    line = display.graph_line(c("l_linenumber"), F.concat(F.lit("[[p"), "l_partkey", F.lit("]]")), c("l_quantity").cast("int").cast("string"), quote, c("l_returnflag") == "R")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"), display.boundary_line(F.lit(1), c("l_linenumber"), "fact").alias("boundary"))


@query(
    "exp_pretty_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%b ') || day(o_orderdate) || CASE WHEN year(o_orderdate) = 1995 THEN '' ELSE ', ' || year(o_orderdate) END AS shown FROM orders""",
)
def exp_pretty_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", display.pretty_date(F.col("o_orderdate"), F.lit("1995-06-01").cast("date")).alias("shown"))


@query(
    "exp_run_list",
    """WITH r AS (SELECT 'run' || c_custkey AS name, c_nationkey AS created, c_acctbal > 0 AS ins FROM customer), t AS (SELECT *, row_number() OVER (ORDER BY created DESC, name DESC) AS rn, count(*) OVER () AS n FROM r)
    SELECT '# Runs' || chr(10) || chr(10) || 'Total runs: ' || max(n) || chr(10) || chr(10) || '## Most recent' || chr(10) || chr(10) || string_agg('- [[' || name || CASE WHEN ins THEN '/4-insights' ELSE '' END || '|' || name || ']]', chr(10) ORDER BY rn) || CASE WHEN max(n) > 20 THEN chr(10) || chr(10) || '*(+' || (max(n) - 20) || ' older runs)*' ELSE '' END || chr(10) AS readme FROM t WHERE rn <= 20""",
)
def exp_run_list(spark, d):
    runs = table(spark, d, "customer").select(F.concat(F.lit("run"), "c_custkey").alias("name"), F.col("c_nationkey").alias("created"), (F.col("c_acctbal") > 0).alias("ins"))
    return display.run_list(runs, "name", "created", "ins")


@query(
    "find_in_documents",
    """WITH RECURSIVE p AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS nth, CAST(strpos(text, 'the') AS BIGINT) AS k FROM documents WHERE strpos(text, 'the') > 0
      UNION ALL SELECT doc_id, text, nth + 1, k + 2 + strpos(substr(text, k + 3), 'the') FROM p WHERE strpos(substr(text, k + 3), 'the') > 0)
    SELECT doc_id, nth, k - 1 AS "begin" FROM p""",
)
def find_in_documents(spark, d):
    return display.found_in(table(spark, d, "documents"), "doc_id", "text", "the", most=1 << 30)


@query(
    "prov_sources_by_composite",
    """SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round((1 - l_discount) * coalesce(p_size / 50.0, 1), 9) DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 3 > 0) ON p_partkey = l_partkey""",
)
def prov_sources_by_composite(spark, d):
    """Source facts by edge confidence times extraction confidence, which is 1 where a fact has none."""
    known = table(spark, d, "part").filter("p_size % 3 > 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") / 50.0).alias("ext"))
    rows = table(spark, d, "lineitem").join(known, "l_partkey", "left")
    score = F.round((1 - F.col("l_discount")) * F.coalesce("ext", F.lit(1.0)), 9)
    return rows.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(score), "l_linenumber", "l_partkey", "l_suppkey")).alias("place"))


@query(
    "ent_likelihoods",
    """WITH i AS (SELECT c_custkey, c_nationkey, max(o_totalprice / 1000000) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_nationkey AS merged_id, max(l) AS likelihood, count(*) AS ids FROM i GROUP BY 1""",
)
def ent_likelihoods(spark, d):
    """The largest likelihood of each id, and then of each id that it was merged into."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_totalprice") / 1000000).alias("l"))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left")
    return rows.groupBy(F.col("c_nationkey").alias("merged_id")).agg(F.max("l").alias("likelihood"), F.count("*").alias("ids"))


@query(
    "ent_materialized",
    """SELECT s_suppkey AS entity_id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN NULL ELSE n_name END AS subject, CASE WHEN s_nationkey % 2 = 0 AND s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN 'subject' ELSE 'other' END AS role, coalesce(n_name, '') AS description
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
)
def ent_materialized(spark, d):
    """Groups with their annotations as records; a bundle of several files has no subject, and no one has that role in it."""
    bundle = F.col("s_nationkey") % 2 == 0
    role = F.when(F.col("s_suppkey") % 3 == 0, "subject").otherwise("other")
    rows = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.when(~bundle, F.col("n_name")).alias("subject"), F.when(bundle & (role == "subject"), "").otherwise(role).alias("role"), F.coalesce("n_name", F.lit("")).alias("description"))


@query(
    "cite_confidence",
    "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.4 END, 1.0) AS confidence FROM lineitem LEFT JOIN labels ON doc_id = l_partkey",
)
def cite_confidence(spark, d):
    conf = table(spark, d, "labels").select(F.col("doc_id").alias("l_partkey"), F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4).alias("c"))
    return table(spark, d, "lineitem").join(conf, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("c", F.lit(1.0)).alias("confidence"))


@query("src_image_payloads", "SELECT page_id, 'data:image/png;base64,' || base64(encode(url)) AS payload FROM pages")
def src_image_payloads(spark, d):
    """Bytes as a data address."""
    return table(spark, d, "pages").select("page_id", S.data_address(F.encode("url", "utf-8"), "image/png").alias("payload"))


@query(
    "find_in_segments",
    """WITH RECURSIVE p AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS nth, CAST(strpos(text, 'e\n') AS BIGINT) AS k FROM documents WHERE strpos(text, 'e\n') > 0
      UNION ALL SELECT doc_id, text, nth + 1, k + 2 + strpos(substr(text, k + 3), 'e\n') FROM p WHERE strpos(substr(text, k + 3), 'e\n') > 0),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS segment, length(text) AS n FROM documents),
    s AS (SELECT doc_id, segment, sum(length(part) + 1) OVER w - length(part) - 1 AS b, least(sum(length(part) + 1) OVER w, n) AS e FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY segment))
    SELECT p.doc_id, nth, k - 1 AS "begin", CAST(x.segment AS INTEGER) AS segment, CAST(y.segment AS INTEGER) AS last_segment FROM p JOIN s x ON x.doc_id = p.doc_id AND k - 1 >= x.b AND k - 1 < x.e JOIN s y ON y.doc_id = p.doc_id AND k + 1 >= y.b AND k + 1 < y.e""".replace("'e\n'", "'.' || chr(10) || 'T'"),
)
def find_in_segments(spark, d):
    """Matches across ends of lines, with the lines of their first and last characters."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    return display.found_in_segments(docs, display.lines_of(docs, "doc_id", "text"), "doc_id", "text", ".\nT", most=1 << 30)
