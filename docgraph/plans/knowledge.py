"""Queries of the whole graph and of passes around it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import synthesis
from ..operators import telemetry as T
from ..operators.split import greedy_pack
from ..sources import jsonl
from .registry import query, table

_VIEW = """fe AS (SELECT DISTINCT l_partkey AS fact, l_suppkey AS entity FROM lineitem), cf AS (SELECT DISTINCT fact // 8 AS chunk, fact FROM fe),
    pf AS (SELECT DISTINCT fact % 9 AS pattern, fact FROM fe), ip AS (SELECT DISTINCT pattern % 4 AS insight, pattern FROM pf), ai AS (SELECT DISTINCT insight % 2 AS action, insight FROM ip),
    sb AS (SELECT fact AS a, lead(fact) OVER (PARTITION BY fact // 8 ORDER BY fact) AS b FROM (SELECT DISTINCT fact FROM fe)), rl AS (SELECT DISTINCT entity AS a, entity + 1 AS b FROM fe),
    inf AS (SELECT DISTINCT insight, fact FROM ip JOIN pf ON ip.pattern = pf.pattern), acf AS (SELECT DISTINCT action, fact FROM ai JOIN inf ON ai.insight = inf.insight),
    two AS (SELECT 'chunk' AS sk, chunk AS s, 'fact' AS dk, fact AS d, 'containment' AS k FROM cf UNION ALL SELECT 'fact', a, 'fact', b, 'sibling' FROM sb WHERE b IS NOT NULL UNION ALL SELECT 'fact', fact, 'entity', entity, 'mention' FROM fe
      UNION ALL SELECT 'pattern', pattern, 'fact', fact, 'derivation' FROM pf UNION ALL SELECT 'entity', a, 'entity', b, 'relation' FROM rl
      UNION ALL SELECT DISTINCT 'entity', entity, 'pattern', pattern, 'mention' FROM pf JOIN fe ON pf.fact = fe.fact UNION ALL SELECT DISTINCT 'entity', entity, 'insight', insight, 'mention' FROM inf JOIN fe ON inf.fact = fe.fact
      UNION ALL SELECT 'insight', insight, 'pattern', pattern, 'derivation' FROM ip UNION ALL SELECT 'action', action, 'insight', insight, 'derivation' FROM ai
      UNION ALL SELECT DISTINCT 'action', action, 'pattern', pattern, 'derivation' FROM ai JOIN ip ON ai.insight = ip.insight),
    e AS (SELECT * FROM two UNION SELECT dk, d, sk, s, k FROM two UNION SELECT DISTINCT 'chunk', chunk, 'entity', entity, 'mention' FROM cf JOIN fe ON cf.fact = fe.fact UNION SELECT DISTINCT 'entity', entity, 'action', action, 'mention' FROM acf JOIN fe ON acf.fact = fe.fact)"""


@query("graph_build_edges", f"WITH {_VIEW} SELECT sk AS src_kind, dk AS dst_kind, k AS edge_kind, count(*) AS edges FROM e GROUP BY 1, 2, 3")
def graph_build_edges(spark, d):
    fe = table(spark, d, "lineitem").select(F.col("l_partkey").alias("fact"), F.col("l_suppkey").alias("entity")).distinct()
    div = lambda c, n: F.floor(F.col(c) / n)
    cf = fe.select(div("fact", 8).alias("chunk"), "fact").distinct()
    pf = fe.select((F.col("fact") % 9).alias("pattern"), "fact").distinct()
    ip = pf.select((F.col("pattern") % 4).alias("insight"), "pattern").distinct()
    ai = ip.select((F.col("insight") % 2).alias("action"), "insight").distinct()
    sb = G.siblings(fe.select("fact").distinct().withColumn("c", div("fact", 8)), ["c"], ["fact"], "fact").filter("next IS NOT NULL").select(F.col("fact").alias("a"), F.col("next").alias("b"))
    rl = fe.select(F.col("entity").alias("a"), (F.col("entity") + 1).alias("b")).distinct()
    return K.build_edges(cf, sb, fe, pf, rl, ip, ai).groupBy("src_kind", "dst_kind", "edge_kind").agg(F.count("*").alias("edges"))


@query(
    "graph_record_texts",
    """WITH n AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank FROM n)
    SELECT l_suppkey, string_agg(l_partkey || ' (' || n || ')', ', ' ORDER BY rank) AS text FROM r WHERE rank <= 3 GROUP BY 1""",
)
def graph_record_texts(spark, d):
    return K.top_listed(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", 3)


@query(
    "graph_section_for_fact",
    """WITH s AS (SELECT doc_id, unnest([0, n_chars // 4, n_chars // 2]) AS b, n_chars FROM documents WHERE n_chars > 0), t AS (SELECT doc_id, b, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY b), n_chars) AS e FROM s)
    SELECT d.doc_id, t.b AS section FROM documents d JOIN t ON t.doc_id = d.doc_id AND (d.doc_id * 31) % d.n_chars >= t.b AND (d.doc_id * 31) % d.n_chars < t.e WHERE n_chars > 0""",
)
def graph_section_for_fact(spark, d):
    docs = table(spark, d, "documents").filter("n_chars > 0").select("doc_id", "n_chars")
    s = docs.select("doc_id", "n_chars", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 4), F.floor(F.col("n_chars") / 2))).alias("b"))
    s = s.select("doc_id", "b", F.coalesce(F.lead("b").over(Window.partitionBy("doc_id").orderBy("b")), "n_chars").alias("e"))
    points = docs.select("doc_id", ((F.col("doc_id") * 31) % F.col("n_chars")).alias("at"))
    return G.contained(points, s, "doc_id", "at", "b", "e").select("doc_id", F.col("b").alias("section"))


@query("graph_doc_dates", "SELECT o_custkey AS fact, strftime(max(o_orderdate), '%Y-%m-%d') AS doc_date FROM orders GROUP BY 1")
def graph_doc_dates(spark, d):
    o = table(spark, d, "orders")
    dates = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return o.select("o_custkey", "o_orderkey").join(dates, "o_orderkey").groupBy(F.col("o_custkey").alias("fact")).agg(F.max("date").alias("doc_date"))


@query(
    "ent_narrators",
    r"""WITH f AS (SELECT source, regexp_matches(text, '\b(of|is)\b') AS fp, doc_id % 3 = 0 AS named FROM documents), b AS (SELECT source AS file, CAST(sum(CASE WHEN fp THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN fp AND NOT named THEN 1 ELSE 0 END) AS BIGINT) AS unnamed FROM f GROUP BY 1)
    SELECT file, fp, unnamed FROM b WHERE fp >= 2 AND unnamed * 2 >= fp""",
)
def ent_narrators(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("text").rlike(r"\b(of|is)\b").alias("fp"), (F.col("doc_id") % 3 == 0).alias("named"))
    return K.narrators(rows, "file", "fp", "named")


@query(
    "ent_collapsed_refs",
    "WITH r AS (SELECT l_suppkey AS entity, l_orderkey AS k, l_returnflag AS topic, l_linenumber AS idx FROM lineitem), m AS (SELECT entity, k, topic, idx, row_number() OVER (PARTITION BY entity, k ORDER BY topic, idx) AS rn FROM r) SELECT entity, topic, idx FROM m WHERE rn = 1",
)
def ent_collapsed_refs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("topic"), F.col("l_linenumber").alias("idx"))
    return K.collapsed_refs(rows, "entity", ["k"], "topic", "idx")


@query(
    "ent_relation_remap",
    """WITH r AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem), m AS (SELECT a - a % 3 AS a, b - b % 3 AS b FROM r) SELECT a AS from_id, b AS to_id, count(*) AS n FROM m WHERE a <> b GROUP BY 1, 2""",
)
def ent_relation_remap(spark, d):
    rel = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"))
    remap = table(spark, d, "part").select("p_partkey").union(table(spark, d, "supplier").select("s_suppkey")).distinct()
    remap = remap.select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - F.col("p_partkey") % 3).alias("new"))
    return K.remapped(rel, remap).groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


@query(
    "ent_first_annotations",
    """WITH a AS (SELECT user_id AS gid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS to_gid, event_type AS verb, event_id AS pos FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY gid, to_gid ORDER BY pos) AS rn FROM a WHERE gid <> to_gid AND to_gid IN (SELECT user_id FROM events))
    SELECT gid, to_gid, verb, pos FROM r WHERE rn = 1""",
)
def ent_first_annotations(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("gid"), F.from_json("props", "k bigint")["k"].alias("to_gid"), F.concat(F.lit(" "), F.upper("event_type")).alias("verb"), F.col("event_id").alias("pos"))
    return K.annotations(rows, e.select(F.col("user_id").alias("gid"))).select("gid", "to_gid", "verb", "pos")


@query(
    "ent_pack_batches",
    """WITH RECURSIVE s AS (SELECT source, doc_id, greatest(1, length(text) // 3) AS tok, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), b AS (SELECT least(16000, greatest(CAST(floor(least(sum(tok) / count(*) * sqrt(count(*)), 20000)) AS BIGINT), CAST(floor(2.0 * sum(tok) / count(*)) AS BIGINT), 4000)) AS budget FROM s),
    p AS (SELECT source, doc_id, tok, rn, CAST(0 AS BIGINT) AS bin, CAST(tok AS BIGINT) AS load FROM s WHERE rn = 1 UNION ALL SELECT s.source, s.doc_id, s.tok, s.rn, CASE WHEN p.load + s.tok > (SELECT budget FROM b) THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.load + s.tok > (SELECT budget FROM b) THEN s.tok ELSE p.load + s.tok END FROM p JOIN s ON s.source = p.source AND s.rn = p.rn + 1)
    SELECT source, doc_id, CAST(tok AS BIGINT) AS tok, bin FROM p""",
)
def ent_pack_batches(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 3)).cast("long").alias("tok"))
    budget = K.batch_budget(rows, "tok", 20_000).head()[0]
    return greedy_pack(rows, ["source"], ["doc_id"], "tok", budget)


@query("ent_heavy_slices")
def ent_heavy_slices(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", S.count_tokens(F.col("text")).alias("tok"))
    return K.date_slices(rows, "source", ["doc_id"], "tok", 5000).select("source", "doc_id", "slice", "slices")


@query(
    "syn_caps_per_scope",
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, lang FROM r WHERE rn <= 6",
)
def syn_caps_per_scope(spark, d):
    return synthesis.capped(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 6)


@query(
    "src_malformed_offsets",
    """WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN '{"k": ' ELSE props END AS line FROM events), o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset FROM l)
    SELECT user_id, event_id, CAST(byte_offset AS BIGINT) AS byte_offset FROM o WHERE event_id % 50 = 0""",
)
def src_malformed_offsets(spark, d):
    lines = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 50 == 0, '{"k": ').otherwise(F.col("props")).alias("line"))
    return jsonl.malformed(lines, "user_id", ["event_id"], "line").select("user_id", "event_id", "byte_offset")


@query(
    "search_seed_records",
    "SELECT p.pos, d.doc_id, d.source FROM (SELECT * FROM (VALUES (0, 9), (1, 3), (2, 77), (3, 3), (4, 100000000)) t(pos, id)) p JOIN documents d ON d.doc_id = p.id",
)
def search_seed_records(spark, d):
    refs = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (9, 3, 77, 3, 100_000_000)])).alias("pos", "doc_id"))
    return table(spark, d, "documents").select("doc_id", "source").join(F.broadcast(refs), "doc_id").select("pos", "doc_id", "source")


@query(
    "search_score_samples",
    "WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1) SELECT event_type, v[1] AS nearest, v[n // 2 + 1] AS middle, v[n] AS farthest FROM s",
)
def search_score_samples(spark, d):
    w = Window.partitionBy("event_type")
    rows = table(spark, d, "events").withColumns({"r": F.row_number().over(w.orderBy("value")), "n": F.count("*").over(w)})
    pick = lambda c: F.max(F.when(c, F.col("value")))
    return rows.groupBy("event_type").agg(F.min("value").alias("nearest"), pick(F.col("r") == F.floor(F.col("n") / 2) + 1).alias("middle"), F.max("value").alias("farthest"))


@query(
    "vec_counts_by_kind",
    "SELECT k.kind, count(e.label) AS n, CAST(ceil(count(e.label) / 32.0) AS BIGINT) AS batches FROM (SELECT unnest(generate_series(0, 12)) AS kind) k LEFT JOIN embeddings e ON e.label = k.kind GROUP BY 1",
)
def vec_counts_by_kind(spark, d):
    by = table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("kind")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return spark.range(13).select(F.col("id").alias("kind")).join(by, "kind", "left").select("kind", n.alias("n"), F.ceil(n / 32).alias("batches"))


@query(
    "chat_context_lines",
    "SELECT conv_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || role || ': ' || CASE WHEN length(t) <= 600 THEN t ELSE rtrim(substr(t, 1, 599)) || '…' END AS line FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS t FROM conversations)".replace("\\\\", "\\"),
)
def chat_context_lines(spark, d):
    return K.context_lines(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role"), F.col("text")).select("conv_id", "turn", "line")


@query(
    "tel_skip_markers",
    "SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 THEN 'skipped' WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS state, count(*) AS calls FROM events GROUP BY 1",
)
def tel_skip_markers(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "props")
    marks = e.filter(F.from_json("props", "k bigint")["k"] == 7).select("event_id", F.lit(True).alias("skipped"))
    state = F.when(F.coalesce("skipped", F.lit(False)), "skipped").when(F.col("event_type") == "error", "failed").otherwise("ok")
    return e.join(marks, "event_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("calls"))


@query(
    "tel_distinct_calls",
    "SELECT event_type AS stage, count(DISTINCT CASE WHEN user_id % 3 = 0 THEN 'c' || event_id ELSE 'k' || user_id END) AS calls FROM events GROUP BY 1",
)
def tel_distinct_calls(spark, d):
    key = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("k"), F.col("user_id").cast("string")))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.countDistinct(F.coalesce(key, F.concat(F.lit("c"), F.col("event_id").cast("string")))).alias("calls"))


@query("tel_next_call_id", "SELECT lpad(CAST(max(event_id) + 1 AS VARCHAR), 8, '0') AS next_id FROM events")
def tel_next_call_id(spark, d):
    ids = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").agg(F.lpad((F.max(ids.try_cast("int")) + 1).cast("string"), 8, "0").alias("next_id"))


@query(
    "tel_history_lookup",
    """WITH h AS (SELECT event_type AS stage, user_id % 5 AS model, median(value) AS m FROM events WHERE user_id % 5 < 3 GROUP BY 1, 2), s AS (SELECT event_type AS stage, median(value) AS m FROM events WHERE event_type <> 'error' GROUP BY 1), c AS (SELECT DISTINCT event_type AS stage, user_id % 5 AS model FROM events)
    SELECT c.stage, c.model, round(coalesce(h.m, s.m, 68.0), 6) AS seconds FROM c LEFT JOIN h ON h.stage = c.stage AND h.model = c.model LEFT JOIN s ON s.stage = c.stage""",
)
def tel_history_lookup(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 5).alias("model"), "value")
    own = e.filter("model < 3").groupBy("stage", "model").agg(F.median("value").alias("a"))
    wide = e.filter("stage <> 'error'").groupBy("stage").agg(F.median("value").alias("b"))
    out = e.select("stage", "model").distinct().join(own, ["stage", "model"], "left").join(wide, "stage", "left")
    return out.select("stage", "model", F.round(F.coalesce("a", "b", F.lit(68.0)), 6).alias("seconds"))


@query(
    "tel_stage_eta",
    "SELECT event_type AS stage, round(CASE WHEN event_type = 'view' THEN 1.0 ELSE 2.0 END * count(*) / CASE WHEN event_type = 'view' THEN 1 ELSE 16 END * 25.0, 6) AS seconds, least(0.99, count(*) / 5000.0) AS bar FROM events GROUP BY 1",
)
def tel_stage_eta(spark, d):
    by = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n")).withColumn("p", F.when(F.col("stage") == "view", 1).otherwise(16))
    return by.select("stage", F.round(T.remaining_seconds(F.col("n"), F.col("p"), F.lit(25.0)), 6).alias("seconds"), F.least(F.lit(0.99), F.col("n") / 5000.0).alias("bar"))


@query(
    "tel_leaf_order",
    "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n, min(event_id) OVER (PARTITION BY user_id) AS root FROM events) SELECT event_id, row_number() OVER (ORDER BY root, event_id) AS pos FROM r WHERE rn = n",
)
def tel_leaf_order(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.min("event_id").alias("root"))
    return last.select("event_id", F.row_number().over(Window.orderBy("root", "event_id")).alias("pos"))


@query(
    "tel_model_tokens",
    "SELECT CASE WHEN contains(lower(p_brand), '3') THEN '3' WHEN contains(lower(p_brand), '2') THEN '2' WHEN contains(lower(p_brand), '1') THEN '1' ELSE 'other' END AS token, count(*) AS n FROM part GROUP BY 1",
)
def tel_model_tokens(spark, d):
    out = F.lit("other")
    for t in ("1", "2", "3"):  # the first that is found wins, so the last here
        out = F.when(F.contains(F.lower("p_brand"), F.lit(t)), t).otherwise(out)
    return table(spark, d, "part").groupBy(out.alias("token")).agg(F.count("*").alias("n"))


@query(
    "tel_wall_clock",
    "SELECT event_type AS stage, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS wall_ms, strftime(min(ts), '%Y-%m-%d') AS first_day FROM events GROUP BY 1",
)
def tel_wall_clock(spark, d):
    ts = F.col("ts").cast("timestamp")
    wall = F.greatest(F.lit(0), F.floor((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1000))
    return table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(wall.alias("wall_ms"), F.date_format(F.min(ts), "yyyy-MM-dd").alias("first_day"))


@query(
    "mdl_budget",
    """WITH s AS (SELECT o_orderkey, o_custkey AS payload, 0.1 + (o_orderkey % 9) / 10.0 AS r FROM orders) SELECT o_orderkey, CAST(floor(least((131072 - 3000) / (1 + r), 32768 / r)) AS BIGINT) AS max_input,
    CAST(least(greatest(CAST(floor(r * payload) AS BIGINT) + 2048, 32000 - payload), 131072 - payload - 3000, 32768) AS BIGINT) AS max_output FROM s""",
)
def mdl_budget(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("payload"), (F.lit(0.1) + (F.col("o_orderkey") % 9) / 10.0).alias("r"))
    limit = F.floor(F.least((131_072 - 3000) / (1 + F.col("r")), 32_768 / F.col("r")))
    out = F.least(F.greatest(F.floor(F.col("r") * F.col("payload")) + 2048, 32_000 - F.col("payload")), 131_072 - F.col("payload") - 3000, F.lit(32_768))
    return rows.select("o_orderkey", limit.cast("long").alias("max_input"), out.cast("long").alias("max_output"))


@query("mdl_halves")
def mdl_halves(spark, d):
    @F.pandas_udf("long")
    def first_half(texts):
        return texts.map(lambda t: len(h[0]) if (h := K.halves(t or "")) else 0)

    return table(spark, d, "documents").select("doc_id", first_half("text").alias("first_half"))
