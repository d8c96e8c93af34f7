"""Queries of pattern, insight and action synthesis, the model boundary and the export."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import export, job, model, synthesis, telemetry
from ..session import shared_folder
from ..sources import cache
from .registry import query, table


@query(
    "syn_caps",
    """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, least(10, greatest(0, CAST(round_even(ln(n), 0) AS INTEGER))) AS total FROM n)
    SELECT source, n, least(75, CAST(round_even(pow(n, 0.6), 0) AS INTEGER)) AS patterns, total AS insights, CAST(round_even(total * 0.6, 0) AS INTEGER) AS cross_domain, total - CAST(round_even(total * 0.6, 0) AS INTEGER) AS critical FROM t""",
)
def syn_caps(spark, d):
    by = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("insights", S.insight_cap(F.col("n")))
    cross = S.cross_cap(F.col("insights"))
    return by.select("source", "n", S.pattern_cap(F.col("n")).alias("patterns"), "insights", cross.alias("cross_domain"), (F.col("insights") - cross).alias("critical"))


_AXES = [(f"(event_id * {m}) % 11", m) for m in (3, 5, 7, 2, 9, 4, 8)]


@query(
    "syn_weighted_score_topk",
    "WITH s AS (SELECT event_id, round(" + " + ".join(f"{w} * ({a[0]})" for w, a in zip((0.25, 0.20, 0.15, 0.15, 0.10, 0.075, 0.075), _AXES, strict=True)) + ", 6) AS score FROM events) SELECT event_id, score FROM s ORDER BY score DESC, event_id LIMIT 10",
)
def syn_weighted_score_topk(spark, d):
    axes = [((F.col("event_id") * m) % 11).cast("double") for _, m in _AXES]
    rows = table(spark, d, "events").select("event_id", F.round(S.action_score(axes), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "event_id").limit(10)


@query(
    "syn_ref_resolution_max_conf",
    """WITH r AS (SELECT user_id AS pattern, event_id % 60 AS ref, value / 100.0 AS conf FROM events), f AS (SELECT pattern, ref - 1 AS fact, max(conf) AS conf FROM r WHERE ref BETWEEN 1 AND 50 GROUP BY 1, 2)
    SELECT pattern, fact, round(conf, 6) AS conf, row_number() OVER (PARTITION BY pattern ORDER BY conf DESC, fact) AS pos FROM f""",
)
def syn_ref_resolution_max_conf(spark, d):
    refs = table(spark, d, "events").select(F.col("user_id").alias("pattern"), (F.col("event_id") % 60).alias("ref"), (F.col("value") / 100.0).alias("conf"))
    return synthesis.resolved_refs(refs, "pattern", "ref", "conf", 50).withColumn("conf", F.round("conf", 6))


@query(
    "syn_hallucinated_refs",
    "SELECT user_id AS pattern, CAST(sum(CASE WHEN event_id % 60 BETWEEN 1 AND 50 THEN 0 ELSE 1 END) AS BIGINT) AS hallucinated FROM events GROUP BY 1",
)
def syn_hallucinated_refs(spark, d):
    ok = (F.col("event_id") % 60).between(1, 50)
    return table(spark, d, "events").groupBy(F.col("user_id").alias("pattern")).agg(F.count_if(~ok).alias("hallucinated"))


@query(
    "syn_halving",
    """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars % 100 DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id FROM r WHERE n < 4 OR rn <= greatest(2, n // 2)""",
)
def syn_halving(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") % 100).alias("confidence"))
    return synthesis.halved(rows, ["source"], "confidence", "doc_id").select("source", "doc_id")


@query(
    "syn_evenly_spaced",
    """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), i AS (SELECT source, n, unnest(generate_series(0, 6)) AS i FROM n)
    SELECT DISTINCT source, CASE WHEN i = 6 THEN n - 1 ELSE CAST(floor((i + 0.5) * n / 7) AS BIGINT) END AS idx FROM i""",
)
def syn_evenly_spaced(spark, d):
    by = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return by.select("source", F.explode(S.evenly_spaced(F.col("n"), F.lit(7)).cast("array<bigint>")).alias("idx"))


@query(
    "syn_cross_domain_gate",
    """WITH r AS (SELECT o_custkey AS insight, o_orderpriority AS topic, o_orderkey AS ref FROM orders) SELECT insight, count(DISTINCT topic) AS topics, count(*) AS refs FROM r GROUP BY 1 HAVING count(DISTINCT topic) >= 2 AND count(*) >= 2""",
)
def syn_cross_domain_gate(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("insight"), F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("ref"))
    return synthesis.cross_domain(rows, "insight", "topic", "ref")


@query(
    "syn_top_pattern_keys",
    "SELECT l_returnflag AS topic, l_suppkey AS name, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, topic, name LIMIT 40",
)
def syn_top_pattern_keys(spark, d):
    by = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("topic"), F.col("l_suppkey").alias("name")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "topic", "name").limit(40)


@query("syn_prompt_ids", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS prompt_id FROM documents")
def syn_prompt_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("source", "doc_id")).alias("prompt_id"))


@query(
    "syn_review_dates",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'O' THEN 14 ELSE 90 END AS DATE) AS review_date FROM orders",
)
def syn_review_dates(spark, d):
    horizon = F.when(F.col("o_orderstatus") == "O", "short").when(F.col("o_orderstatus") == "F", "long").otherwise("someday")
    return table(spark, d, "orders").select("o_orderkey", S.review_date(horizon, F.to_date("o_orderdate")).alias("review_date"))


@query("syn_sample_to_fit")
def syn_sample_to_fit(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("idx"), F.length("text").alias("n"))
    return synthesis.sampled_to_fit(rows, 20_000)


@query("mdl_cache_key", """SELECT doc_id, sha256('{"doc":' || doc_id || ',"lang":"' || lang || '","stage":"extract"}') AS cache_key FROM documents""")
def mdl_cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", S.canonical_hash(("stage", F.lit("extract")), ("lang", F.col("lang")), ("doc", F.col("doc_id"))).alias("cache_key"))


_STATUS = """WITH c AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(
    "mdl_status_ladder",
    _STATUS
    + """ SELECT CASE WHEN event_type = 'error' THEN CASE WHEN k < 20 THEN 'LOAD' WHEN k < 40 THEN CASE WHEN value < 1 THEN 'OTHER' WHEN value / 2 > 0.5 * value THEN 'LOAD' ELSE 'TIMEOUT_WITH_TOKENS' END WHEN k < 60 THEN 'CAP_HIT' WHEN value >= 90 THEN 'CAP_HIT' ELSE 'OTHER' END
      WHEN event_type = 'view' AND k = 0 THEN 'LOAD' ELSE 'OK' END AS status, count(*) AS calls FROM c GROUP BY 1""",
)
def mdl_status_ladder(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    calls = table(spark, d, "events").withColumn("k", k)
    cls = F.when(F.col("k") < 20, "ConnectionError").when(F.col("k") < 40, "Timeout").otherwise("ValueError")
    calls = calls.select(
        F.when(F.col("event_type") == "error", cls).alias("error_class"), F.when(F.col("k").between(40, 59), "maximum context length exceeded").alias("message"),
        F.when(F.col("value") >= 1, F.col("value")).alias("duration"), (F.col("value") / 2).alias("ttft"), F.col("value").alias("completion_tokens"), F.lit(90.0).alias("max_tokens"),
        F.when((F.col("event_type") == "view") & (F.col("k") == 0), "").otherwise("x").alias("payload"),
    )
    return calls.groupBy(model.status().alias("status")).agg(F.count("*").alias("calls"))


@query("mdl_retry_ladder")
def mdl_retry_ladder(spark, d):
    calls = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("prompt"))
    return model.run_ladder(calls, model.stub_provider).select("call_id", "root_id", "status", "attempt")


@query(
    "mdl_cache_hits",
    "SELECT count(l.doc_id) AS hits, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def mdl_cache_hits(spark, d):
    key = S.canonical_hash(("doc", F.col("doc_id")))
    calls = table(spark, d, "documents").select(key.alias("cache_key"))
    cache = table(spark, d, "labels").select(key.alias("cache_key"), F.current_timestamp().alias("stored_at"))
    hits, misses = model.through_cache(calls, cache)
    return hits.agg(F.count("*").alias("hits")).join(misses.agg(F.count("*").alias("misses")))


@query(
    "exp_facts_md",
    r"""WITH f AS (SELECT source, doc_id, lang, replace(replace(text, chr(10), ' '), '#', '\#') AS t FROM documents)
    SELECT 'facts/' || source || '.md' AS path, sha256('# ' || source || chr(10) || chr(10) || string_agg('- **' || lang || '** ' || t || ' ^doc-' || doc_id, chr(10) ORDER BY doc_id)) AS digest FROM f GROUP BY source""",
)
def exp_facts_md(spark, d):
    t = export.escaped_tags(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    line = F.concat(F.lit("- **"), F.col("lang"), F.lit("** "), t, F.lit(" ^doc-"), F.col("doc_id").cast("string"))
    files = export.pages(table(spark, d, "documents").select("source", "doc_id", line.alias("line")), "source", ["doc_id"], "line", "facts/")
    return files.select("path", F.sha2("content", 256).alias("digest"))


@query("exp_percent", "SELECT event_id, CAST(round_even((round(value, 6) / 100.0) * 100, 0) AS INTEGER) || '%' AS pct FROM events")
def exp_percent(spark, d):
    return table(spark, d, "events").select("event_id", S.percent(F.round(F.col("value"), 6) / 100.0).alias("pct"))


@query(
    "exp_first_refs",
    """WITH r AS (SELECT l_suppkey, l_orderkey || ':' || l_linenumber AS ref, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
    SELECT l_suppkey, string_agg(ref, ' ' ORDER BY rn) || CASE WHEN max(n) > 30 THEN ' +' || (max(n) - 30) || ' more' ELSE '' END AS refs FROM r WHERE rn <= 30 GROUP BY 1""",
)
def exp_first_refs(spark, d):
    ref = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return export.first_refs(table(spark, d, "lineitem").withColumn("ref", ref), "l_suppkey", ["l_orderkey", "l_linenumber"], "ref", 30)


@query(
    "exp_privacy_cut",
    "SELECT CASE WHEN o_orderpriority <= '3' THEN 'kept' ELSE 'cut' END AS side, count(*) AS records FROM orders GROUP BY 1",
)
def exp_privacy_cut(spark, d):
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return export.cut_at_level(table(spark, d, "orders").withColumn("level", level), "level", 2)


@query(
    "mdl_cache_runs",
    """WITH k AS (SELECT source AS stage, text FROM documents), d AS (SELECT stage, count(*) AS calls, count(DISTINCT text) AS keys FROM k GROUP BY 1)
    SELECT stage, 1 AS run, 0::BIGINT AS hits, calls AS misses, keys AS stores FROM d UNION ALL SELECT stage, 2, calls, 0, 0 FROM d UNION ALL SELECT stage, 3, 0, calls, keys FROM d""",
)
def mdl_cache_runs(spark, d):
    """Three runs over a store on disk: the second is answered by the first, the third comes after all has expired."""
    text = F.col("text")
    calls = table(spark, d, "documents").select(F.col("source").alias("stage"), S.canonical_hash(("text", text)).alias("cache_key"), F.col("doc_id").cast("string").alias("call_id"), text.alias("prompt"))
    kept = cache.CacheStore(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", buckets=4)
    start, out = F.lit("2024-01-01 00:00:00").cast("timestamp"), None
    for run, day in enumerate((0, 5, 40), 1):
        _, counters = cache.through(kept, calls, lambda asked: asked.select("call_id", F.lit("OK").alias("status"), F.md5("prompt").alias("value")), start + F.make_dt_interval(F.lit(day)))
        counters = counters.select("stage", F.lit(run).alias("run"), "hits", "misses", "stores")
        out = counters if out is None else out.unionByName(counters)
    return out


def _ladder_provider(calls):
    """Replies by doc_id: good at once, load until the fallback model, load until reasoning is off, too long, other errors until the fallback model."""
    out = []
    for root, prompt, thinking, fallback in zip(calls["root_id"], calls["prompt"], calls["thinking"], calls["fallback"], strict=True):
        k = int(root[1:]) % 5
        if (k == 1 and not fallback) or (k == 2 and thinking):
            out.append({"error_class": "RateLimitError"})
        elif k == 3 and len(prompt) > 40:
            out.append({"error_class": "BadRequest", "message": "maximum context length in tokens"})
        elif k == 4 and not fallback:
            out.append({"error_class": "ValueError", "message": "no"})
        else:
            out.append({"payload": "{}", "duration": 0.25, "completion_tokens": len(prompt), "max_tokens": 100})
    return out


@query(
    "mdl_ladder_log",
    """SELECT 'd' || doc_id AS root_id, [1, 5, 3, 7, 3][doc_id % 5 + 1] AS calls, [1, 1, 1, 4, 1][doc_id % 5 + 1] AS good, [0, 4, 2, 6, 2][doc_id % 5 + 1] AS retries,
      [100, 100, 100, 100, 100][doc_id % 5 + 1] AS tokens, [1, 1, 1, 4, 1][doc_id % 5 + 1] AS leaves FROM documents""",
)
def mdl_ladder_log(spark, d):
    """The ladder's own log, folded into calls: every attempt is one, and what was good makes up the prompt."""
    calls = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("call_id"), F.repeat(F.lit("x"), F.lit(100)).alias("prompt"))
    _, log = model.logged_ladder(calls, _ladder_provider, stage="extract")
    folded = telemetry.folded(log).withColumn("root_id", F.regexp_extract("call_id", "^([^/#]+)", 1))
    leaf = telemetry.leaves(folded).select("call_id", F.lit(True).alias("leaf"))
    by = folded.join(leaf, "call_id", "left").groupBy("root_id")
    count = lambda x: F.count_if(x).cast("int")
    return by.agg(F.count("*").cast("int").alias("calls"), count(F.col("success")).alias("good"), count(F.col("retry_of_call_id").isNotNull()).alias("retries"), F.sum("completion_tokens").cast("int").alias("tokens"), count(F.col("leaf")).alias("leaves"))


@query(
    "mdl_ladder_outcomes",
    """SELECT 'd' || doc_id AS root_id, ['OK', 'SUCCESS_MODEL_FALLBACK', 'SUCCESS_REASONING_OFF', 'OK', 'SUCCESS_MODEL_FALLBACK'][doc_id % 5 + 1] AS status, [0, 4, 2, 2, 2][doc_id % 5 + 1] AS attempt, [1, 1, 1, 4, 1][doc_id % 5 + 1] AS calls FROM documents""",
)
def mdl_ladder_outcomes(spark, d):
    """Every way through the ladder: at once, by the fallback model after load, without reasoning, in quarters, by the fallback after other errors."""
    calls = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("call_id"), F.repeat(F.lit("x"), F.lit(100)).alias("prompt"))
    rows = model.run_ladder(calls, _ladder_provider)
    return rows.groupBy("root_id", "status", "attempt").agg(F.count("*").alias("calls"))


def stage_provider(calls):
    """Replies of a small model by rules: one fact of a document, one pattern of a topic over its first and third facts (and one that is not there), one action."""
    out = []
    for prompt in calls["prompt"]:
        head, _, body = prompt.partition("\n")
        if head == "EXTRACT":
            items = [{"type": "fact", "text": body[:40], "topics": [f"t{len(body) % 3}"], "quote": body[5:45]}, {"type": "rumour", "text": "no"}]
            out.append({"payload": json.dumps({"items": items})})
        elif head.startswith("PATTERNS"):
            out.append({"payload": json.dumps({"patterns": [{"name": f"P {head[9:]}", "refs": [[0, 0.9], [2, 0.5], [999999, 7]]}]})})
        else:
            out.append({"payload": json.dumps({"actions": [{"recommendation": f"Do {body.count(chr(10)) + 1}", "refs": [{"topic": "t0", "idx": 0, "conf": 0.8}, {"topic": "zz", "idx": 0, "conf": 0.1}]}]})})
    return out


# The parts of split.split() within 16,000 tokens of three characters. Where a longer text may be cut: before a heading or after a blank line (kind 0), after a sentence (1), after a line (2), at
# fixed steps (3). From each begin on the latest place of the strongest kind within the budget is the cut; the search goes on behind the first place beyond it (`past`), which is the cut if none is within.
_PARTS = r"""WITH RECURSIVE long AS (SELECT doc_id, text FROM documents WHERE length(text) // 3 > 16000),
    found AS (SELECT doc_id, 2 AS kind, regexp_extract_all(text, '[^\n]*\n') AS m, CAST([] AS VARCHAR[]) AS h FROM long
      UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '(?s:.*?)[.!?][\x09-\x0d\x1c-\x20\x{85}\p{Z}]'), CAST([] AS VARCHAR[]) FROM long
      UNION ALL SELECT doc_id, 0, regexp_extract_all(text, '(?s:.*?)\n[\x09-\x0d\x1c-\x20\x{85}\p{Z}]*\n'), CAST([] AS VARCHAR[]) FROM long
      UNION ALL SELECT doc_id, -1, regexp_extract_all(text, '(?s:.*?)(?m:^#{1,2}[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+[^\n]+$)'), regexp_extract_all(text, '(?s:.*?)(?m:^(#{1,2}[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+[^\n]+)$)', 1) FROM long),
    ends AS (SELECT doc_id, kind, unnest(m) AS m, unnest(h) AS h, generate_subscripts(m, 1) AS i FROM found),
    places AS (SELECT doc_id, greatest(kind, 0) AS kind, CAST(sum(length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) - coalesce(length(h), 0) AS place FROM ends
      UNION ALL SELECT doc_id, 3, unnest(range(48000, length(text), 48000)) FROM long),
    cuts AS (SELECT doc_id, place, CASE WHEN min(kind) < 2 THEN min(kind) ELSE max(kind) END AS kind FROM places WHERE place > 0 GROUP BY 1, 2),
    begins AS (SELECT doc_id, 0 AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS past FROM long
      UNION ALL SELECT doc_id, k + 1, coalesce(c0, c1, c2, c3, past), past FROM (SELECT b.doc_id, b.k, min(place) FILTER ((place - a) // 3 > 16000) AS past, max(place) FILTER (kind = 0 AND (place - a) // 3 <= 16000) AS c0,
        max(place) FILTER (kind = 1 AND (place - a) // 3 <= 16000) AS c1, max(place) FILTER (kind = 2 AND (place - a) // 3 <= 16000) AS c2, max(place) FILTER (kind = 3 AND (place - a) // 3 <= 16000) AS c3
        FROM begins b JOIN cuts c ON c.doc_id = b.doc_id AND c.place > b.past GROUP BY b.doc_id, b.k, b.a) WHERE past IS NOT NULL),
    parts AS (SELECT doc_id, 0 AS k, text AS p FROM documents WHERE length(text) // 3 <= 16000
      UNION ALL SELECT doc_id, k, substr(text, a + 1, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), length(text)) - a) FROM begins JOIN long USING (doc_id)),"""


@query(
    "mdl_staged_job",
    _PARTS
    + r""" b AS (SELECT doc_id, k, regexp_replace(p, '^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+|[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+$', '', 'g') AS b FROM parts), f AS (SELECT doc_id, k, 't' || (length(b) % 3) AS topic, substr(b, 1, 40) AS t FROM b WHERE b <> ''),
    n AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(trim(regexp_replace(lower(t), '\s+', ' ', 'g')), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g') ORDER BY doc_id, k) AS rn FROM f),
    c AS (SELECT topic, count(*) AS n, sum(doc_id) AS s FROM n WHERE rn = 1 GROUP BY 1)
    SELECT 'facts' AS stage, topic AS name, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS total FROM c UNION ALL SELECT 'patterns', 'P ' || topic, CAST(CASE WHEN n > 2 THEN 2 ELSE 1 END AS BIGINT), CAST(CASE WHEN n > 2 THEN 1 ELSE 2 END AS BIGINT) FROM c
    UNION ALL SELECT 'actions', 'Do ' || count(*), CAST(count(*) FILTER (WHERE topic = 't0') AS BIGINT), CAST(2 - count(*) FILTER (WHERE topic = 't0') AS BIGINT) FROM c""",
)
def mdl_staged_job(spark, d):
    """Documents to actions in stages on disk, over a provider that replies by rules. A document above the budget of a call is asked in parts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = job.run_staged(job.pipeline(), {"documents": docs}, stage_provider, f"{shared_folder(spark)}/job-{uuid.uuid4().hex}")
    facts = made["facts"].groupBy(F.lit("facts").alias("stage"), F.col("topic").alias("name")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))
    patterns = made["patterns"].select(F.lit("patterns"), "name", F.size("source_facts").cast("long"), "hallucinated")
    return facts.union(patterns).union(made["actions"].select(F.lit("actions"), "recommendation", F.size("source_patterns").cast("long"), "hallucinated"))
