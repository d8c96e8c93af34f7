"""Queries of telemetry: the events table plays the call log (a user's events in order are a chain of retries)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import statistics
from ..operators import telemetry as T
from ..streaming import calls
from ..streaming import events as stream
from .registry import query, table


def _log(spark, d):
    """Begin and end events of calls: call n is events 2n (begin) and 2n + 1 (end)."""
    e = table(spark, d, "events").withColumns({"k": F.from_json("props", "k bigint")["k"], "call_id": F.floor(F.col("event_id") / 2).cast("string")})
    begin = F.col("event_id") % 2 == 0
    return e.select(
        F.when(begin, "begin").otherwise("end").alias("event"), "call_id", F.when(begin, F.col("event_type")).alias("stage"), F.col("event_id").alias("pos"),
        F.when(~begin, F.col("event_type") != "error").alias("success"), F.when(~begin & (F.col("event_type") == "error"), F.when(F.col("k") < 50, "Timeout").otherwise("ValueError")).alias("error_class"),
        F.when(~begin, F.round(F.col("value") * 100).cast("long")).alias("duration_ms"), F.when(~begin, F.when(F.col("k") > 90, "length").otherwise("stop")).alias("finish_reason"),
        F.when(~begin, F.when(F.col("k") % 3 == 0, "LOAD").when(F.col("k") % 3 == 1, "CAP_HIT").otherwise("OTHER")).alias("llm_status"), F.lit(None).cast("string").alias("message"),
        F.when(~begin, F.col("k") == 7).alias("parse_error"), F.lit(None).cast("boolean").alias("empty_response"), F.lit(None).cast("boolean").alias("interrupted"),
        F.when(~begin, F.concat(F.lit('{"items": '), (F.col("k") % 5).cast("string"), F.lit(', "cap": 9}'))).alias("output"),
    )


_CALLS = """v AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    c AS (SELECT b.event_id // 2 AS call_id, b.event_type AS stage, x.event_id IS NULL AS aborted, x.event_type <> 'error' AS success, x.k, CAST(round(x.value * 100) AS BIGINT) AS duration_ms FROM v b LEFT JOIN v x ON x.event_id = b.event_id + 1 WHERE b.event_id % 2 = 0)"""


@query("tel_fold", f"WITH {_CALLS} SELECT CAST(call_id AS VARCHAR) AS call_id, stage, aborted, success, duration_ms FROM c")
def tel_fold(spark, d):
    return T.folded(_log(spark, d)).select("call_id", "stage", "aborted", "success", "duration_ms")


@query(
    "tel_outcomes",
    f"""WITH {_CALLS} SELECT CASE WHEN aborted THEN 'aborted' WHEN NOT success THEN CASE WHEN k > 90 THEN 'cap_hit (sizing)' WHEN k = 7 THEN 'parse_error (sizing)' WHEN k < 50 THEN CASE WHEN k % 3 = 1 THEN 'timeout (sizing)' ELSE 'timeout (load)' END
      ELSE 'failed (' || CASE k % 3 WHEN 0 THEN 'load' WHEN 1 THEN 'sizing' ELSE 'other' END || ')' END
      WHEN k > 90 THEN 'cap_hit (sizing)' WHEN k = 7 THEN 'parse_error (sizing)' WHEN k % 5 = 0 THEN 'success_empty' ELSE 'success' END AS outcome, count(*) AS calls FROM c GROUP BY 1""",
)
def tel_outcomes(spark, d):
    return T.folded(_log(spark, d)).groupBy(T.outcome().alias("outcome")).agg(F.count("*").alias("calls"))


@query(
    "tel_rollup_grouping_sets",
    """SELECT 'all' AS scope, '' AS name, count(*) AS calls, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS successes, CAST(sum(user_id) AS BIGINT) AS tokens FROM events
    UNION ALL SELECT 'stage', event_type, count(*), CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(user_id) AS BIGINT) FROM events GROUP BY event_type
    UNION ALL SELECT 'model', CAST(user_id % 4 AS VARCHAR), count(*), CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT), CAST(sum(user_id) AS BIGINT) FROM events GROUP BY user_id % 4""",
)
def tel_rollup_grouping_sets(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 4).cast("string").alias("model"), (F.col("value") > 10).alias("success"), F.col("user_id").alias("tokens"))
    return T.rollup(calls)


@query(
    "tel_p95_half_even",
    """WITH r AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events), l AS (SELECT event_type, list_sort(list(v)) AS s, count(*) AS n, sum(v) AS t, min(v) AS mn, max(v) AS mx, median(v) AS md FROM r GROUP BY 1)
    SELECT event_type, CAST(t AS BIGINT) AS total, round_even(CAST(t AS DOUBLE) / n, 2) AS avg, round_even(CAST(md AS DOUBLE), 2) AS median, s[CAST(round_even(0.95 * (n - 1), 0) AS INTEGER) + 1] AS p95, mn AS min, mx AS max FROM l""",
)
def tel_p95_half_even(spark, d):
    return statistics.distribution(table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v")), ["event_type"], "v")


@query(
    "tel_nearest_rank",
    "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1",
)
def tel_nearest_rank(spark, d):
    return statistics.nearest_ranks(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(
    "tel_stage_statistics",
    f"""WITH {_CALLS}, o AS (SELECT *, CASE WHEN aborted THEN 'aborted' WHEN NOT success THEN 'failed' ELSE 'success' END AS label, call_id % 40 AS category FROM c),
    n AS (SELECT stage, label, count(*) AS n FROM o GROUP BY 1, 2), s AS (SELECT stage, CAST(sum(n) AS BIGINT) AS calls, string_agg(label || '=' || n, ' ' ORDER BY label) AS outcomes FROM n GROUP BY 1),
    l AS (SELECT stage, CAST(sum(CASE WHEN NOT ok THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM (SELECT stage, category, bool_or(coalesce(success, false)) AS ok FROM o GROUP BY 1, 2) GROUP BY 1),
    z AS (SELECT stage, list_sort(list(duration_ms)) AS s, count(*) AS n, sum(duration_ms) AS t, median(duration_ms) AS md FROM o WHERE duration_ms IS NOT NULL GROUP BY 1)
    SELECT s.*, lost, CAST(t AS BIGINT) AS total, round_even(CAST(t AS DOUBLE) / n, 2) AS avg, round_even(CAST(md AS DOUBLE), 2) AS median, s[CAST(round_even(0.95 * (n - 1), 0) AS INTEGER) + 1] AS p95
    FROM s JOIN l USING (stage) LEFT JOIN z USING (stage)""".replace("SELECT s.*, lost", "SELECT stage, calls, outcomes, lost").replace("median, s[", "median, z.s["),
)
def tel_stage_statistics(spark, d):
    calls = T.folded(_log(spark, d))
    label = F.when(F.col("aborted"), "aborted").when(~F.col("success"), "failed").otherwise("success")
    found = statistics.stage_statistics(calls.withColumn("category", F.col("call_id").cast("long") % 40), label, ["duration_ms"])
    shown = F.array_join(F.transform("outcomes", lambda o: F.concat(o["label"], F.lit("="), o["n"].cast("string"))), " ")
    return found.select("stage", "calls", shown.alias("outcomes"), "lost", *[F.col(f"duration_ms.{c}").alias(c) for c in ("total", "avg", "median", "p95")])


_CHAIN = """r AS (SELECT event_id, user_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS rn FROM events),
    c AS (SELECT event_id, user_id, event_type, rn % 5 AS depth, user_id || '/' || (rn // 5) AS chain FROM r)"""


def _chained(spark, d):
    """Chains of five calls: each retries the event before it of the same user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type").withColumns({"rn": F.row_number().over(w) - 1, "before": F.lag("event_id").over(w)})
    cat = F.when(F.col("event_type") == "error", "x/sample-1").when(F.col("event_type") == "view", "x/reasoning-off").otherwise("x")
    return rows.select(F.col("event_id").alias("call_id"), F.when(F.col("rn") % 5 > 0, F.col("before")).alias("retry_of_call_id"), cat.alias("category"), F.lit("success").alias("outcome"))


@query("tel_leaf_outcomes", f"WITH {_CHAIN}, m AS (SELECT chain, max(depth) AS depth FROM c GROUP BY 1) SELECT event_id AS call_id FROM c JOIN m ON c.chain = m.chain AND c.depth = m.depth")
def tel_leaf_outcomes(spark, d):
    return T.leaves(_chained(spark, d)).select("call_id")


@query("tel_retry_root", f"WITH {_CHAIN} SELECT c.event_id AS call_id, f.event_id AS root, CAST(c.depth AS INTEGER) AS depth FROM c JOIN (SELECT chain, event_id FROM c WHERE depth = 0) f ON f.chain = c.chain")
def tel_retry_root(spark, d):
    return T.chains(_chained(spark, d), hops=8).select("call_id", "root", "depth")


@query(
    "tel_chain_outcomes",
    f"""WITH {_CHAIN}, a AS (SELECT chain, max(depth) AS depth, bool_or(event_type = 'error') AS s, bool_or(event_type = 'view') AS o FROM c GROUP BY 1)
    SELECT CASE WHEN a.chain IS NULL THEN 'success' WHEN s THEN 'success_sampled' WHEN o THEN 'success_reasoning_off' ELSE 'success' END AS outcome, count(*) AS calls FROM c LEFT JOIN a ON c.chain = a.chain AND c.depth = a.depth GROUP BY 1""",
)
def tel_chain_outcomes(spark, d):
    return T.chain_aware(_chained(spark, d)).groupBy("outcome").agg(F.count("*").alias("calls"))


@query(
    "tel_size_hist",
    """WITH b AS (SELECT CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 500 THEN 1 WHEN n_chars < 1000 THEN 2 WHEN n_chars < 2000 THEN 3 ELSE 4 END AS bucket FROM documents)
    SELECT d.bucket, d.from_size, count(b.bucket) AS n FROM (SELECT * FROM (VALUES (0, 0), (1, 200), (2, 500), (3, 1000), (4, 2000)) t(bucket, from_size)) d LEFT JOIN b ON b.bucket = d.bucket GROUP BY 1, 2""",
)
def tel_size_hist(spark, d):
    return T.size_histogram(table(spark, d, "documents"), "n_chars")


@query(
    "tel_categories_lost",
    "WITH g AS (SELECT event_type AS stage, user_id AS category, bool_or(value > 60) AS ok FROM events GROUP BY 1, 2) SELECT stage, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS lost, count(*) AS categories FROM g GROUP BY 1",
)
def tel_categories_lost(spark, d):
    return T.categories_lost(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("user_id").alias("category"), (F.col("value") > 60).alias("success")))


@query(
    "tel_eta",
    """WITH s AS (SELECT event_type AS stage, value AS d, CAST(json_extract_string(props, '$.k') AS BIGINT) AS t FROM events), r AS (SELECT stage, median(d / t) AS per_token, CAST(floor(median(t)) AS BIGINT) AS median_tokens FROM s WHERE t > 0 GROUP BY 1)
    SELECT s.stage, round(first(per_token), 6) AS per_token, round(median(greatest(0.0, d - per_token * t)), 6) AS fixed, first(median_tokens) AS median_tokens FROM s JOIN r ON r.stage = s.stage WHERE t > 0 GROUP BY 1""",
)
def tel_eta(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("d"), F.from_json("props", "k bigint")["k"].alias("t"))
    out = T.coefficients(rows, "stage", "d", "t")
    return out.select("stage", F.round("per_token", 6).alias("per_token"), F.round("fixed", 6).alias("fixed"), "median_tokens")


@query(
    "tel_sampled_calls",
    """WITH r AS (SELECT event_id, event_type, user_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id FROM r WHERE rn IN (1, n // 2 + 1, n) OR event_type = 'error'""",
)
def tel_sampled_calls(spark, d):
    return T.first_median_last(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id")


@query(
    "tel_retry_ordinals",
    "SELECT event_id, event_type || '/half-' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS label FROM events",
)
def tel_retry_ordinals(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return table(spark, d, "events").select("event_id", F.concat("event_type", F.lit("/half-"), n.cast("string")).alias("label"))


@query(
    "tel_stage_tokens",
    "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS token, count(*) AS calls FROM events GROUP BY 1",
)
def tel_stage_tokens(spark, d):
    stage = F.concat(F.lpad((F.col("user_id") % 20).cast("string"), 2, "0"), F.lit("-"), F.upper("event_type"))
    return table(spark, d, "events").groupBy(T.stage_token(stage, ["click", "view"]).alias("token")).agg(F.count("*").alias("calls"))


@query(
    "tel_blended_seconds",
    """WITH g AS (SELECT user_id, count(*) AS done, avg(value) AS live FROM events GROUP BY 1) SELECT user_id, round(least(1.0, done / 100.0) * least(90.0, greatest(9.0, live)) + (1 - least(1.0, done / 100.0)) * 30.0, 6) AS per_call FROM g""",
)
def tel_blended_seconds(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("done"), F.avg("value").alias("live"))
    return by.select("user_id", F.round(T.blended(F.col("live"), F.lit(30.0), F.col("done"), F.lit(100.0)), 6).alias("per_call"))


@query(
    "tel_pre_estimate",
    """WITH s AS (SELECT count(*) AS files, sum(octet_length(encode(text))) AS b FROM documents), t AS (SELECT files, b // 3 AS tok FROM s), f AS (SELECT *, greatest(1, CAST(floor(tok * 0.5) AS BIGINT) // 80) AS facts FROM t), g AS (SELECT *, greatest(1, facts // 5) AS groups FROM f)
    SELECT CAST(greatest(1, files, CAST(ceil(tok / 16000.0) AS BIGINT)) AS BIGINT) AS extract, CAST(greatest(2, CAST(ceil(sqrt(groups)) AS BIGINT)) AS BIGINT) AS entities FROM g""",
)
def tel_pre_estimate(spark, d):
    s = table(spark, d, "documents").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("b"))
    e = T.pre_estimate(F.col("files"), F.col("b"), 16_000, 13, F.lit(0))
    return s.select(e["extract"].alias("extract"), e["entities"].alias("entities"))


_STREAM = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, d):
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_dir(spark, path) else d + "/event[s].parquet")


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(
    "st_tumbling",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
)
def st_tumbling(spark, d):
    return stream.caught_up(stream.tumbling(stream.timed(_stream(spark, d), late="60 days")), "complete")


@query(
    "st_session",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY user_id, n""",
)
def st_session(spark, d):
    return stream.caught_up(stream.sessions(stream.timed(_stream(spark, d), late="60 days")), "complete")


@query(
    "st_fold_stream",
    "SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY 1",
)
def st_fold_stream(spark, d):
    return stream.caught_up(stream.fold(_stream(spark, d)), "complete")


@query(
    "st_call_states",
    """WITH v AS (SELECT event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), w AS (SELECT epoch_ms(max(ts)) - 864000000 AS mark FROM events),
    c AS (SELECT b.event_id // 3 AS call_id, b.event_type AS stage, epoch_ms(b.ts) AS start, p.k AS ttft_ms, p.event_id AS tokens, e.event_id IS NOT NULL AS ended, e.event_type <> 'error' AS success, CAST(round(e.value * 100) AS BIGINT) AS ms
      FROM v b LEFT JOIN v p ON p.event_id = b.event_id + 1 LEFT JOIN v e ON e.event_id = b.event_id + 2 AND e.k % 7 > 0 WHERE b.event_id % 3 = 0)
    SELECT CAST(call_id AS VARCHAR) AS call_id, stage, CASE WHEN ended THEN 'ended' WHEN start + 86400000 <= mark THEN 'aborted' ELSE 'running' END AS state,
      CASE WHEN ended THEN success WHEN start + 86400000 <= mark THEN false END AS success, tokens AS completion_tokens, ttft_ms,
      CASE WHEN ended THEN ms WHEN start + 86400000 <= mark THEN 86400000 END AS duration_ms FROM c, w""",
)
def st_call_states(spark, d):
    """Calls of three events each (begin, progress, end; some ends are missing) as a stream of states, the last state of each."""
    kind, none = F.col("event_id") % 3, F.lit(None)
    rows = _stream(spark, d).withColumn("k", F.from_json("props", "k bigint")["k"]).filter((kind < 2) | (F.col("k") % 7 > 0))
    log = rows.select(
        F.element_at(F.array(*map(F.lit, ("begin", "stream_progress", "end"))), (kind + 1).cast("int")).alias("event"), F.floor(F.col("event_id") / 3).cast("string").alias("call_id"), "ts", F.col("event_id").alias("pos"),
        F.when(kind == 0, F.col("event_type")).alias("stage"), F.when(kind == 2, F.col("event_type") != "error").alias("success"), none.cast("string").alias("error_class"),
        F.when(kind == 1, F.col("event_id")).alias("completion_tokens"), F.when(kind == 1, F.col("k")).alias("ttft_ms"), F.when(kind == 2, F.round(F.col("value") * 100).cast("long")).alias("duration_ms"),
        none.cast("string").alias("finish_reason"),
    )
    states = calls.latest(stream.caught_up(calls.call_states(log, "1 day", "10 days"), "update", stream.KEYED))
    return states.select("call_id", "stage", "state", "success", "completion_tokens", "ttft_ms", "duration_ms")
