"""Call telemetry: the fold of an event log, outcomes, retry chains, rollups and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import vocab

# The labels of outcomes.
LABELS = {
    "cap_hit": "cap_hit (sizing)", "parse_error": "parse_error (sizing)", "empty": "empty_response (load)", "interrupted_sizing": "interrupted (sizing)",
    "interrupted_load": "interrupted (load)", "timeout_sizing": "timeout (sizing)", "timeout_load": "timeout (load)",
}
EVENT = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("event", T.StringType()), ("call_id", T.StringType()), ("stage", T.StringType()), ("category", T.StringType()), ("model", T.StringType()), ("ts", T.TimestampType()),
        ("success", T.BooleanType()), ("error_class", T.StringType()), ("message", T.StringType()), ("duration_ms", T.LongType()), ("completion_tokens", T.LongType()),
        ("finish_reason", T.StringType()), ("llm_status", T.StringType()), ("parse_error", T.BooleanType()), ("empty_response", T.BooleanType()), ("interrupted", T.BooleanType()),
        ("retry_of_call_id", T.StringType()), ("output", T.StringType()), ("pos", T.LongType()),
    )]
)


def folded(events: DataFrame, order: str = "pos") -> DataFrame:
    """One row a call: the first begin, then for each later field its last value. Ends without a begin are left out; a begin
    without an end is aborted."""
    begin = F.col("event") == "begin"
    first = lambda c: F.min_by(F.when(begin, F.col(c)), F.when(begin, F.col(order))).alias(c)
    last = lambda c: F.max_by(F.col(c), F.when(~begin & F.col(c).isNotNull(), F.col(order))).alias(c)
    given = [c for c in ("stage", "category", "model", "retry_of_call_id") if c in events.columns]
    later = [c for c in ("success", "error_class", "message", "duration_ms", "completion_tokens", "finish_reason", "llm_status", "parse_error", "empty_response", "interrupted", "output") if c in events.columns]
    out = events.groupBy("call_id").agg(
        F.bool_or(begin).alias("_begun"), (~F.bool_or(F.col("event") == "end")).alias("aborted"), F.min(F.when(begin, F.col(order))).alias("first_pos"),
        *[first(c) for c in given], *[last(c) for c in later],
    )
    return out.filter("_begun").drop("_begun")


def failure_bucket(status: Column) -> Column:
    return F.when(status == "LOAD", "load").when(status.isin("CAP_HIT", "PARSE_ERROR", "TIMEOUT_WITH_TOKENS"), "sizing").otherwise("other")


def zero_sized(output: Column) -> Column:
    """Whether the first integer value of a flat JSON object, in the order it was written, is 0."""
    first = F.regexp_extract(output, r'"[^"]*"\s*:\s*(-?\d+)\s*[,}]', 1)
    return F.coalesce(first == "0", F.lit(False))


def outcome(c=F.col) -> Column:
    """The label of a folded call; the first that holds."""
    said = lambda w: F.coalesce(c("message").contains(w), F.lit(False))
    flag = lambda n: F.coalesce(c(n), F.lit(False))
    cls, bucket = F.coalesce(c("error_class"), F.lit("")), failure_bucket(c("llm_status"))
    length = F.coalesce(c("finish_reason") == "length", F.lit(False))
    timeout = F.lower(F.concat(cls, F.lit(" "), F.coalesce(c("message"), F.lit("")))).rlike("timeout|timed out")
    failed = (
        F.when(cls.endswith("_CapHitResponse") | length, LABELS["cap_hit"]).when(flag("parse_error") | said("parse_error"), LABELS["parse_error"])
        .when(flag("empty_response") | said("empty_response"), LABELS["empty"])
        .when(flag("interrupted") | said("interrupted"), F.when(bucket == "sizing", LABELS["interrupted_sizing"]).otherwise(LABELS["interrupted_load"]))
        .when(cls.endswith("_SuccessEmpty") | said("success_empty"), "success_empty")
        .when(timeout, F.when(bucket == "sizing", LABELS["timeout_sizing"]).otherwise(LABELS["timeout_load"]))
        .otherwise(F.concat(F.lit("failed ("), bucket, F.lit(")")))
    )
    good = F.when(length, LABELS["cap_hit"]).when(flag("parse_error"), LABELS["parse_error"]).when(flag("empty_response"), LABELS["empty"]).when(zero_sized(c("output")), "success_empty").otherwise("success")
    bad = c("error_class").isNotNull() | ~F.coalesce(c("success"), F.lit(False))
    return F.when(flag("aborted"), "aborted").when(bad, failed).otherwise(good)


def leaves(calls: DataFrame) -> DataFrame:
    """Calls that no other call retries."""
    parents = calls.select(F.col("retry_of_call_id").alias("call_id")).filter("call_id IS NOT NULL").distinct()
    return calls.join(parents, "call_id", "left_anti")


def chains(calls: DataFrame, hops: int = 64) -> DataFrame:
    """(call_id, root, depth, sampled, reasoning_off) of every call: the walk to its root, by doubling, so 64 hops take 6 joins. A
    call in a cycle is its own root."""
    cat = F.coalesce("category", F.lit(""))
    at = calls.select("call_id", F.col("retry_of_call_id").alias("up"), F.lit(0).alias("depth"), cat.contains("/sample-").alias("sampled"), cat.contains("/reasoning-off").alias("off"))
    known = at.select(F.col("call_id").alias("_k")).distinct()
    at = at.join(known, at["up"] == known["_k"], "left").withColumn("up", F.col("_k")).drop("_k")
    at = at.select("call_id", F.coalesce("up", "call_id").alias("root"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"), "sampled", "off")
    span = 1
    while span < hops:
        far = at.select(F.col("call_id").alias("_c"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("sampled").alias("_s"), F.col("off").alias("_o"))
        at = at.join(far, at["root"] == far["_c"], "left").select("call_id", F.col("_root").alias("root"), F.when(F.col("root") == F.col("call_id"), F.col("depth")).otherwise(F.col("depth") + F.col("_depth")).alias("depth"), (F.col("sampled") | F.col("_s")).alias("sampled"), (F.col("off") | F.col("_o")).alias("off"))
        span *= 2
    return at.select("call_id", F.when(F.col("depth") > hops, F.col("call_id")).otherwise(F.col("root")).alias("root"), "depth", "sampled", F.col("off").alias("reasoning_off"))


def chain_aware(calls: DataFrame) -> DataFrame:
    """Successful leaves whose chain sampled or switched reasoning off say so; sampling outranks."""
    last = leaves(calls).select("call_id", F.lit(True).alias("_leaf"))
    rows = calls.join(chains(calls).select("call_id", "sampled", "reasoning_off"), "call_id").join(last, "call_id", "left")
    hit = F.coalesce("_leaf", F.lit(False)) & (F.col("outcome") == "success")
    label = F.when(hit & F.col("sampled"), "success_sampled").when(hit & F.col("reasoning_off"), "success_reasoning_off").otherwise(F.col("outcome"))
    return rows.withColumn("outcome", label).drop("sampled", "reasoning_off", "_leaf")


def rollup(calls: DataFrame) -> DataFrame:
    """Calls, successes and tokens in all, by stage and by model, in one pass over grouping sets."""
    calls.createOrReplaceTempView("_calls_rollup")
    return calls.sparkSession.sql(
        """SELECT CASE WHEN grouping(stage) = 0 THEN 'stage' WHEN grouping(model) = 0 THEN 'model' ELSE 'all' END AS scope, coalesce(stage, CAST(model AS STRING), '') AS name,
        count(*) AS calls, count_if(success) AS successes, sum(tokens) AS tokens FROM _calls_rollup GROUP BY GROUPING SETS ((), (stage), (model))"""
    )


def categories_lost(calls: DataFrame) -> DataFrame:
    """By stage, how many categories have no success."""
    by = calls.groupBy("stage", "category").agg(F.bool_or("success").alias("ok"))
    return by.groupBy("stage").agg(F.count_if(~F.col("ok")).alias("lost"), F.count("*").alias("categories"))


def size_histogram(df: DataFrame, value: str, edges: tuple = vocab.SIZE_EDGES) -> DataFrame:
    """Counts in fixed buckets, empty ones too."""
    spark = df.sparkSession
    bucket = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        bucket = F.when(F.col(value) < edges[i + 1], i).otherwise(bucket)
    by = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    dim = spark.range(len(edges)).select(F.col("id").cast("int").alias("bucket"), F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("id").cast("int") + 1).alias("from_size"))
    return dim.join(by, "bucket", "left").select("bucket", "from_size", F.coalesce("n", F.lit(0)).alias("n"))


def coefficients(samples: DataFrame, group: str, duration: str, tokens: str) -> DataFrame:
    """Seconds a token (median rate), fixed seconds a call (median of what is left, not below 0) and median tokens."""
    rows = samples.filter(F.col(tokens) > 0)
    rate = rows.groupBy(group).agg(F.median(F.col(duration) / F.col(tokens)).alias("per_token"), F.floor(F.median(tokens)).alias("median_tokens"))
    rest = rows.join(rate, group).withColumn("_r", F.greatest(F.lit(0.0), F.col(duration) - F.col("per_token") * F.col(tokens)))
    return rest.groupBy(group).agg(F.first("per_token").alias("per_token"), F.median("_r").alias("fixed"), F.first("median_tokens").alias("median_tokens"))


def blended(live: Column, history: Column, done: Column, expected: Column) -> Column:
    """Seconds a call: live clamped to 0.3 to 3 times history, weighed by the share of calls that are done."""
    weight = F.when(live.isNull() | (expected <= 0), 0.0).otherwise(F.least(F.lit(1.0), done / expected))
    held = F.least(3.0 * history, F.greatest(0.3 * history, F.coalesce(live, history)))
    return weight * held + (1 - weight) * history


def remaining_seconds(left: Column, parallel: Column, per_call: Column) -> Column:
    return left / parallel * per_call * F.when(parallel > 1, 2.0).otherwise(1.0)


def first_median_last(df: DataFrame, group: list[str], order: list[str], failed: Column) -> DataFrame:
    """The first, the middle and the last call of each group, and all failed ones."""
    w = Window.partitionBy(*group)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return rows.filter((F.col("_r") == 1) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1) | (F.col("_r") == F.col("_n")) | failed).drop("_r", "_n")


def stage_token(stage: Column, known: list[str]) -> Column:
    """A stage's name without its number; unknown ones are `other`."""
    bare = F.regexp_replace(F.lower(stage), r"^\d+[-_]", "")
    return F.when(bare.isin(*known), bare).otherwise("other")


def pre_estimate(files: Column, total_bytes: Column, cap: int, topics: int, images: Column) -> dict[str, Column]:
    """Calls by stage before a run, from file counts and sizes alone."""
    tokens = F.floor(total_bytes / vocab.CHARS_PER_TOKEN)
    extract = F.greatest(F.lit(1), files, F.ceil(tokens / cap))
    facts = F.greatest(F.lit(1), F.floor(F.floor(tokens * 0.5) / 80))
    groups = F.greatest(F.lit(1), F.floor(facts / 5))
    entities = F.greatest(F.lit(2), F.ceil(F.sqrt(groups)))
    return {"vision": images, "extract": extract, "entities": entities, "entities_dedupe": F.lit(1), "patterns": F.lit(topics), "insights": F.lit(1), "actions": F.lit(1), "embeddings": F.lit(1)}
