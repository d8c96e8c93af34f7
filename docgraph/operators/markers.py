"""Markers of runs and chat turns: closed-vocabulary telemetry, summaries of calls, routing of stages to models, guards and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .display import duration, grouped_number

# The form of time stamps and ids that may stand in a marker, the stages, and caps of a chat turn by mode.
ISO_Z = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"
ID_FORMS = {"call_id": r"^\d{4,}$", "retry_of_call_id": r"^\d{4,}$", "bound_run": r"^[a-z0-9]{4}$", "session_id": r"^[0-9a-f]{16}$"}
STAGES = ("extract", "entities", "entities_dedupe", "patterns", "insights", "actions")
TURN_CAPS = {"cloud": (15, 20, 3, 240), "local": (10, 15, 2, 120)}


def free_leaves(schema: T.StructType, words: list[str]) -> Column:
    """How many string leaves of a row are no time stamp, no word of the vocabulary and no id in an id field."""

    def leaf(value: Column, name: str) -> Column:
        fine = value.isNull() | value.rlike(ISO_Z) | value.isin(*words)
        return (~(fine | value.rlike(ID_FORMS[name]) if name in ID_FORMS else fine)).cast("int")

    def count(value: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType):
            return leaf(value, name)
        if isinstance(kind, T.StructType):
            return sum((count(value[f.name], f.dataType, f.name) for f in kind.fields), F.lit(0))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(0), lambda acc, x: acc + count(x, kind.elementType, name)), F.lit(0))
        return F.lit(1 if isinstance(kind, (T.MapType, T.BinaryType)) else 0)

    return sum((count(F.col(f.name), f.dataType, f.name) for f in schema.fields), F.lit(0))


def content_free(markers: DataFrame, words: list[str]) -> DataFrame:
    """markers, read only as long as none of them holds free text."""
    n = free_leaves(markers.schema, words)
    return markers.filter(F.when(n > 0, F.raise_error(F.lit("a marker holds free text")).cast("boolean")).otherwise(F.lit(True)))


def calls_block(calls: DataFrame, since: int, group: list[str] | None = None) -> DataFrame:
    """Calls after a call id: how many, their tokens and their time; by group where one is given."""
    after = calls.filter(F.col("call_id") > since)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = after.groupBy(*(group or [])).agg(
        F.count("*").alias("calls"), zero("prompt_tokens").cast("long").alias("prompt_tokens"), zero("completion_tokens").cast("long").alias("completion_tokens"), zero("duration_ms").cast("double").alias("wall_ms"),
    )
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def with_payloads(calls: DataFrame, payloads: DataFrame) -> DataFrame:
    """calls with the prompt and response of the side file, null where there is none; the latest of several."""
    last = payloads.groupBy("call_id").agg(F.max_by(F.struct("full_prompt", "full_response"), "pos").alias("p"))
    return calls.join(last, "call_id", "left").select(*calls.columns, "p.full_prompt", "p.full_response")


def live_counts(events: DataFrame) -> DataFrame:
    """call_id, tokens and state of every call that began: the largest count reported so far, or that of its end."""
    of = lambda kind, c: F.when(F.col("event") == kind, F.col(c))
    rows = events.groupBy("call_id").agg(
        F.count_if(F.col("event") == "begin").alias("_begun"), F.max(of("stream_progress", "tokens")).alias("_seen"), F.max(of("end", "tokens")).alias("_total"),
        F.count_if(F.col("event") == "end").alias("_ended"), F.min(of("stream_progress", "ttft_ms")).alias("ttft_ms"),
    )
    rows = rows.filter("_begun > 0")
    return rows.select("call_id", F.coalesce("_total", "_seen", F.lit(0).cast("long")).alias("tokens"), F.when(F.col("_ended") > 0, "ended").otherwise("running").alias("state"), "ttft_ms")


def cycles(events: DataFrame, run: str) -> DataFrame:
    """How many cycles each run began, one at least."""
    return events.groupBy(run).agg(F.greatest(F.lit(1), F.count_if(F.col("event") == "cycle_start")).cast("long").alias("cycles"))


def resume_point(stages: DataFrame, run: str, position: str, done: str) -> DataFrame:
    """The stage after which a run goes on: the last one that, as all before it, has its marker; null where the first has none."""
    gap = F.min(F.when(~F.col(done), F.col(position))).over(Window.partitionBy(run))
    return stages.withColumn("_gap", gap).groupBy(run).agg(F.max(F.when(F.col("_gap").isNull() | (F.col(position) < F.col("_gap")), F.col(position))).alias("resume_after"))


def tracker(events: DataFrame, stage: str) -> DataFrame:
    """Per stage: calls expected (the estimate raised to what began), begun, completed, failed (a failed end does not complete) and running."""
    begun, ended = F.count_if(F.col("event") == "begin"), F.count_if(F.col("event") == "end")
    good = F.count_if((F.col("event") == "end") & F.col("success"))
    rows = events.groupBy(stage).agg(begun.alias("begun"), good.alias("completed"), (ended - good).alias("failed"), F.coalesce(F.max("estimate"), F.lit(0)).cast("long").alias("_estimate"))
    return rows.select(stage, F.greatest("_estimate", "begun").alias("expected"), "begun", "completed", "failed", (F.col("begun") - F.col("completed") - F.col("failed")).alias("running"))


def replayed(calls: DataFrame, run: list[str], order: list[str], seconds: str) -> DataFrame:
    """Back-test of the remaining time of a finished run: at each call, the mean so far times the calls left against what was left indeed."""
    w = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*run)
    left = F.count("*").over(whole) - F.count("*").over(w)
    actual = F.sum(seconds).over(whole) - F.sum(seconds).over(w)
    return calls.withColumns({"calls_left": left, "predicted": F.avg(seconds).over(w) * left, "actual": actual})


def stage_models(config: DataFrame, default: str) -> DataFrame:
    """(stage, model) for every stage: its own model, else the one set for all, else the default. config: (stage or '*', model)."""
    spark = config.sparkSession
    stages = spark.range(1).select(F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    every = config.filter("stage = '*'").agg(F.max("model").alias("m")).scalar()
    return stages.join(F.broadcast(config.filter("stage <> '*'").groupBy("stage").agg(F.max("model").alias("own"))), "stage", "left").select("stage", F.coalesce("own", every, F.lit(default)).alias("model"))


def round_robin(calls: DataFrame, group: list[str], order: list[str], models: list[str]) -> DataFrame:
    """calls with the model that is next in turn within the group."""
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return calls.withColumn("model", F.element_at(F.array(*map(F.lit, models)), F.pmod(nth, F.lit(len(models))) + 1))


def report(stats: DataFrame, stage: str) -> DataFrame:
    """A line of text for each stage's calls, tokens and time."""
    line = F.concat_ws("  ", F.rpad(stage, 16, " "), F.concat(F.lit("calls "), grouped_number(F.col("calls"))), F.concat(F.lit("tokens "), grouped_number(F.col("total_tokens"))), F.concat(F.lit("time "), duration(F.col("wall_ms"))))
    return stats.select(stage, line.alias("line"))


def needs_embedding(docs: DataFrame, chunks: DataFrame, run: str) -> DataFrame:
    """Whether each run's documents hold text while its store has no chunks, so that embeddings have to be made again."""
    text = docs.groupBy(run).agg(F.max(F.length(F.trim("text")) > 0).alias("_text"))
    stored = chunks.groupBy(run).agg(F.count("*").alias("chunks"))
    return text.join(stored, run, "left").select(run, F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), (F.col("_text") & (F.coalesce("chunks", F.lit(0)) == 0)).alias("again"))


def newest_store(runs: DataFrame, created: str, path: str, records: str) -> DataFrame:
    """One row: the path of the newest run whose store holds any record."""
    return runs.filter(F.col(records) > 0).agg(F.max_by(path, F.struct(created, path)).alias(path))


def turn_caps(mode: Column) -> dict[str, Column]:
    """k, most results, lookups of a call and records of a turn, by mode; an unknown mode has those of cloud."""
    names = ("k", "most", "lookups", "accumulated")
    return {n: F.when(mode == "local", TURN_CAPS["local"][i]).otherwise(TURN_CAPS["cloud"][i]) for i, n in enumerate(names)}


def lookup_diagnostics(lookups: DataFrame, vector: str = "embedding") -> DataFrame:
    """Of each lookup what a log may say: lengths, filters and the norm of its query vector, none of its text."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return lookups.select("lookup", F.length("query").alias("query_chars"), F.size("kinds").alias("kinds"), F.size(vector).alias("dim"), F.round(norm, 4).alias("norm"))
