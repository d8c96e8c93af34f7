"""The model boundary: cache, status and retry ladders around a provider that maps prompts to payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, python_map

LOAD_ERRORS = ("ConnectionError", "RateLimitError", "ServiceUnavailable", "InternalServerError", "APIConnectionError")
SIZING = ("CAP_HIT", "PARSE_ERROR", "TIMEOUT_WITH_TOKENS")
MOST_HALVES, MOST_LOAD = 5, 5


def status() -> Column:
    """The status of a call by error_class, message, duration, ttft, completion_tokens, max_tokens and payload."""
    c = F.col
    timeout = F.when(c("duration").isNull(), "OTHER").when(c("ttft").isNull(), "LOAD").when(c("ttft") > 0.5 * c("duration"), "LOAD").otherwise("TIMEOUT_WITH_TOKENS")
    limit = F.lower(F.coalesce("message", F.lit(""))).rlike("context length|token limit|maximum.*tokens")
    failed = F.when(c("error_class").isin(*LOAD_ERRORS), "LOAD").when(c("error_class").contains("Timeout"), timeout).when(limit, "CAP_HIT").when(c("completion_tokens") >= c("max_tokens"), "CAP_HIT").otherwise("OTHER")
    return F.when(c("error_class").isNotNull(), failed).when(F.coalesce(F.trim("payload"), F.lit("")) == "", "LOAD").otherwise("OK")


def retry(status_: Column, load: Column, sizing: Column, other: Column) -> Column:
    """What follows a status, given the earlier attempts of its family: stop, retry, reasoning_off, fallback or halve."""
    return (
        F.when(status_ == "OK", "stop")
        .when(status_ == "LOAD", F.when(load >= MOST_LOAD, "stop").when(load >= 3, "fallback").when(load >= 1, "reasoning_off").otherwise("retry"))
        .when(status_.isin(*SIZING), F.when(sizing >= MOST_HALVES, "stop").otherwise("halve"))
        .otherwise(F.when(other >= 2, "stop").when(other >= 1, "fallback").otherwise("retry"))
    )


def through_cache(calls: DataFrame, cache: DataFrame, days: int = 30, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): calls that a cache entry no older than days answers, and the others."""
    fresh = cache.filter(F.col("stored_at") >= F.current_timestamp() - F.make_dt_interval(F.lit(days)))
    return calls.join(fresh, key), calls.join(fresh, key, "left_anti")


def stub_provider(calls: pd.DataFrame) -> list[dict]:
    """A reply for each call by a hash of its prompt: deterministic; long prompts may meet a token limit, short ones are answered."""
    out = []
    for p in calls["prompt"]:
        h = hashlib.sha256(p.encode()).digest()[0]
        out.append({"error_class": "ValueError", "message": "token limit"} if len(p) > 1500 and h < 200 else {"payload": f'{{"items": [{h}]}}'})
    return out


#: What a provider says of a call; what it leaves out is null.
REPLY = "payload string, error_class string, message string, duration double, ttft double, completion_tokens long, max_tokens long"
STATE = "call_id string, root_id string, prompt string, attempt int, load int, sizing int, other int, thinking boolean, fallback boolean, last string, parent string"
#: Most rounds of a call: all its halvings, retries of load and other retries.
ROUNDS = MOST_HALVES + MOST_LOAD + 3


def run_ladder(calls: DataFrame, provider: Callable[[pd.DataFrame], list[dict]], rounds: int = ROUNDS) -> DataFrame:
    """Run calls (call_id, prompt) until each has ended: call_id, root_id, status, attempt and payload of every final call."""
    return logged_ladder(calls, provider, rounds)[0]


def attempt_events(asked: DataFrame, stage: str) -> DataFrame:
    """A begin and an end for each attempt of a round. They are named by call and attempt, so a round that runs again says the same once more and nothing else."""
    c = F.col
    own = F.concat("call_id", F.lit("#"), c("attempt").cast("string"))
    label = F.concat(F.lit(stage), F.when(c("last") == "halve", "/half").when(c("last") == "", "").otherwise(F.concat(F.lit("/"), F.replace(c("last"), F.lit("_"), F.lit("-")))))
    none = lambda kind: F.lit(None).cast(kind)
    common = [own.alias("call_id"), F.lit(stage).alias("stage"), label.alias("category"), "root_id"]
    begin = asked.select(F.lit("begin").alias("event"), *common, (2 * c("attempt")).cast("long").alias("pos"), c("parent").alias("retry_of_call_id"), none("boolean").alias("success"), none("string").alias("error_class"), none("string").alias("message"), none("long").alias("duration_ms"), none("long").alias("completion_tokens"), none("string").alias("finish_reason"), none("string").alias("llm_status"))
    finish = F.when(c("completion_tokens") >= c("max_tokens"), "length").otherwise("stop")
    end = asked.select(F.lit("end").alias("event"), *common, (2 * c("attempt") + 1).cast("long").alias("pos"), none("string").alias("retry_of_call_id"), (c("status") == "OK").alias("success"), "error_class", "message", (c("duration") * 1000).cast("long").alias("duration_ms"), "completion_tokens", finish.alias("finish_reason"), c("status").alias("llm_status"))
    return begin.unionByName(end)


def logged_ladder(calls: DataFrame, provider: Callable[[pd.DataFrame], list[dict]], rounds: int = ROUNDS, stage: str = "call") -> tuple[DataFrame, DataFrame]:
    """run_ladder() and the events of all attempts (operators.telemetry.folded reads them), from the same checkpoints.

    A round is one job over the calls that are pending: the provider is asked, status() judges and retry() decides. A call goes on as
    it is, without reasoning, with the fallback model, or as its two halves; halves keep their family's counts. A good reply after
    reasoning was off or the model fell back says so in its status. Each round is checkpointed, so a lost executor repeats one round."""
    names = [f.split()[0] for f in STATE.split(", ")]
    replies = [f.split()[0] for f in REPLY.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame(provider(b), index=b.index, dtype=object).reindex(columns=replies)
            got = got.astype(object).where(got.notna(), None)
            yield pd.concat([b[names], got.astype({"duration": float, "ttft": float, "completion_tokens": "Int64", "max_tokens": "Int64"})], axis=1)

    c = F.col
    zero = F.lit(0)
    pending = calls.select("call_id", c("call_id").alias("root_id"), "prompt", zero.alias("attempt"), zero.alias("load"), zero.alias("sizing"), zero.alias("other"), F.lit(True).alias("thinking"), F.lit(False).alias("fallback"), F.lit("").alias("last"), F.lit(None).cast("string").alias("parent"))
    done, events = None, None
    for left in range(rounds, -1, -1):
        asked = python_map(pending, ask, f"{STATE}, {REPLY}").withColumn("status", status())
        asked = asked.withColumn("next", retry(c("status"), c("load"), c("sizing"), c("other")))
        blocked = (c("next") == "halve") & (F.length("prompt") < 2)  # nothing to divide
        asked = checkpointed(asked.withColumn("next", F.when(blocked | F.lit(left == 0), "stop").otherwise(c("next"))))
        log = attempt_events(asked, stage)
        events = log if events is None else events.unionByName(log)
        good = F.when((c("status") == "OK") & (c("last") == "reasoning_off"), "SUCCESS_REASONING_OFF").when((c("status") == "OK") & (c("last") == "fallback"), "SUCCESS_MODEL_FALLBACK").otherwise(c("status"))
        ended = asked.filter("next = 'stop'").select("call_id", "root_id", good.alias("status"), "attempt", "payload")
        done = ended if done is None else done.unionByName(ended)
        half = F.floor(F.length("prompt") / 2).cast("int")
        part = lambda k, text: F.struct(F.concat("call_id", F.lit(k)).alias("id"), text.alias("p"))
        halves = F.array(part("/a", F.substring("prompt", F.lit(1), half)), part("/b", F.substring("prompt", half + 1, F.length("prompt"))))
        again = asked.filter("next <> 'stop'").withColumn("x", F.explode(F.when(c("next") == "halve", halves).otherwise(F.array(part("", c("prompt"))))))
        count = lambda name, test: (c(name) + test.cast("int")).alias(name)
        pending = again.select(
            c("x.id").alias("call_id"), "root_id", c("x.p").alias("prompt"), (c("attempt") + 1).alias("attempt"), count("load", c("status") == "LOAD"), count("sizing", c("status").isin(*SIZING)),
            count("other", c("status") == "OTHER"), (c("thinking") & (c("next") != "reasoning_off")).alias("thinking"), (c("fallback") | (c("next") == "fallback")).alias("fallback"), c("next").alias("last"),
            F.concat("call_id", F.lit("#"), c("attempt").cast("string")).alias("parent"),
        )
        if pending.isEmpty():
            break
    return done, events
