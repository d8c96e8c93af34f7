"""Calls as a stream: keyed state with timers, from begin over progress to the end, or to the time at which a call without one is given up.

A call's state is the fold of its events so far (operators.telemetry.folded says the same of a whole log): the first begin counts, of every later
field the value of the latest position, an end without a begin waits for it. Each change is emitted with a running version, so that the table of
all versions holds each call's history and `latest` its last word. A begin without an end is `aborted` when the watermark passes its start plus
the patience; an ended or aborted call is forgotten when the watermark passes that time again, so the state is bounded by what a patience holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Fields that progress and end carry; each keeps the position that it comes from.
FIELDS = ("success", "error_class", "completion_tokens", "ttft_ms", "duration_ms", "finish_reason")
STATES = "call_id string, stage string, state string, success boolean, error_class string, completion_tokens long, ttft_ms long, duration_ms long, finish_reason string, version long"


#: Buckets that calls are dealt to by hash. One entry of the state store and one timer serve all live calls of a bucket, so that the exchange with the store is paid
#: once a bucket and micro-batch, not for every call.
BUCKETS = 4096


def _row(call: str, s: dict) -> Row:
    return Row(call_id=call, stage=s["stage"], state=s["state"], **{f: s["fields"].get(f, (0, None))[1] for f in FIELDS}, version=s["version"])


class CallStates(StatefulProcessor):
    """The folds of a bucket's live calls as one value; each has the time at which it is due, and the bucket's timer is the first of these."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("calls", "folds string, timer long")

    def _stored(self) -> tuple[dict, int | None]:
        there = self.state.get()
        return (json.loads(there[0]), there[1]) if there is not None else ({}, None)

    def _store(self, folds: dict, timer: int | None) -> None:
        if not folds:
            self.state.clear()
            return
        due = min(s["due"] for s in folds.values())
        if timer is None or due < timer:  # a later one that is set finds nothing due and sets the next
            self.handle.registerTimer(due)
            timer = due
        self.state.update((json.dumps(folds), timer))

    def _fold(self, s: dict, rows: list[Row], watermark: int) -> bool:
        """Take up a call's events of this batch; whether its begin is known."""
        was = s["state"]
        newest = max(watermark, *(r.at_ms for r in rows))
        for r in sorted(rows, key=lambda r: r.pos):
            if r.event == "begin":
                if s["begin"] is None or r.pos < s["begin"]:
                    s |= {"begin": r.pos, "stage": r.stage, "start": r.at_ms}
                continue
            for f in FIELDS:
                if r[f] is not None and s["fields"].get(f, (-1, None))[0] <= r.pos:
                    s["fields"][f] = (r.pos, r[f])
            if r.event == "end":
                s["ended"] = True
        seen = s["begin"] is not None
        s["state"] = "waiting" if not seen else "ended" if s.get("ended") else was if was == "aborted" else "running"
        if seen and was == "waiting":
            s["due"] = max(s["start"] + self.patience, watermark + 1)
        elif not seen and s["version"] == 0:
            s["due"] = newest + self.patience
        s["version"] += 1
        return seen

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        folds, timer = self._stored()
        by: dict[str, list[Row]] = {}
        for r in rows:
            by.setdefault(r.call_id, []).append(r)
        for call, events in by.items():
            s = folds.setdefault(call, {"begin": None, "stage": None, "state": "waiting", "fields": {}, "version": 0, "start": None})
            if self._fold(s, events, timerValues.getCurrentWatermarkInMs()):
                yield _row(call, s)
        self._store(folds, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        folds, timer = self._stored()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for call in [c for c, s in folds.items() if s["due"] <= now]:
            s = folds[call]
            if s["state"] != "running":  # its last word is out, or its begin never came
                del folds[call]
                continue
            s["state"], s["version"] = "aborted", s["version"] + 1
            s["fields"] |= {"success": (s["begin"], False), "duration_ms": (s["begin"], max(0, s["due"] - s["start"]))}
            s["due"] += self.patience
            yield _row(call, s)
        self._store(folds, timer if timer is not None and timer > now else None)


def call_states(events: DataFrame, patience: str = "1 day", late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The versions of the calls' states as a stream in update mode; events: event (begin, stream_progress, end), call_id, ts, pos, stage and FIELDS. The number of
    buckets belongs to a stream's checkpoint; a bucket is read and written whole when one of its calls has an event."""
    spark = events.sparkSession
    ms = int(spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP_SECONDS(0) + INTERVAL {patience}) AS BIGINT) AS ms").head()["ms"])
    timed = events.filter("call_id IS NOT NULL").select("event", "call_id", F.col("ts").cast("timestamp"), F.col("pos").cast("long"), "stage", *FIELDS).withWatermark("ts", late)
    timed = timed.withColumn("at_ms", F.unix_millis("ts")).withColumn("bucket", F.pmod(F.xxhash64("call_id"), F.lit(buckets)))
    return timed.groupBy("bucket").transformWithState(CallStates(ms), STATES, "update", "EventTime")


def latest(versions: DataFrame) -> DataFrame:
    """The last state of each call."""
    columns = [c for c in versions.columns if c != "call_id"]
    return versions.groupBy("call_id").agg(F.max_by(F.struct(*columns), "version").alias("s")).select("call_id", *[f"s.{c}" for c in columns if c in STATES])
