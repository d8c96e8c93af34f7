"""A chat turn: a model asks for lookups until it answers. Every lookup is one job; what stays on the driver is bounded by the caps of a turn."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import search

# Lookups of a turn, replies that may fail to parse before an answer is forced, records that a turn keeps.
MOST_HOPS, PARSE_RETRIES, ACCUMULATED = 4, 2, 240
MALFORMED = "The last tool call was no valid JSON."


@dataclass
class Turn:
    answer: str = ""
    hops: int = 0
    retrieved: list[tuple[str, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def run(question: str, records: DataFrame, edges: DataFrame, ask: Callable[[str, list[tuple[str, str]], list[str], bool], str | dict], cap: int = ACCUMULATED) -> Turn:
    """ask(question, retrieved, notes, final) gives a tool call as a dict, an answer as text, or "{.." that is no JSON. After the last hop, or
    too many replies that are no JSON, it is asked for the final answer. A record counts once, where it came first; an empty question is not asked."""
    turn = Turn()
    if not question.strip():
        return turn
    failures, seen = 0, set()
    while True:
        final = turn.hops >= MOST_HOPS or failures >= PARSE_RETRIES
        reply = ask(question, turn.retrieved, turn.notes, final)
        if isinstance(reply, dict) and not final:
            call = search.tool_call(reply)
            turn.notes += call.dropped
            turn.hops += 1
            for row in search.run(call, records, edges).collect():  # as many as a union of lookups keeps
                key = (row["kind"], row["record_id"])
                if key not in seen and len(turn.retrieved) < cap:
                    seen.add(key)
                    turn.retrieved.append(key)
        elif isinstance(reply, str) and reply.lstrip().startswith("{") and not final:
            failures += 1
            turn.notes.append(MALFORMED)
        else:
            turn.answer = reply if isinstance(reply, str) else ""
            return turn
