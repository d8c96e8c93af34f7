"""Extracted items: validation, span resolution, salvage, grouping by topic."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .. import vocab
from ..session import python_map


def valid_items(df: DataFrame, item_type: Column, types: tuple = vocab.ITEM_TYPES, present: Column | None = None) -> DataFrame:
    """Rows whose type is known and whose text is there."""
    return df.filter(item_type.isin(*types) & (F.lit(True) if present is None else present))


def affects(column: Column, vocabulary: tuple) -> Column:
    """Known registers, lower-cased, each once, two at most."""
    return F.slice(F.array_intersect(F.array_distinct(F.transform(column, F.lower)), F.array(*map(F.lit, vocabulary))), 1, 2)


def coerced(column: Column, vocabulary: tuple, default: str) -> Column:
    return F.when(column.isin(*vocabulary), column).otherwise(default)


def relation_candidate(a: Column, b: Column, verb: Column, confidence: Column) -> Column:
    """A struct where both ends are there and differ, else null."""
    return F.when((F.trim(a) != "") & (F.trim(b) != "") & (F.lower(a) != F.lower(b)), F.struct(a.alias("from"), b.alias("to"), verb.alias("verb"), confidence.alias("confidence")))


def payload_outcome(payload: Column, key: str) -> Column:
    """What a reply is to its reader: `ok` with items under the key, `empty` with none, `parse_error` where it is no JSON object or the key holds no list."""
    items = F.get_json_object(payload, f"$.{key}")
    n = F.json_array_length(items)
    return F.when(F.json_object_keys(payload).isNull() | n.isNull(), "parse_error").when(n == 0, "empty").otherwise("ok")


def by_topic(df: DataFrame, order: list[str], topics: str = "topics") -> DataFrame:
    """A row for each topic of an item, with its index in the topic; items without topics vanish."""
    rows = df.withColumn("topic", F.explode(topics)).drop(topics)
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("topic").orderBy(*order)) - 1)


def dedup_first(df: DataFrame, key: str, idx: str) -> DataFrame:
    """The first row of each key with all indices of it; empty keys are dropped. Members are collected by key: a list of ids, no texts. Where a key may have
    very many, dedup_members() says the same in rows."""
    return df.filter(F.col(key) != "").groupBy(key).agg(F.min(idx).alias(idx), F.count("*").alias("copies"), F.sort_array(F.collect_list(idx)).alias("members")).drop(key)


def dedup_members(df: DataFrame, key: str, idx: str) -> DataFrame:
    """A row for each row with a key that is not empty: its index and the first one of its key. Only indices and digests of keys are shuffled, and each key's
    least index goes back to its rows by a join that AQE may split."""
    rows = df.filter(F.col(key) != "").select(idx, F.sha2(key, 256).alias("_key"))
    first = rows.groupBy("_key").agg(F.min(idx).alias("first"))
    return rows.join(first, "_key").select(idx, "first")


def large_topics(df: DataFrame, topic: list[str], least: int) -> DataFrame:
    return df.groupBy(*topic).agg(F.count("*").alias("facts")).filter(F.col("facts") >= least)


# What quotes are made alike, and the bounds of an approximate match.
_QUOTES = str.maketrans("\u2018\u2019\u201c\u201d", "''\"\"")
PREFIX_CHARS, LEAST_MATCH, LEAST_SHARE, APPROXIMATE_CHARS = 40, 12, 4, 200

#: Pairs of like places that are followed along their diagonals; texts with more, that repeat themselves, are compared row by row.
SEED_PAIRS = 1 << 22


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Source:
    """A text that quotes are looked up in; what is derived from it is derived once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def squeezed(self) -> tuple[str, list[int]]:
        """The text with plain quotes and single blanks, and for each of its characters the place in the original."""
        out, at, blank = [], [], True
        for i, c in enumerate(self.text.translate(_QUOTES)):
            if not c.isspace():
                out.append(c), at.append(i)
            elif not blank:
                out.append(" "), at.append(i)
            blank = c.isspace()
        return "".join(out), at

    @cached_property
    def codes(self) -> np.ndarray:
        return _codes(self.text)

    @cached_property
    def seeds(self) -> np.ndarray:
        return _seeds(self.codes)


def _seeds(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of LEAST_MATCH characters."""
    n = len(codes) - LEAST_MATCH + 1
    out = np.zeros(max(0, n), np.uint64)
    for k, f in enumerate(np.random.default_rng(7).integers(0, 1 << 63, LEAST_MATCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        out += codes[k : k + len(out)] * f
    return out


def longest_match(source: Source, quote: str) -> tuple[int, int] | None:
    """(place, size) of the longest run of LEAST_MATCH characters or more that the quote shares with the text: of equal ones the first in the text. Runs
    begin where both have a like seed; seeds of one diagonal that follow each other are one run, so the time is that of the text's length."""
    codes, own = source.codes, _codes(quote)
    mine = _seeds(own)
    if not len(mine) or not len(source.seeds):
        return None
    order = np.argsort(mine, kind="stable")
    ranked = mine[order]
    first, last = np.searchsorted(ranked, source.seeds), np.searchsorted(ranked, source.seeds, "right")
    n = last - first
    total = int(n.sum())
    if not total:
        return None
    if total <= SEED_PAIRS:
        at = np.repeat(np.arange(len(n)), n)
        inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        there = order[np.repeat(first, n) + inside]
        by = np.lexsort((at, at - there))
        at, there = at[by], there[by]
        starts = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(at - there) != 0)))
        sizes = np.diff(np.append(starts, total)) + LEAST_MATCH - 1
        best = min(zip((-sizes).tolist(), at[starts].tolist(), there[starts].tolist(), strict=True))
        size, a, b = -best[0], best[1], best[2]
        if np.array_equal(codes[a : a + size], own[b : b + size]):
            return a, size
    run, best = np.zeros(len(codes) + 1, np.int64), (0, 0)
    for c in own.tolist():
        run[1:] = np.where(codes == c, run[:-1] + 1, 0)
        size = int(run.max())
        best = min(best, (-size, int(run.argmax()) - size)) if size else best
    return (best[1], -best[0]) if -best[0] >= LEAST_MATCH else None


def resolve(source: Source | str, quote: str) -> tuple[int, int, bool] | None:
    """(start, end, approximate) of a quote: exact, then with white space and quotes made alike, then by its first PREFIX_CHARS
    characters, then by its longest match of a quarter of it or more."""
    source = Source(source) if isinstance(source, str) else source
    text = source.text
    if not quote.strip():
        return None
    if (i := text.find(quote)) >= 0:
        return i, i + len(quote), False
    q = " ".join(quote.translate(_QUOTES).split())
    if not q:
        return None
    squeezed, at = source.squeezed
    if (i := squeezed.find(q)) >= 0:
        return at[i], at[i + len(q) - 1] + 1, False
    if (head := quote[:PREFIX_CHARS].strip()) and (i := text.find(head)) >= 0:
        return i, min(len(text), i + len(quote)), False
    found = longest_match(source, quote)
    if found and found[1] >= max(LEAST_MATCH, len(quote) // LEAST_SHARE):
        return found[0], min(len(text), found[0] + max(found[1], min(len(quote), APPROXIMATE_CHARS))), True
    return None


def resolved_spans(df: DataFrame) -> DataFrame:
    """doc_id, quote, start_char, end_char, approximate of each quote in its text; nulls where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = Source("")
        for b in batches:
            found = []
            for t, q in zip(b["text"], b["quote"], strict=True):
                if source.text != (t or ""):  # quotes of one text come one after another
                    source = Source(t or "")
                found.append(resolve(source, q or "") or (None, None, None))
            out = pd.DataFrame(found, columns=["start_char", "end_char", "approximate"], dtype=object)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "quote": b["quote"].to_numpy()}).join(out)

    return python_map(df.select("doc_id", "text", "quote"), run, "doc_id long, quote string, start_char long, end_char long, approximate boolean")


def quoted_spans(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """resolved_spans() of quotes (doc_id, quote) in docs (doc_id, text)."""
    return resolved_spans(quotes.join(docs, "doc_id").select("doc_id", "text", "quote"))


def balanced(text: str) -> str | None:
    """A cut JSON text closed after its last whole element; None where nothing is whole."""
    stack, quoted, escaped, last = [], False, False, None
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            last = (i + 1, list(stack))
            if not stack:
                return text[: i + 1]
    return text[: last[0]] + "".join(reversed(last[1])) if last else None


def salvaged(df: DataFrame, column: str = "payload") -> DataFrame:
    """event_id, status (ok, salvaged, parse_error) and the number of items of each payload."""

    def items(text: str) -> tuple[str, int]:
        body = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
        text = (body[-1] if body else text).strip()
        for status, candidate in (("ok", text), ("salvaged", balanced(text))):
            try:
                value = json.loads(candidate)
            except (TypeError, ValueError):
                continue
            found = value.get("items", []) if isinstance(value, dict) else value
            return status, len(found) if isinstance(found, list) else 0
        return "parse_error", 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [items(x or "") for x in b[column]]
            yield pd.DataFrame({"event_id": b["event_id"], "status": [s for s, _ in found], "items": [n for _, n in found]})

    return df.select("event_id", column).mapInPandas(run, "event_id long, status string, items int")


@F.pandas_udf(StringType())
def folded_name(names: pd.Series) -> pd.Series:
    """The normalized name: compatibility decomposition without marks, lower case, non-word runs as one blank."""

    def one(name: str | None) -> str:
        text = "".join(c for c in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(c)).lower()
        return " ".join(re.sub(r"[^\w\s]", " ", text).split())

    return names.map(one)
