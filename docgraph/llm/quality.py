"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit and its measurements are kept; policies are masks.

ledger() reads each text once and gives the measurements of each row and the bits of the rules that it fails. A policy is a named and
versioned set of rules: what it removes is (failed & mask) <> 0, so that a new version costs a scan of the ledger and none of the texts.
ablation() says what each rule of a policy does alone, beside the others and without them, from counts of the distinct bit patterns.

A text's words are the maximal runs of other characters than space and U+0009 to U+000D, with their case. Null and empty texts have no
words, and fail `few_words`. Repeated rows, repeated and null doc_ids are rows like others: each is judged by its own text alone. Texts
of any length are whole. An empty table has an empty ledger. Other columns do not matter to ledger(); filtered() keeps them all, those
that are called like a measurement too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fresh
from .words import _tables, shingle_hashes, span_hashes, spans, text_bytes

#: What is measured: long numbers of the whole text.
MEASURES = {
    "n_words": "words",
    "word_chars": "code points in words",
    "n_symbols": "characters of [#*$%&|<>]",
    "n_dup_lines": "lines with a word that are equal to an earlier one",
    "n_repeat_words": "words in windows of five words that the text has twice or more",
    "n_chars": "code points",
    "n_lines": "lines with a word",
    "n_upper": "characters of [A-Z]",
    "n_digits": "characters of [0-9]",
    "n_letter_words": "words with a character of [A-Za-z] or beyond U+007F",
    "n_bullet_lines": "lines whose first word begins with -, * or U+2022",
    "n_open_lines": "lines whose last word ends with ... or U+2026",
    "longest_word": "code points of the longest word",
    "n_stutters": "words equal to the word before",
}

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """bit: its place in the ledger, for good (a withdrawn rule's bit is not given again). fails: a SQL condition over the measurements in
    whole numbers, so that engines agree on it."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "many_words", "n_words > 1000000"),
    Rule(3, "short_words", "10 * word_chars < 15 * n_words"),
    Rule(4, "long_words", "word_chars > 15 * n_words"),
    Rule(5, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(6, "repeated_lines", "n_lines > 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(7, "upper_case", "100 * n_upper > 40 * n_chars"),
    Rule(8, "digits", "100 * n_digits > 30 * n_chars"),
    Rule(9, "no_letters", "100 * n_letter_words < 70 * n_words"),
    Rule(10, "bullets", "n_lines > 4 AND 100 * n_bullet_lines > 90 * n_lines"),
    Rule(11, "open_lines", "n_lines > 4 AND 100 * n_open_lines > 30 * n_lines"),
    Rule(12, "endless_word", "longest_word > 1000"),
    Rule(13, "stutters", "100 * n_stutters > 30 * n_words"),
)

#: The rules of the base, which every policy holds.
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Rows that fail any of the rules go. version: what a corpus was filtered by can be told from it."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return reduce(lambda m, name: m | 1 << bits[name], self.rules, 0)

    @property
    def label(self) -> str:
        return f"{self.name}@{self.version}"


POLICIES = {
    p.label: p
    for p in (
        Policy("prose", 1, BASE),
        Policy("prose", 2, (*BASE, "symbols", "upper_case", "repeated_lines", "digits", "no_letters", "stutters")),
        Policy("strict", 1, tuple(r.name for r in RULES)),
    )
}
PRODUCTION = POLICIES["prose@2"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _sums(mask: np.ndarray, begin: np.ndarray, empty: np.ndarray | None = None) -> np.ndarray:
    """Counts of mask from each begin to the next one; empty says where there is nothing to count."""
    if not len(begin):
        return np.zeros(0, np.int64)
    out = np.add.reduceat(np.append(mask, False).view(np.uint8), begin, dtype=np.int64)
    if empty is not None:
        out[empty] = 0
    return out


def _inside(values: np.ndarray, offs: np.ndarray, of) -> np.ndarray:
    """of(values of a text) by text, 0 where there are none."""
    return np.array([of(values[a:b]) if b > a else 0 for a, b in zip(offs[:-1], offs[1:], strict=True)], np.int64)


def _repeated(runs: np.ndarray) -> int:
    """Words that lie in runs of WINDOW words seen twice or more."""
    _, back, n = np.unique(runs, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[back] > 1)
    if not len(twice):
        return 0
    step = np.zeros(len(runs) + WINDOW, np.int32)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text of an Arrow column of strings."""
    data, offs = text_bytes(column)
    empty = offs[1:] == offs[:-1]
    per_text = lambda mask: _sums(mask, offs[:-1], empty)
    gap, begins = _tables()[0][data], (data & 0xC0) != 0x80  # a code point's first byte
    begin, end = spans(gap, offs)
    words = np.searchsorted(begin, offs)
    hashes = span_hashes(data, begin, end, exact=True)
    runs, run_offs = shingle_hashes(hashes, words, WINDOW)
    same = np.append(False, hashes[1:] == hashes[:-1])[: len(hashes)]
    same[words[:-1][words[:-1] < len(hashes)]] = False  # a text's first word has none before
    letters = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))[data]
    lettered, sizes = _sums(letters, begin) > 0, _sums(begins & ~gap, begin)
    # lines: from the text's begin or after a \n, to the next \n or the text's end; those with a word
    feeds = np.flatnonzero(data == 0x0A)
    line_begin, line_end = np.sort(np.concatenate([offs[:-1], feeds + 1])), np.sort(np.concatenate([feeds, offs[1:]]))
    line_words = np.searchsorted(begin, np.stack([line_begin, line_end]))
    full = line_words[1] > line_words[0]
    line_begin, line_end, first, last = line_begin[full], line_end[full], begin[line_words[0][full]], end[line_words[1][full] - 1]
    lines = np.searchsorted(line_begin, offs)
    texts = span_hashes(data, line_begin, line_end, exact=True)
    at = lambda place: data[np.clip(place, 0, max(0, len(data) - 1))]
    three = lambda place, x, y, z: (at(place) == x) & (at(place + 1) == y) & (at(place + 2) == z)
    bullet = np.isin(at(first), list(b"-*")) | three(first, 0xE2, 0x80, 0xA2)
    wide = last - np.maximum(first, line_begin) >= 3
    opened = wide & (three(last - 3, 0x2E, 0x2E, 0x2E) | three(last - 3, 0xE2, 0x80, 0xA6))
    inside = lambda mask: _inside(mask, lines, np.count_nonzero)
    return {
        "n_words": np.diff(words),
        "word_chars": per_text(begins & ~gap),
        "n_symbols": per_text(_class(b"#*$%&|<>")[data]),
        "n_dup_lines": _inside(texts, lines, lambda t: len(t) - len(np.unique(t))),
        "n_repeat_words": _inside(runs, run_offs, _repeated),
        "n_chars": per_text(begins),
        "n_lines": np.diff(lines),
        "n_upper": per_text(_class(bytes(range(65, 91)))[data]),
        "n_digits": per_text(_class(b"0123456789")[data]),
        "n_letter_words": _inside(lettered, words, np.count_nonzero),
        "n_bullet_lines": inside(bullet),
        "n_open_lines": inside(opened),
        "longest_word": _inside(sizes, words, np.max),
        "n_stutters": _inside(same, words, np.count_nonzero),
    }


def failed_bits() -> Column:
    """The bits of the rules that measurements fail."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def with_ledger(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of the measurements, and its name."""
    name = fresh(docs, "ledger")
    struct = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches):
        for b in batches:
            found = measured(b.column("text"))
            column = pa.StructArray.from_arrays([pa.array(found[m], pa.int64()) for m in MEASURES], list(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*b.schema.names, name])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, struct)])), name


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed): one row for each row of docs."""
    rows, name = with_ledger(docs.select("doc_id", "text"))
    return rows.select("doc_id", f"{name}.*").withColumn("failed", failed_bits())


def fails(policy: Policy, failed: str = "failed") -> Column:
    """Whether a row goes by the policy."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def filtered(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The rows of docs that the policy keeps, with all their columns."""
    rows, name = with_ledger(docs)
    row = fresh(rows, "row")
    judged = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), f"{name}.*").withColumn("failed", failed_bits())
    return judged.filter(~fails(policy)).select(f"{row}.*")


def ablation(rows: DataFrame, policy: Policy, by: str | None = None) -> DataFrame:
    """What each rule of the policy does to a ledger, by the values of a column if one is named: rows (of the ledger), kept (by the policy),
    fails (the rule), sole (no other rule of the policy fails: they would stay without it), kept_without (the policy less the rule), kept_alone (the rule
    alone). One pass: the rows are counted by bit pattern, of which there are few, and patterns are folded by their bits."""
    keys = [by] if by else []
    patterns = rows.groupBy(*keys, F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules]
    each = patterns.withColumn("r", F.explode(F.array(*rules))).select(*keys, "r.rule", "r.bit", "bits", "n")
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy(*keys, "rule").agg(
        F.sum("n").cast("long").alias("rows"), count(bits == 0).alias("kept"), count(bits.bitwiseAND(bit) != 0).alias("fails"), count(bits == bit).alias("sole"),
        count(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"), count(bits.bitwiseAND(bit) == 0).alias("kept_alone"),
    ).withColumn("policy", F.lit(policy.label))
