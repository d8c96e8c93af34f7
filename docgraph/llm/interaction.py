"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, from one pass over the texts.

marks() finds for each row which of the filters A to E it fails, as five bits. Whatever the order, a row goes at the first filter that it
fails, so a table of 32 bit patterns by 120 orders holds that step for all cases. audit() looks rows up in it and counts removals by part,
order, step and label with np.bincount; the arrays of tasks are summed in two rounds, first by part and cell of tasks, then by part.

Words are the maximal runs of other characters than space and U+0009 to U+000D, with their case. A null text is an empty one. The part of a
row is its source, a null source the empty string. E compares whole texts over all rows: the row with the least doc_id of a text does not
fail, nor do other rows with that doc_id; null doc_ids are smaller than none and have none below. Repeated rows count as often as they are
there. labels may name a doc_id several times: it is good (or toxic) if one of them says so; rows without a label are neither. An empty table
has no parts and no rows. Columns of docs other than doc_id, text and source, and of labels other than doc_id, quality and toxic, are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dealt_join, hot_counts, hot_keys, stored
from .words import _tables, span_hashes, spans, text_bytes

FILTERS = "ABCDE"
ORDERS = tuple(permutations(range(len(FILTERS))))
STEPS, LABELS, MASKS = len(FILTERS), 4, 1 << len(FILTERS)  # labels: 1 for good, 2 for toxic

#: The parts that a task counts before it hands on their arrays.
MOST_PARTS = 1024
#: Cells of tasks whose arrays are summed apart in the first round.
CELLS = 16


def first_failures() -> np.ndarray:
    """By bit pattern and order, the step (from 0) at which such a row goes, or STEPS if it stays."""
    out = np.full((MASKS, len(ORDERS)), STEPS, np.int64)
    for mask in range(MASKS):
        for o, order in enumerate(ORDERS):
            out[mask, o] = next((step for step, f in enumerate(order) if mask >> f & 1), STEPS)
    return out


def _failed(column: pa.Array) -> np.ndarray:
    """Bits of A to D by text."""
    data, offs = text_bytes(column)
    symbol = np.zeros(256, bool)
    symbol[list(b"#$%&*|")] = True
    begin, end = spans(_tables()[0][data], offs)
    words, at = span_hashes(data, begin, end, exact=True), np.searchsorted(begin, offs)
    out = np.zeros(len(column), np.int64)
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        own, text = words[at[i] : at[i + 1]], data[a:b]
        upper, points = np.count_nonzero((text >= 65) & (text <= 90)), np.count_nonzero((text & 0xC0) != 0x80)
        fails = (len(own) < 200, 100 * len(np.unique(own)) < 50 * len(own), 100 * upper > 2 * points, bool(symbol[text].any()))
        out[i] = sum(1 << f for f, failed in enumerate(fails) if failed)
    return out


def marks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic) of each row of docs; failed has bit f for the filter FILTERS[f]. Written to the shared folder."""

    def run(batches):
        base, seen = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            text = b.column("text")
            digest = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in text.to_pylist()]
            row = pa.array(np.arange(base + seen, base + seen + b.num_rows))
            seen += b.num_rows
            part = b.column("source").fill_null("")
            yield pa.RecordBatch.from_arrays([row, b.column("doc_id"), part, pa.array(_failed(text), pa.int32()), pa.array(digest, pa.binary())], ["row", "doc_id", "part", "failed", "digest"])

    plain = docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"))
    rows = stored(arrow_map(plain, run, "row long, doc_id long, part string, failed int, digest binary"), "audit-rows")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = stored(texts.filter("n > 1"), "audit-copies")
    n = rows.count()
    found = dealt_join(rows, copies.select("digest", "first"), "digest", "row", hot_counts(copies, "digest", "n", n), "left")
    failed = F.when(F.col("first") < F.col("doc_id"), F.col("failed").bitwiseOR(F.lit(1 << FILTERS.index("E")))).otherwise(F.col("failed"))
    found = found.select("row", "doc_id", "part", failed.cast("int").alias("failed"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    found = dealt_join(found, known, "doc_id", "row", hot_keys(rows.filter("doc_id IS NOT NULL"), "doc_id"), "left")
    no = F.lit(False)
    return stored(found.select("doc_id", "part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "audit-marks", done=[rows, copies])


SIZE = LABELS * len(ORDERS) * (STEPS + 1)
ARRAYS = "part string, cell int, sums array<long>"


def _batch(parts: list[str], cell: int, sums: list[np.ndarray]) -> pa.RecordBatch:
    width = SIZE + MASKS
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * width, pa.int32()), pa.array(np.concatenate(sums), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array([cell] * len(parts), pa.int32()), lists], ["part", "cell", "sums"])


def counted(rows: DataFrame) -> DataFrame:
    """(part, cell, sums): each task's removals by label, order and step, one after another, and then its rows by bit pattern."""
    table = first_failures()

    def run(batches):
        cell, held = TaskContext.get().partitionId() % CELLS, {}
        places = np.arange(len(ORDERS)) * (STEPS + 1)
        for b in batches:
            coded = b.column("part").dictionary_encode()
            names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            failed = b.column("failed").to_numpy().astype(np.int64)
            label = b.column("good").to_numpy(zero_copy_only=False).astype(np.int64) + 2 * b.column("toxic").to_numpy(zero_copy_only=False)
            at = ((part * LABELS + label) * (SIZE // LABELS))[:, None] + places + table[failed]
            removed = np.bincount(at.ravel(), minlength=len(names) * SIZE).reshape(len(names), SIZE)
            patterns = np.bincount(part * MASKS + failed, minlength=len(names) * MASKS).reshape(len(names), MASKS)
            for k, name in enumerate(names):
                own = np.concatenate([removed[k], patterns[k]])
                held[name] = held[name] + own if name in held else own
            if len(held) >= MOST_PARTS:
                yield _batch(list(held), cell, list(held.values()))
                held = {}
        if held:
            yield _batch(list(held), cell, list(held.values()))

    return arrow_map(rows.select("part", "failed", "good", "toxic"), run, ARRAYS)


def _totals(batches):
    """(part, sum of its arrays) of rows that come ordered by part."""
    part, total = None, None
    for b in batches:
        arrays = b.column("sums").flatten().to_numpy().reshape(-1, SIZE + MASKS)
        for name, own in zip(b.column("part").to_pylist(), arrays, strict=True):
            if name == part:
                total = total + own
            else:
                if part is not None:
                    yield part, total
                part, total = name, own
    if part is not None:
        yield part, total


def _summed(batches):
    for part, total in _totals(batches):
        yield _batch([part], 0, [total])


NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _report(batches):
    """One row by order and step of each part."""
    names = ["".join(FILTERS[f] for f in order) for order in ORDERS]
    which = np.array(ORDERS)  # the filter at each order's step
    holds = np.array([[mask >> f & 1 for f in range(STEPS)] for mask in range(MASKS)])
    schema = ["part", "filter_order", "step", *NUMBERS]
    for part, total in _totals(batches):
        gone, patterns = total[:SIZE].reshape(LABELS, len(ORDERS), STEPS + 1)[:, :, :STEPS], total[SIZE:]
        removed = gone.sum(0)
        fails, alone = patterns @ holds, patterns[1 << np.arange(STEPS)]
        shapley = np.array([removed[which == f].sum() for f in range(STEPS)])
        kept = patterns.sum() - np.cumsum(removed, 1)
        found = (kept, removed, fails[which] - removed, alone[which], gone[1] + gone[3], gone[2] + gone[3], shapley[which])
        n = removed.size
        keys = [pa.array([part] * n, pa.string()), pa.array(np.repeat(names, STEPS).tolist(), pa.string()), pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32())]
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x.ravel(), pa.int64()) for x in found]], schema)


def audit(rows: DataFrame) -> DataFrame:
    """The report of rows (part, failed, good, toxic): one row by part, order of the filters and step."""
    first = counted(rows).repartition("part", "cell").sortWithinPartitions("part")
    second = arrow_map(first, _summed, ARRAYS, rows=64).repartition("part").sortWithinPartitions("part")
    return arrow_map(second, _report, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in NUMBERS), rows=64)
