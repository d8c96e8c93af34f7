"""Packing: token ids of documents into sequences of SEQUENCE ids by minimum bin slack.

Each task packs its documents in windows of about WINDOW ids. A document's full sequences are cut off first; the rests of
all documents of a window form a multiset of lengths. A bin starts with the longest rest; a bitset subset-sum over the
other lengths (counts split into powers of two) finds the multiset that fills it closest to its capacity, and the counts
are traced back. What is still free is filled by cutting the longest rest left, so that only what is left at the end of a
window is not full: that goes into sequences whose lengths are powers of two, which need no padding.

Null texts are empty; every document has an end id, so none is lost. Repeated rows are documents of their own. Empty tables
give empty results. sequence_id holds the task's number above bit 33; it depends on how Spark splits the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map
from .tokens import REMEMBERED, encoder, vocabulary_path, with_end

SEQUENCE = 4096
WINDOW = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How many of each length to take (counts[n] are there) so that their sum is as close below capacity as can be."""
    reach, steps, goal = 1, [], 1 << capacity
    mask = (goal << 1) - 1
    for n in np.flatnonzero(counts[1 : capacity + 1])[::-1] + 1:
        n, left, part = int(n), min(int(counts[n]), capacity // int(n)), 1
        while left:
            take = min(part, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left -= take
            part *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[n] = chosen.get(n, 0) + take
            at -= n * take
    return chosen


def window_sequences(lengths: list[int], size: int = SEQUENCE) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    rests: dict[int, list[tuple[int, int]]] = {}
    counts = np.zeros(size + 1, np.int64)

    def put(doc: int, start: int, n: int) -> None:
        if n:
            rests.setdefault(n, []).append((doc, start))
            counts[n] += 1

    def take(n: int) -> tuple[int, int]:
        counts[n] -= 1
        return rests[n].pop()

    left = 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            yield [(doc, start, size)]
        put(doc, n - n % size, n % size)
        left += n % size
    while left:
        goal = size if left >= size else 1 << (left.bit_length() - 1)
        left -= goal
        out, free = [], goal
        if left + goal >= size:  # the longest first
            n = int(np.flatnonzero(counts)[-1])
            out.append((*take(n), n))
            free -= n
        for n, k in fill(counts, free).items():
            for _ in range(k):
                out.append((*take(n), n))
            free -= n * k
        if free:
            n = int(np.flatnonzero(counts)[-1])
            while n <= free:  # cannot be after fill(); kept so that a bin is never overfull
                out.append((*take(n), n))
                free -= n
                n = int(np.flatnonzero(counts)[-1])
            doc, start = take(n)
            out.append((doc, start, free))
            put(doc, start + free, n - free)
        yield out


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, window: int = WINDOW, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of the texts of docs with their ids (unsigned 32-bit, little-endian), by sequence."""
    path = vocabulary or vocabulary_path()
    fields = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        done = 0
        names: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def flush():
            nonlocal done, total
            rows: list[tuple] = []
            for pieces in window_sequences([len(x) for x in held], size):
                offset = 0
                for doc, start, n in pieces:
                    rows.append((names[doc], start, n, held[doc][start : start + n].tobytes(), len(held[doc]), base + done, offset))
                    offset += n
                done += 1
                if len(rows) >= 256:
                    yield rows
                    rows = []
            if rows:
                yield rows
            names.clear(), held.clear()
            total = 0

        def batch(rows):
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

        for b in batches:
            ids, offs = with_end(*encoder(path, remembered).encode(b.column("text").to_pylist()))
            ids = ids.astype("<u4")
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                names.append(doc)
                held.append(ids[offs[i] : offs[i + 1]])
                total += len(held[-1])
                if total >= window:
                    yield from map(batch, flush())
        if held:
            yield from map(batch, flush())

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA, keep="tokens", rows=256)
