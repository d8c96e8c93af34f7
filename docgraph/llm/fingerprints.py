"""Document fingerprints: one-permutation MinHash over word shingles.

Each distinct WIDTH-word shingle (A-Z lower-cased; fewer words: the whole sequence) is hashed once; its upper bits pick one of
BINS bins, which keeps its least value. Empty bins are filled by optimal densification: a bin tries the bins that a hash of
its number and the attempt names until one held something of its own. The low byte of each bin is stored, as hex. Likeness is
the share of equal bytes, corrected for bytes that agree by chance, so it estimates the Jaccard similarity of the sets.

Null texts are empty; a text without words has the fingerprint "", which is like itself (1.0) and unlike all others (0.0).
Equal texts have equal fingerprints. The next document follows in descending doc_id (rows of one doc_id by a hash of their
text, null doc_ids last), after the last the first; a single document is its own next. Empty tables give empty results.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, range_bucket
from .words import U, mixed, shingle_hashes, text_bytes, word_hashes

WIDTH = 5
BINS = 256  # of one byte each
_NONE = np.uint64((1 << 64) - 1)


@cache
def donors(attempt: int) -> np.ndarray:
    """The bin that each bin tries."""
    return (mixed(np.arange(BINS, dtype=np.uint64) + U(BINS * (attempt + 1))) % U(BINS)).astype(np.int64)


def fingerprints(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BINS) bytes, and which texts have any word."""
    words, offs = word_hashes(*text_bytes(column))
    runs, to = shingle_hashes(words, offs, width)
    n = len(column)
    least = np.full(n * BINS, _NONE)
    row = np.repeat(np.arange(n), np.diff(to))
    np.minimum.at(least, row * BINS + (runs >> U(56)).astype(np.int64), runs & U((1 << 56) - 1))
    least = least.reshape(n, BINS)
    own = least != _NONE
    some = own.any(1)
    rows, bins = np.nonzero(~own & some[:, None])
    attempt = 0
    while len(rows):
        donor = donors(attempt)[bins]
        found = own[rows, donor]
        least[rows[found], bins[found]] = least[rows[found], donor[found]]
        rows, bins = rows[~found], bins[~found]
        attempt += 1
    return (least & U(255)).astype(np.uint8), some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 1 / 256
    same = (a == b).mean(1) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, np.clip((same - chance) / (1 - chance), 0.0, 1.0), (some_a == some_b).astype(float))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, bucket by bucket in descending doc_id. Texts are shuffled once; the first row of each bucket also
    goes, as a row that only is a next one, to the end of the bucket before it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"_key": F.coalesce("doc_id", F.lit(-(1 << 63))), "_guest": F.lit(False)})
    docs = docs.withColumn("_bucket", range_bucket(docs.filter(F.col("doc_id").isNotNull()), "_key", parts))
    tops = {r["_bucket"]: r["top"] for r in docs.groupBy("_bucket").agg(F.max("_key").alias("top")).collect()}  # one row a bucket
    if tops:
        order = sorted(tops, reverse=True)
        host = F.create_map(*[F.lit(x) for i, b in enumerate(order) for x in (tops[order[(i + 1) % len(order)]], b)])
        guests = docs.filter(F.col("_key").isin(sorted(tops.values()))).groupBy("_key").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", "_key", F.lit(True).alias("_guest"), F.element_at(host, F.col("_key")).alias("_bucket"))
        docs = docs.unionByName(guests)
    w = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_key"), F.xxhash64("text"))
    return docs.withColumn("next_text", F.lead("text").over(w)).filter("not _guest").select("doc_id", "text", "next_text")


def edited(rows: DataFrame) -> DataFrame:
    """rows of with_next() with n_chars and the edited text."""
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    return rows.withColumn("edited", F.concat(kept, F.substring("next_text", F.lit(1), half)))


def compare(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """rows of edited() with fingerprints and likenesses instead of next_text. Where the next text is that of the row after, as
    mostly, its fingerprint serves twice."""

    def run(batches):
        for b in batches:
            own, some = fingerprints(b.column("text"), width)
            other, other_some = fingerprints(b.column("edited"), width)
            after, after_some = np.zeros_like(own), np.zeros_like(some)
            if len(own):
                after[:-1], after_some[:-1] = own[1:], some[1:]
                near = pc.equal(b.column("next_text").slice(0, len(own) - 1), b.column("text").slice(1))
                at = np.flatnonzero(~np.append(np.array(near.to_pylist(), bool), False))
                after[at], after_some[at] = fingerprints(b.column("next_text").take(pa.array(at)), width)
            text = lambda f, s: pa.array([x.tobytes().hex() if y else "" for x, y in zip(f, s, strict=True)], pa.string())
            cols = [b.column(c) for c in ("doc_id", "text", "n_chars", "edited")]
            cols += [text(own, some), text(other, other_some), pa.array(likeness(own, some, other, other_some)), pa.array(likeness(own, some, after, after_some))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return arrow_map(rows.select("doc_id", "text", "next_text", "n_chars", "edited"), run, "doc_id long, text string, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", rows=256)
