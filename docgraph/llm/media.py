"""Media columns: content-defined chunking with a chunk store.

A payload (UTF-8 bytes, zeros up to a positive multiple of UNIT) becomes a WAV file of 8-bit mono samples. The file is cut where
a rolling gear hash of the last 32 bytes has MASK zero bits, between LEAST and MOST bytes, so equal passages give equal chunks.
Chunks are known by their SHA-256. First all digests are counted; those seen more than once set a bit in each of PROBES bitmaps of
fixed size, by other bytes of the digest each. Then files are stored: a chunk whose bits are not all set is surely unique and stays in
its file's row; the others go to the chunk table, one copy each, and the row holds their digests. A file is read back from its ordered list: its own chunks and, by a join on
the digest, those of the chunk table; its SHA-256 must agree, else reading fails. A chunk that millions of files share is one
row of the chunk table; the bitmaps only decide where a chunk lives, so full ones cost speed and never bytes. That cost grows with the
bits set: a unique chunk that all bitmaps take for shared is moved by itself, and with it what else its file holds. So of one bitmap
up to a sixteenth is set, and by PROBES of them one unique chunk in 65,536 is taken for shared.

Null texts are empty (64 zeros). Equal texts give equal files. Repeated rows and null doc_ids are files of their own. Empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dealt_join, discard, hot_keys, stored

UNIT = 64
LEAST, MOST, MASK = 512, 16384, (1 << 11) - 1
#: Bitmaps, and bits of each: 16 for each shared chunk, within these bounds (32 MB at most in all).
PROBES, LEAST_BITS, MOST_BITS = 4, 1 << 20, 1 << 26
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")
HEADER = _WAV.size


class Damaged(ValueError):
    """A file read back is not the one that was stored."""


@cache
def gear() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)


def wav(payload: bytes, rate: int = 8000) -> bytes:
    n = len(payload)
    return _WAV.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The payload of a WAV file."""
    riff, _, wave, _, _, _, _, _, _, _, bits, data, n = _WAV.unpack_from(media)
    if (riff, wave, bits, data, n) != (b"RIFF", b"WAVE", 8, b"data", len(media) - HEADER):
        raise Damaged("not a WAV file of 8-bit samples")
    return media[HEADER:]


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    ends, at = [], 0
    if n > LEAST:
        h = gear()[np.frombuffer(data, np.uint8)]
        span = 1
        while span < 32:  # the hash of the last 2 * span bytes from that of span bytes
            h[span:] = h[span:] + (h[:-span] << np.uint32(span)) if span < len(h) else h[span:]
            span *= 2
        places = np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + 1
        while n - at > LEAST:
            k = int(np.searchsorted(places, at + LEAST))
            end = int(places[k]) if k < len(places) else n
            at = min(end, at + MOST, n)
            ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks of data in order."""
    at, out = 0, []
    for end in cuts(data):
        part = data[at:end]
        out.append((hashlib.sha256(part).digest(), part))
        at = end
    return out


def _files(column: pa.Array):
    for t in column.to_pylist():
        raw = (t or "").encode()
        yield len(raw), wav(payload_of(raw))


def _bit(digest: bytes, bits: int, probe: int = 0) -> int:
    return int.from_bytes(digest[4 * probe : 4 * probe + 4], "little") % bits


def maybe_shared(digest: bytes, bitmaps: bytes) -> bool:
    """Whether the digest's bit is set in each of PROBES bitmaps."""
    bits = 8 * len(bitmaps) // PROBES
    for probe in range(PROBES):
        bit = probe * bits + _bit(digest, bits, probe)
        if not bitmaps[bit >> 3] >> (bit & 7) & 1:
            return False
    return True


def shared_bitmap(docs: DataFrame, probes: int = 1) -> bytes:
    """Bits of the digests of chunks that occur more than once; as many bitmaps one after another as there are probes."""

    def run(batches):
        for b in batches:
            found = [d for _, f in _files(b.column("text")) for d, _ in chunks(f)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    seen = arrow_map(docs.select("text"), run, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    seen = stored(seen, "media-shared")
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * seen.count()).bit_length()))
    # the same bit as _bit(): four bytes, little-endian, modulo a power of two
    octet = lambda i: F.conv(F.substring(F.hex("digest"), 2 * i + 1, 2), 16, 10).cast("long")
    four = lambda i: octet(i) + octet(i + 1) * 256 + octet(i + 2) * 65536 + octet(i + 3) * 16777216
    bit = F.explode(F.array(*[F.lit(p * bits) + four(4 * p) % bits for p in range(probes)])).alias("bit")
    words = seen.select(bit).groupBy((F.floor(F.col("bit") / 32768)).alias("k")).agg(F.bitmap_construct_agg((F.col("bit") % 32768)).alias("m"))
    out = bytearray(probes * bits // 8)
    for r in words.toLocalIterator():  # probes * MOST_BITS / 32768 rows of 4 KiB at most
        out[r["k"] * 4096 : r["k"] * 4096 + 4096] = r["m"]
    discard(seen)
    return bytes(out)


RECIPE = "array<struct<digest:binary,here:boolean,length:int>>"


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunk table) of the texts of docs, both written to the shared folder."""
    spark = docs.sparkSession
    bitmaps = spark.sparkContext.broadcast(shared_bitmap(docs, PROBES))  # of fixed size

    def run(batches):
        base, count, sent = TaskContext.get().partitionId() << 33, 0, set()
        bits = bitmaps.value
        recipe_type = pa.list_(pa.struct([("digest", pa.binary()), ("here", pa.bool_()), ("length", pa.int32())]))
        names = ["uid", "doc_id", "n_bytes", "media_sha256", "recipe", "data"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), recipe_type, pa.binary()]
        for b in batches:
            rows = []
            for doc, (n, media) in zip(b.column("doc_id").to_pylist(), _files(b.column("text")), strict=True):
                recipe, own = [], []
                for digest, part in chunks(media):
                    here = not maybe_shared(digest, bits)
                    recipe.append((digest, here, len(part)))
                    if here:
                        own.append(part)
                    elif digest not in sent:  # once a task; the chunk table drops the rest
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add(digest)
                        rows.append((None, None, None, None, [(digest, False, len(part))], part))
                rows.append((base + count, doc, n, hashlib.sha256(media).hexdigest(), recipe, b"".join(own)))
                count += 1
            keys = ("digest", "here", "length")
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            cols[4] = [[dict(zip(keys, x, strict=True)) for x in r] for r in cols[4]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    both = arrow_map(docs.select("doc_id", "text"), run, f"uid long, doc_id long, n_bytes long, media_sha256 string, recipe {RECIPE}, data binary")
    both = stored(both, "media-files")
    pieces = both.filter("uid is null").select(F.col("recipe")[0]["digest"].alias("digest"), "data")
    pieces = stored(pieces.groupBy("digest").agg(F.first("data").alias("data")), "media-chunks")
    return both.filter("uid is not null"), pieces


def restore(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_sha256 and media (the file, verified) of every stored file."""
    remote = F.exists("recipe", lambda c: ~c["here"])
    none = F.lit(None).cast("array<struct<pos:int,data:binary>>")
    wanted = files.filter(remote).select("uid", F.posexplode("recipe").alias("pos", "c")).filter("not c.here").select("uid", "pos", F.col("c.digest").alias("digest"))
    brought = dealt_join(wanted, pieces, "digest", "uid", hot_keys(wanted, "digest")).groupBy("uid").agg(F.collect_list(F.struct("pos", "data")).alias("remote"))  # one file's chunks
    rows = files.filter(~remote).withColumn("remote", none).unionByName(files.filter(remote).join(brought, "uid"))

    def run(batches):
        for b in batches:
            out = []
            for doc, n, sha, recipe, data, far in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media_sha256", "recipe", "data", "remote")), strict=True):
                from_table = {r["pos"]: r["data"] for r in far or ()}
                at, parts = 0, []
                for pos, c in enumerate(recipe):
                    if c["here"]:
                        parts.append(data[at : at + c["length"]])
                        at += c["length"]
                    else:
                        parts.append(from_table[pos])
                media = b"".join(parts)
                if hashlib.sha256(media).hexdigest() != sha:
                    raise Damaged(f"document {doc}: the file read back differs")
                out.append((doc, n, sha, media))
            types = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "media_sha256", "media"])

    return arrow_map(rows.select("doc_id", "n_bytes", "media_sha256", "recipe", "data", "remote"), run, "doc_id long, n_bytes long, media_sha256 string, media binary", rows=256)


def described(media: DataFrame) -> DataFrame:
    """Rows of restore() with payload instead of media, and a feature string of its samples: sum, sum of squares, zero crossings
    (of the middle, 128), least, largest, and the sum of absolute steps."""

    def run(batches):
        for b in batches:
            payloads, features = [], []
            for m in b.column("media").to_pylist():
                p = samples(m)
                x = np.frombuffer(p, np.uint8).astype(np.int64)
                crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
                payloads.append(p)
                features.append(f"sum={x.sum()};sq={(x * x).sum()};zc={crossings};min={x.min()};max={x.max()};step={np.abs(np.diff(x)).sum()}")
            cols = [b.column(c) for c in ("doc_id", "n_bytes", "media_sha256")]
            cols += [pa.array([len(m) for m in b.column("media").to_pylist()], pa.int64()), pa.array(payloads, pa.binary()), pa.array(features, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media_sha256", "media_bytes", "payload", "feature"])

    return arrow_map(media, run, "doc_id long, n_bytes long, media_sha256 string, media_bytes long, payload binary, feature string", rows=256)
