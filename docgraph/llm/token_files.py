"""Token-id files: an adaptive context-mixing range coder over blocks that stand alone.

A file holds the ids of consecutive documents:

    magic "DGTK2\0", then little-endian: u32 documents, u64 ids, u32 alphabet size, u32 blocks, u32 ids in a block, u32 crc32 of all else before the payload
    alphabet: u32 ids, most frequent first; ids are coded by their rank in it
    counts: u32 for each of the alphabet, the order-0 statistics
    documents: i64 doc_id, u32 number of ids and u8 1 if the doc_id is null, each
    blocks: u32 words of 32 bits and u32 crc32 (of the block's ids as unsigned 32-bit little-endian), each
    payload: the blocks' words, one block after another

All blocks of a file have as many ids (the last may have fewer) and start from a reset model and a reset coder. Per id, order 1 and
order 2 each predict one rank (what last followed the hash of the last rank, of the last two) with a confidence that hits raise;
by the pair of confidences adaptive weights, from the hits so far in the block, mix the two predictions with order 0, the file's own
counts. The rank is coded in the interval that the mixture gives it. A file's blocks are coded in lockstep, one lane each,
with the same model code for writing and reading; blocks are as long as leaves about LANES of them, within SHORTEST and LONGEST.

Files are rows of a table (bucket, seq, n_docs, n_ids, data), which Spark writes to any store and commits as a whole; their
order is (bucket, seq), and doc_id ascends in it. Null texts are empty; each document ends with an end id, so none is lost.
A null doc_id is kept and comes first. Repeated rows are documents of their own. An empty table has no files. A file that is cut
short, or changed where it matters to any value, raises Damaged when it is read (the last bits of a block's payload may not matter).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, offsets_before, range_bucket, small
from .tokens import END_ID, LETTERS, encoder, vocabulary_path, with_end

MAGIC = b"DGTK2\0"
#: Blocks that are coded at once, and the least and the most ids of a block.
LANES, SHORTEST, LONGEST = 4096, 512, 4096
HASH_BITS = 8
_HEAD = struct.Struct("<6sIQIIII")
_DOC = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("null", "u1")])
U = np.uint64
#: Bits of the mixing weights; of 4096 parts order 0 keeps 94 or more.
MIX_BITS, MIXED = 12, 4000
_HALF, _SMALL = U(32), U(1 << 32)
#: The weights follow the hits after 16 steps of a block, then twice as many, at last after as many steps as this.
RENEWED = 128

#: Ids after which a file is closed, at the end of a document.
FILE_IDS = 4 << 20


class Damaged(ValueError):
    """A file or one of its blocks does not hold what was written."""


class Order0:
    """Order 0: of each rank its share of 1 << bits parts, by its count in the file, and where its parts begin."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.n, self.bits = n, max(16, n.bit_length() + 5)
        share = 1 + counts.astype(np.int64) * ((1 << self.bits) - n) // max(1, int(counts.sum()))
        share[:1] += (1 << self.bits) - share.sum()
        self.share, self.begin = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)

    def ranks(self) -> np.ndarray:
        """The rank of every part."""
        return np.repeat(np.arange(self.n, dtype=np.uint16 if self.n <= 1 << 16 else np.uint32), self.share.astype(np.int64))


class Lanes:
    """Orders 1 and 2 and the mixing weights of n blocks at once. Arrays of two rows hold order 1 and order 2."""

    def __init__(self, n: int, alphabet: int):
        self.n = n
        kind = np.uint16 if alphabet < 1 << 14 else np.uint32
        self.table = np.full((2 * n) << HASH_BITS, alphabet << 2, kind)  # 4 * rank + confidence; no rank is `alphabet`
        self.begin = (np.arange(2 * n) << HASH_BITS).reshape(2, n)
        self.factors, self.shift = np.array([[0x9E3779B1], [0x85EBCA6B]], np.uint32), np.uint32(32 - HASH_BITS)
        self.before, self.last = np.zeros((2, n), np.uint32), np.full(n, alphabet, np.uint32)
        self.two, self.three = kind(2), kind(3)
        self.lane = np.arange(n) * 16
        hits2 = np.repeat([6, 26, 48, 60], 4)  # of 70, to begin with, by the confidences of order 2 and order 1
        self.all, self.hits2, self.hits1 = (np.tile(x, n) for x in (np.full(16, 70), hits2, np.tile([5, 18, 34, 50], 4) * (70 - hits2) // 70))
        self.contexts, self.found = np.zeros((RENEWED, n), np.int64), np.zeros((RENEWED, 2, n), bool)
        self.held, self.due = 0, 16
        self._renew()

    def _renew(self) -> None:
        """The weights by all hits so far: where order 2's interval ends, and order 1's."""
        found = self.found[: self.held]
        packed = 1.0 + 65536.0 * (found[:, 0] & ~found[:, 1]) + 4294967296.0 * found[:, 1]
        packed = np.bincount(self.contexts[: self.held].ravel(), packed.ravel(), 16 * self.n).astype(np.int64)
        self.all += packed & 65535
        self.hits1 += (packed >> 16) & 65535
        self.hits2 += packed >> 32
        end2 = 1 + self.hits2 * MIXED // self.all
        self.end2, self.end1 = end2.view(np.uint64), (end2 + 1 + self.hits1 * MIXED // self.all).view(np.uint64)
        self.held = 0

    def look(self) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the intervals of order 2 and of order 1 for the next id; order 0 has what is left."""
        product = self.last * self.factors
        hashed = (product[0] + self.before) >> self.shift
        self.before[1] = product[1]
        self.at = self.begin + hashed
        value = self.table.take(self.at)
        self.rank, self.trust = value >> self.two, value & self.three
        context = self.contexts[self.held]
        np.add(self.lane, self.trust[0] + (self.trust[1] << self.two), out=context)
        return self.end2.take(context), self.end1.take(context)

    def learn(self, rank: np.ndarray) -> None:
        hit = np.equal(self.rank, rank, out=self.found[self.held])
        self.table[self.at] = np.minimum(self.trust + hit, self.three) * hit + (rank << self.two)
        self.last = rank.astype(np.uint32)
        self.held += 1
        if self.held == self.due:
            self._renew()
            self.due = min(RENEWED, 2 * self.due)


def _encode_lanes(ranks: np.ndarray, order0: Order0) -> list[np.ndarray]:
    """ranks: (blocks, steps) of equally long blocks. The words of each block."""
    n, steps = ranks.shape
    model, mix, bits0 = Lanes(n, order0.n), U(MIX_BITS), U(order0.bits)
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    width = steps * (MIX_BITS + order0.bits + 1) // 32 + 4
    begin = np.arange(n) * width
    out, used = np.zeros(n * width, np.int64), begin.copy()  # words take carries later, in their upper half
    for rank in np.ascontiguousarray(ranks.T.astype(model.table.dtype)):
        end2, end1 = model.look()
        had1, had2 = model.rank == rank
        part = span >> mix
        to2, to1 = end2 * part, end1 * part
        part = (span - to1) >> bits0
        start = np.where(had2, U(0), np.where(had1, to2, to1 + order0.begin.take(rank) * part))
        span = np.where(had2, to2, np.where(had1, to1 - to2, order0.share.take(rank) * part))
        low += start
        over = (low < start).nonzero()[0]
        if len(over):
            out[used.take(over) - 1] += 1
        rows = (span < _SMALL).nonzero()[0]  # one word is enough: a step takes less than 32 bits
        at, word = used.take(rows), low.take(rows)
        out[at] = word >> _HALF
        used[rows], low[rows], span[rows] = at + 1, word << _HALF, span.take(rows) << _HALF
        model.learn(rank)
    for _ in range(2):
        out[used] = low >> _HALF
        used += 1
        low = low << _HALF
    out = out.reshape(n, width)
    while (carry := out >> 32).any():
        out &= 0xFFFFFFFF
        out[:, :-1] += carry[:, 1:]
    return [row[:k].astype("<u4") for row, k in zip(out, (used - begin).tolist(), strict=True)]


def _decode_lanes(words: list[np.ndarray], steps: int, order0: Order0) -> np.ndarray:
    n = len(words)
    model, mix, bits0, of_part = Lanes(n, order0.n), U(MIX_BITS), U(order0.bits), order0.ranks()
    width = max(map(len, words)) + 2
    held = np.zeros((n, width), np.uint64)
    for i, w in enumerate(words):
        held[i, : len(w)] = w
    held, used = held.ravel(), np.arange(n) * width
    code = (held.take(used) << _HALF) | held.take(used + 1)
    used += 2
    span = np.full(n, (1 << 64) - 1, np.uint64)
    ranks = np.empty((steps, n), model.table.dtype)
    for t in range(steps):
        end2, end1 = model.look()
        part = span >> mix
        to2, to1 = end2 * part, end1 * part
        had2, had1 = code < to2, code < to1
        part = (span - to1) >> bits0
        other = of_part.take(((code - to1) // part).view(np.int64), mode="clip")
        rank = np.where(had2, model.rank[1], np.where(had1, model.rank[0], other))
        code -= np.where(had2, U(0), np.where(had1, to2, to1 + order0.begin.take(other) * part))
        span = np.where(had2, to2, np.where(had1, to1 - to2, order0.share.take(other) * part))
        rows = (span < _SMALL).nonzero()[0]
        at = used.take(rows)
        code[rows] = (code.take(rows) << _HALF) | held.take(at, mode="clip")
        used[rows], span[rows] = at + 1, span.take(rows) << _HALF
        ranks[t] = rank
        model.learn(rank)
    if ranks.size and ranks.max() >= order0.n:
        raise Damaged("a block holds no valid id")
    return ranks.T


def block_of(n_ids: int) -> int:
    """Ids in a block of a file with so many ids."""
    return max(SHORTEST, min(LONGEST, -(-n_ids // LANES)))


def write(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int | None = None) -> bytes:
    """The file of documents with so many ids each, which follow one another in ids."""
    ids = np.asarray(ids, np.uint32)
    block = block or block_of(len(ids))
    small_ids = not len(ids) or int(ids.max()) < 1 << 24
    values, place, often = (None, ids, np.bincount(ids)) if small_ids else np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    alphabet, rank_of = order if small_ids else values[order], np.zeros(len(often), np.uint32)
    rank_of[order] = np.arange(len(order))
    blocks = -(-len(ids) // block)
    ranks = np.zeros(blocks * block, np.uint32)  # the last block is filled up with rank 0, which the reader drops
    ranks[: len(ids)] = rank_of[place]
    often = often[order].astype("<u4")
    words = _encode_lanes(ranks.reshape(blocks, block), Order0(often)) if blocks else []
    little = ids.astype("<u4")
    table = np.array([(len(w), zlib.crc32(little[i * block : (i + 1) * block])) for i, w in enumerate(words)], "<u4")
    docs = np.zeros(len(doc_ids), _DOC)
    docs["doc_id"], docs["n"], docs["null"] = [d or 0 for d in doc_ids], counts, [d is None for d in doc_ids]
    tables = b"".join(x.tobytes() for x in (alphabet.astype("<u4"), often, docs, table))
    head = (MAGIC, len(docs), len(ids), len(alphabet), blocks, block)
    check = zlib.crc32(tables, zlib.crc32(_HEAD.pack(*head, 0)))
    return b"".join([_HEAD.pack(*head, check), tables, *[w.tobytes() for w in words]])


def read(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a file; Damaged where it is cut short or a checksum does not agree."""
    if len(data) < _HEAD.size or data[: len(MAGIC)] != MAGIC:
        raise Damaged("not a token-id file")
    *head, check = _HEAD.unpack_from(data)
    _, n_docs, n_ids, n_alphabet, n_blocks, block = head
    payload = _HEAD.size + 8 * n_alphabet + _DOC.itemsize * n_docs + 8 * n_blocks
    if len(data) < payload or check != zlib.crc32(data[_HEAD.size : payload], zlib.crc32(_HEAD.pack(*head, 0))):
        raise Damaged("the file's tables are not those that were written")
    at = _HEAD.size
    alphabet, often = np.frombuffer(data, "<u4", 2 * n_alphabet, at).reshape(2, -1)
    at += 8 * n_alphabet
    docs = np.frombuffer(data, _DOC, n_docs, at)
    table = np.frombuffer(data, "<u4", 2 * n_blocks, at + docs.nbytes).reshape(-1, 2)
    ends = payload + 4 * np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
    if len(data) != ends[-1]:
        raise Damaged("the file does not end where its blocks do")
    words = [np.frombuffer(data, "<u4", (z - a) // 4, a) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    ids = alphabet[_decode_lanes(words, block, Order0(often)).ravel()[:n_ids]] if n_blocks else np.zeros(0, np.uint32)
    for i in range(n_blocks):
        if zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4")) != table[i, 1]:
            raise Damaged(f"block {i}: checksum differs")
    names = [None if null else d for d, null in zip(docs["doc_id"].tolist(), docs["null"].tolist(), strict=True)]
    return names, docs["n"].astype(np.int64), ids


def write_files(docs: DataFrame, vocabulary: str | None = None, end: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """The files of the texts of docs, in ascending doc_id order. Texts are shuffled once, and encoded and coded where they arrive."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").withColumn("bucket", range_bucket(docs, "doc_id", parts))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"))

    def run(batches):
        names: list[int | None] = []
        held: list[np.ndarray] = []
        total, bucket, seq = 0, None, 0

        def close():
            nonlocal total, seq
            data = write(names, np.array([len(x) for x in held]), np.concatenate(held))
            row = [pa.array([v], t) for v, t in ((bucket, pa.int32()), (seq, pa.int32()), (len(names), pa.int64()), (total, pa.int64()), (data, pa.binary()))]
            seq += 1
            total = 0
            names.clear(), held.clear()
            return pa.RecordBatch.from_arrays(row, ["bucket", "seq", "n_docs", "n_ids", "data"])

        for b in batches:
            ids, offs = with_end(*encoder(path, letters=LETTERS).encode(b.column("text").to_pylist()), end)
            ids = ids.astype(np.uint32)
            for i, (doc, at) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("bucket").to_pylist(), strict=True)):
                if names and (at != bucket or total >= file_ids):
                    yield close()
                if at != bucket:
                    bucket, seq = at, 0
                names.append(doc)
                held.append(ids[offs[i] : offs[i + 1]])
                total += len(held[-1])
        if names:
            yield close()

    return arrow_map(rows, run, "bucket int, seq int, n_docs long, n_ids long, data binary", keep="tokens")


def read_files(files: DataFrame) -> DataFrame:
    """Every document of files: doc_id, start (ids of all documents before it), n_tokens and its ids (unsigned 32-bit, little-endian)."""

    def run(batches):
        for b in batches:
            for bucket, seq, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "seq", "data")), strict=True):
                docs, counts, ids = read(data)
                ids = ids.astype("<u4")
                ends = np.concatenate([[0], np.cumsum(counts)])
                for at in range(0, len(docs), 512):
                    to = min(len(docs), at + 512)
                    own = [ids[a:z].tobytes() for a, z in zip(ends[at:to], ends[at + 1 : to + 1], strict=True)]
                    cols = [pa.array([v] * (to - at), pa.int32()) for v in (bucket, seq)]
                    cols += [pa.array(docs[at:to], pa.int64()), pa.array(ends[at:to]), pa.array(counts[at:to]), pa.array(own, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["bucket", "seq", "doc_id", "_start", "n_tokens", "ids"])

    docs = arrow_map(files.select("bucket", "seq", "data"), run, "bucket int, seq int, doc_id long, _start long, n_tokens long, ids binary", rows=4)
    starts = offsets_before(files.select("bucket", "seq", "n_ids"), ["seq"], {"_before": "n_ids"}, "bucket").drop("n_ids")
    docs = docs.join(small(starts), ["bucket", "seq"])
    return docs.select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids")
