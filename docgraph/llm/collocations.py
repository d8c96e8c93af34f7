"""Phrase collocations by language: count tries of bounded shards, merged by prefix range; parts of a phrase by walks and suffix links.

Texts are lower-cased (A-Z), cut into pieces at [.,;:!?] and U+000A to U+000D, and pieces into words at spaces and tabs. A phrase's frequency
f is the number of its places inside pieces, overlaps included; n is the number of words of a language.

1. Words and pairs of neighbours are counted by 64-bit hashes. What reaches the least frequency sets bits of a bitmap of bounded size. A hash or
   bit that two share lets too much through and never hides anything: every part of a frequent phrase is frequent itself.
2. Each shard (a task's next SHARD words) builds a trie as deep as the longest phrase, of exact words, but only along pairs that the bitmap knows. Its
   nodes are serialised in order, in blocks. Blocks are cut at the bounds of prefix ranges that hold about RANGE nodes each, and the runs of a range are merged.
3. A candidate's first parts are its ancestors, the rests are what its suffix links lead to: both are nodes of the merged trie, as frequent as it at least.
   Hot nodes are dealt. A node is inside a longer candidate as frequent as itself only if it is inside one that is longer by one word.

Null and empty texts have no words. Texts of any length are cut nowhere but at pieces. Rows count as often as they are there, whatever their doc_id;
no column but text and lang is read. Ties are broken as `mine` says. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, dealt_join, discard, hot_keys, stored
from .words import mixed, span_hashes, spans, text_bytes

#: The language of rows without one.
UNKNOWN = "und"
#: Words that one trie holds, keys that are counted before they are handed on, and rows of a batch that a worker gives back.
SHARD, KEYS, BATCH = 1 << 20, 1 << 21, 1 << 15
#: Nodes of a prefix range before it is merged, runs that are merged at once, and blocks whose first nodes the bounds are chosen from.
RANGE, RUNS, SAMPLE_BLOCKS = 1 << 20, 16, 100_000
#: Bits of the bitmap: 16 for each frequent word and pair, between these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29

U = np.uint64
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


class Words:
    """The words of a batch: their spans and hashes, their texts' languages, and whether the next word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offs = text_bytes(batch.column("text"))
        broken = _class(BREAKS)[data]
        self.data = data
        self.begin, self.end = spans(broken | _class(BLANKS)[data], offs)
        self.hash = span_hashes(data, self.begin, self.end)
        at, breaks = np.searchsorted(self.begin, offs), np.flatnonzero(broken)
        coded = batch.column("lang").fill_null(UNKNOWN).dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        self.lang = np.repeat(coded.indices.to_numpy().astype(np.int32), np.diff(at))
        piece = np.searchsorted(breaks, self.begin) + np.repeat(np.arange(len(offs) - 1), np.diff(at))  # grows at breaks and texts
        self.next = np.append(piece[1:] == piece[:-1], False)[: len(self.hash)]
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        own = mixed(self.hash ^ salts[self.lang]) if len(self.hash) else self.hash
        self.one = own  # a key by language and word
        self.two = mixed(own[:-1] * U(0x9E3779B97F4A7C15) + mixed(own[1:])) if len(own) else own  # by pair; of those with next

    def text(self, i: int) -> str:
        return bytes(self.data[self.begin[i] : self.end[i]]).decode("utf-8", "replace")


def _sliced(rows: pa.RecordBatch):
    return (rows.slice(at, BATCH) for at in range(0, rows.num_rows, BATCH))


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def frequent_bitmap(docs: DataFrame, least: int) -> bytes:
    """Bits of the keys of words and pairs that a language has least times or more."""

    def run(batches):
        held, n = [], 0

        def counts():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times, pa.int64())], ["key", "n"])

        for b in batches:
            w = Words(b)
            for keys in (w.one, w.two[w.next[:-1]]):
                held.append(keys)
                n += len(keys)
            if n >= KEYS:
                yield from _sliced(counts())
                held, n = [], 0
        if n:
            yield from _sliced(counts())

    keys = arrow_map(docs, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")
    keys = stored(keys, "collocation-keys")
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * keys.count()).bit_length()))
    bit = F.col("key").bitwiseAND(F.lit(bits - 1))
    blocks = keys.select(F.shiftright(bit, 15).alias("k"), bit.bitwiseAND(F.lit(32767)).alias("b")).groupBy("k").agg(F.bitmap_construct_agg("b").alias("m"))
    out = bytearray(bits // 8)
    for r in blocks.toLocalIterator():  # MOST_BITS / 32768 rows of 4 KiB at most
        out[r["k"] * 4096 : r["k"] * 4096 + 4096] = r["m"]
    discard(keys)
    return bytes(out)


class Trie:
    """Counts of the phrases of a shard up to a depth, by level: each node has a parent, a word and a count."""

    def __init__(self, depth: int):
        self.depth, self.langs, self.known = depth, {}, {}
        self.clear()

    def clear(self) -> None:
        self.hash, self.lang, self.follows, self.n, self.words = [], [], [], 0, np.zeros(0, np.int64)
        self.known.clear()

    def add(self, w: Words, one: np.ndarray, two: np.ndarray) -> None:
        """one: which words are counted; two: which are followed by a word with which they are a pair."""
        ids = np.array([self.langs.setdefault(x, len(self.langs)) for x in w.langs], np.int64)
        lang = ids[w.lang] if len(w.lang) else np.zeros(0, np.int64)
        totals = np.bincount(lang, minlength=len(self.langs))
        self.words = np.pad(self.words, (0, len(totals) - len(self.words))) + totals
        kept = np.flatnonzero(one)
        hashes, first = np.unique(w.hash[kept], return_index=True)
        for h, i in zip(hashes.tolist(), kept[first].tolist(), strict=True):
            if h not in self.known:
                self.known[h] = _lower(w.text(i))
        self.hash.append(w.hash[kept])
        self.lang.append(lang[kept])
        self.follows.append(two[kept])
        self.n += len(kept)

    def rows(self) -> pa.RecordBatch:
        """(node, n) of all nodes in order, those of whole languages included."""
        names = sorted(self.langs, key=self.langs.get)
        paths, counts = [pa.array([f"{x}\t" for x in names], pa.string())], [self.words]
        hashes = np.concatenate(self.hash) if self.hash else np.zeros(0, np.uint64)
        if len(hashes):
            word_hash, word = np.unique(hashes, return_inverse=True)
            texts = pa.array([self.known[h] for h in word_hash.tolist()], pa.string())
            parent, follows = np.concatenate(self.lang), np.concatenate(self.follows)
            alive = np.ones(len(word), bool)
            above = paths[0]
            for d in range(self.depth):
                if d:  # the word d places on continues the phrase if each of those before is followed
                    alive = alive[:-1] & follows[d - 1 : -1]
                    parent = parent[:-1]
                at = np.flatnonzero(alive)
                if not len(at):
                    break
                edges, node, n = np.unique(parent[at] * len(word_hash) + word[at + d], return_inverse=True, return_counts=True)
                ends = texts.take(pa.array(edges % len(word_hash)))
                above = pc.binary_join_element_wise(above.take(pa.array(edges // len(word_hash))), ends, " " if d else "")
                paths.append(above)
                counts.append(n)
                parent = np.full(len(parent), -1)
                parent[at] = node
        out = pa.RecordBatch.from_arrays([pa.concat_arrays(paths), pa.array(np.concatenate(counts), pa.int64())], ["node", "n"])
        self.clear()
        self.langs = {}
        self.words = np.zeros(0, np.int64)
        return out.take(pc.sort_indices(out.column("node")))


def _packed(rows: pa.RecordBatch) -> bytes:
    """Nodes in order as one value; front parts that neighbours share compress well."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def tries(docs: DataFrame, bitmap: bytes, depth: int) -> DataFrame:
    """(first, nodes, block): the tries of all shards, serialised in order, BATCH nodes a block. A node is its language, a tab and its words, a space between
    each two, and has a count."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # of bounded size

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        last = U(len(bits) * 8 - 1)

        def known(keys):
            place = (keys & last).astype(np.int64)
            return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

        def blocks():
            for rows in _sliced(trie.rows()):
                yield pa.RecordBatch.from_arrays([pa.array([rows.column("node")[0].as_py()]), pa.array([rows.num_rows], pa.int64()), pa.array([_packed(rows)], pa.binary())], ["first", "nodes", "block"])

        trie = Trie(depth)
        for b in batches:
            w = Words(b)
            one, two = known(w.one), w.next.copy()
            two[:-1] &= known(w.two) & one[1:]
            trie.add(w, one, two & one)
            if trie.n >= SHARD:
                yield from blocks()
        yield from blocks()

    return arrow_map(docs, run, "first string, nodes long, block binary")


def bounds(blocks: DataFrame) -> list[bytes]:
    """Where the prefix ranges begin but for the first: quantiles of the blocks' first nodes, of a bounded sample where there are many."""
    size = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes")).head()
    parts = min(-(-size["nodes"] // RANGE), size["blocks"])
    if parts < 2:
        return []
    share = min(1.0, SAMPLE_BLOCKS / size["blocks"])
    firsts = sorted(r["first"].encode() for r in blocks.filter(F.pmod(F.xxhash64("first", "nodes"), F.lit(1 << 20)) < share * (1 << 20)).select("first").collect())
    return sorted({firsts[len(firsts) * i // parts] for i in range(1, parts)}) if firsts else []


def merged(blocks: DataFrame, least: int) -> DataFrame:
    """(node, n) of the merged trie: the nodes of whole languages and those seen least times or more. The runs of a range of nodes in order go to one task
    and are merged, RUNS at a time, so that a task holds the different nodes of one range."""
    cuts = bounds(blocks)
    schema = pa.schema([("node", pa.string()), ("n", pa.int64())])

    def cut(batches):
        for b in batches:
            out = []
            for block in b.column("block"):
                rows = _unpacked(block.as_py()).combine_chunks().to_batches()[0]
                names = rows.column("node")
                low, high = (bisect_right(cuts, names[i].as_py().encode()) for i in (0, rows.num_rows - 1))
                if low == high:
                    out.append((low, block.as_py()))
                    continue
                own = [x.encode() for x in names.to_pylist()]
                at = [0, *(bisect_left(own, c) for c in cuts[low:high]), rows.num_rows]
                out += [(low + k, _packed(rows.slice(a, z - a))) for k, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], ["range", "run"])

    def total(runs: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(runs).group_by("node").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["node", "n"])

    def merge(batches):
        def kept():
            rows = total(runs)
            whole = pc.ends_with(rows.column("node"), "\t")
            return rows.filter(pc.or_(whole, pc.greater_equal(rows.column("n"), least))).cast(schema).combine_chunks().to_batches()

        at, runs = None, []
        for b in batches:
            for k, data in zip(b.column("range").to_pylist(), b.column("run"), strict=True):
                if k != at and runs:
                    yield from kept()
                    runs = []
                at = k
                runs.append(_unpacked(data.as_py()))
                if len(runs) >= RUNS:
                    runs = [total(runs)]
        if runs:
            yield from kept()

    ranged = arrow_map(blocks.select("block"), cut, "range int, run binary", rows=16).repartition("range").sortWithinPartitions("range")
    return arrow_map(ranged, merge, "node string, n long", rows=16)


def candidates(docs: DataFrame, least: int = 100, words: int = 5, covered: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 to `words` words seen `least` times or more, less those that a longer one holds with at least
    `covered` hundredths of their frequency. The score is the least floor(1000 * a * n / (l * r)) over all cuts, of which the first with it counts."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang"))
    shards = stored(tries(rows, frequent_bitmap(rows, least), words), "collocation-tries")
    trie = stored(merged(shards, least), "collocation-trie", done=[shards])
    lang, phrase = F.regexp_extract("node", r"(?s)^(.*)\t", 1), F.substring_index("node", "\t", -1)
    trie = trie.select("node", lang.alias("lang"), phrase.alias("phrase"), "n").withColumn("w", F.split("phrase", " "))
    nodes = trie.filter("phrase <> ''")
    name = lambda part: F.concat("lang", F.lit("\t"), F.array_join(part, " "))
    size = F.size("w")
    phrases = nodes.filter(size > 1)
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = phrases.select("node", "lang", "w", cut)
    ends = F.array(F.struct(F.lit(0).alias("side"), name(F.slice("w", F.lit(1), F.col("k"))).alias("part")), F.struct(F.lit(1).alias("side"), name(F.slice("w", F.col("k") + 1, size - F.col("k"))).alias("part")))
    links = stored(cuts.select("node", "k", F.explode(ends).alias("e")).select("node", "k", "e.side", "e.part"), "collocation-links")
    parts = dealt_join(links, nodes.select(F.col("node").alias("part"), F.col("n").alias("f")), "part", "node", hot_keys(links, "part"))
    parts = parts.groupBy("node", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    # each phrase covers those that lack its first or its last word
    inner = F.explode(F.array(name(F.slice("w", F.lit(1), size - 1)), name(F.slice("w", F.lit(2), size - 1)))).alias("node")
    cover = phrases.filter(size > 2).select(inner, F.col("n").alias("over")).groupBy("node").agg(F.max("over").alias("over"))
    totals = trie.filter("phrase = ''").groupBy("lang").agg(F.sum("n").alias("words"))
    found = phrases.join(cover, "node", "left").filter(F.expr(f"over IS NULL OR 100 * over < {covered} * n"))
    found = dealt_join(found.select("node", "lang", "phrase", F.col("n").alias("a")), totals, "lang", "node", hot_keys(phrases, "lang"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    found = found.join(parts, "node").withColumn("above", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("words").cast("decimal(15,0)")).withColumn("below", wide("l") * F.col("r").cast("decimal(18,0)"))
    best = found.groupBy("node", "lang", "phrase", "a", "words").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", F.col("words").alias("n"), "b.score")


def mine(docs: DataFrame, top: int = 2000, least: int = 100, words: int = 5) -> DataFrame:
    """The first `top` candidates of each language with their rank: by score and frequency, descending, then by phrase in the order of its UTF-8 bytes."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates(docs, least, words).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
