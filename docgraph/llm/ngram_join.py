"""N-gram Jaccard join: count-vector R-tree over shingle sets, with exact verification.

A text's set holds its distinct shingles of `width` words (A-Z lower-cased; fewer words: the whole sequence; no words: empty,
linked with nothing). Two sets link when den * |A & B| >= num * |A | B| for a likeness (num, den). The query takes four words and
85 / 100. Steps:

1. Texts with one set become one class.
2. In any one order of all shingles, two linked sets share one of their first |A| - ceil(num |A| / den) + 1. The order puts shingles
   that are frequent in a bounded sample last and the others in hash order. Classes that share such a first shingle meet; of
   shingles that the same classes share, the first is enough.
3. Shingles are hashed into GROUPS groups and a class is the point of its group counts. An R-tree over the points of those that meet
   finds, for each class, the earlier one whose overlap may be largest, bounded by the summed minima of coordinates (of a node: its
   maxima). These pairs are verified, and the links so found join most of a group of near copies.
4. Where classes of several components still meet, the tree yields all pairs across components whose overlap can be large
   enough, and these are verified. Where many meet, they are dealt into blocks by size and hash; each pair of blocks whose
   sizes allow a link is searched, so no task holds more than two blocks and none is left out. A pair that meets in several
   shingles is a row in the first of them alone, so copies of one passage do not multiply the pairs by its length.
5. To verify, pairs are bounded once more with as many groups as their sizes ask for, then compared by whole sets. Components
   are taken over all links.

Null texts are empty. Rows that repeat a doc_id with different texts are texts of their own. Rows with a null doc_id cannot be named: they
get their set's size and their group's component, if it has a name, but add no link. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, dealt_join, fresh, hot_counts, hot_keys, small, stored
from .components import components
from .words import U, shingle_hashes, text_bytes, word_hashes

WIDTH = 4
#: A least likeness (num, den): link when num * |A | B| <= den * |A & B|.
Likeness = tuple[int, int]
LIKENESS: Likeness = (85, 100)
GROUPS = 128
#: Classes in a block of those that meet; children of a node.
BLOCK, FANOUT = 512, 32
#: Of the shingles in which a class meets others, so many first ones tell whether a pair has met before.
HEADS = 64
#: The bounded sample that the order of shingles is fit on, and how many frequent ones it puts last.
SAMPLE_DOCS, FREQUENT, LEAST_SEEN = 4000, 50_000, 4


def batch_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, offs = word_hashes(*text_bytes(column))
    runs, to = shingle_hashes(words, offs, width)
    for i in range(len(to) - 1):
        yield np.unique(runs[to[i] : to[i + 1]])


def counted(s: np.ndarray, bits: int) -> np.ndarray:
    """Group counts of a set; groups are ranges of hashes, so summing neighbours gives the counts of half as many groups. In 8
    bits each, or in 16 or 32 where one needs them."""
    counts = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    most = int(counts.max())
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def fine(s: np.ndarray) -> np.ndarray:
    """Group counts with about eight shingles a group, so that large sets are told apart as well as small ones, in 16 bits. A count
    of these needs more only beyond 4 billion shingles, which no text has."""
    return counted(s, min(16, max(6, (len(s) // 8).bit_length()))).astype("<u2")


def digest_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles seen in LEAST_SEEN or more documents of the sample, rarest first; at most FREQUENT of them."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64)
    u = F.xxhash64("doc_id", F.lit(3)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))

    def run(batches):
        for b in batches:
            sets = [s.view(np.int64) for s in batch_sets(b.column(0), width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["s"])

    seen = arrow_map(docs.filter(u < min(1.0, SAMPLE_DOCS / n)).select("text"), run, "s long").groupBy("s").agg(F.count("*").alias("n"))
    top = seen.filter(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "s").limit(FREQUENT).collect()
    return np.array([r["s"] for r in reversed(top)], np.int64).view(np.uint64)


def sets_table(docs: DataFrame, common: np.ndarray, width: int, likeness: Likeness) -> DataFrame:
    """doc_id, n (size of its set), digest of the set, its first shingles in the order, its group counts and its fine ones."""
    num, den = likeness
    by_hash = np.argsort(common)
    sorted_common = common[by_hash]

    def run(batches):
        for b in batches:
            n, digest, first, counts, finer = [], [], [], [], []
            for s in batch_sets(b.column("text"), width):
                n.append(len(s))
                digest.append(digest_of(s))
                k = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                if len(sorted_common) and len(s):
                    at = np.minimum(np.searchsorted(sorted_common, s), len(sorted_common) - 1)
                    late = sorted_common[at] == s
                    own = s[~late]
                    if len(own) < k:
                        own = np.concatenate([own, common[np.sort(by_hash[at[late]])]])
                else:
                    own = s
                first.append(own[:k].view(np.int64))
                counts.append(counted(s, GROUPS.bit_length() - 1).tobytes() if len(s) else None)
                finer.append(fine(s).tobytes() if len(s) else None)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(counts, pa.binary()), pa.array(finer, pa.binary())], ["doc_id", "n", "digest", "first", "counts", "fine"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n long, digest binary, first array<long>, counts binary, fine binary")


class CountTree:
    """An R-tree over count vectors, packed by size and then by the first coordinates."""

    def __init__(self, points: np.ndarray, likeness: Likeness = LIKENESS):
        self.points, self.likeness = points, likeness
        self.sizes = points.sum(1)
        self.order = np.lexsort((points[:, 1], points[:, 0], self.sizes)) if len(points) else np.zeros(0, np.int64)
        self.levels = []  # from leaves up: the coordinates' maxima, the least and the largest size of each node
        top, low, high = points[self.order], self.sizes[self.order], self.sizes[self.order]
        while len(top) > 1 or not self.levels:
            cuts = np.arange(0, len(top), FANOUT)
            if not len(cuts):
                break
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray) -> np.ndarray:
        """Rows whose overlap with point may link them."""
        n, (num, den) = int(point.sum()), self.likeness
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.zeros(0, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            bound = np.minimum(np.minimum(top[nodes], point).sum(1), n)
            keep = (num + den) * bound >= num * (n + low[nodes])
            keep &= (den * n >= num * low[nodes]) & (den * high[nodes] >= num * n)
            nodes = nodes[keep]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < below]
        rows = self.order[nodes]
        bound = np.minimum(self.points[rows], point).sum(1)
        return rows[(num + den) * bound >= num * (n + self.sizes[rows])]


def small_group_pairs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within each of the groups, whose rows follow one another; each group fits one leaf of the tree."""
    n = len(group)
    ends = np.searchsorted(group, group, "right")
    counts = ends - np.arange(n) - 1
    left = np.repeat(np.arange(n), counts)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)


def bounded_pairs(rows: Meeting, likeness: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j of the pairs of rows of one group whose overlap may link them, and the bound. Only pairs of different components; where
    a group joins two blocks, only pairs across them. pos: how many shingles of its own a class has before the one they meet in. If
    that is the first they share, no more than what follows in both can be; if it is not, the pair is judged where it is."""
    num, den = likeness
    sizes = rows.points.sum(1)
    after = sizes - rows.pos

    def judged(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        need = num * (sizes[i] + sizes[j])
        keep = (rows.comp[i] != rows.comp[j]) & ((num + den) * np.minimum(after[i], after[j]) >= need)
        i, j, need = i[keep], j[keep], need[keep]
        bound = np.concatenate([np.minimum(rows.points[i[k : k + 8192]], rows.points[j[k : k + 8192]]).sum(1) for k in range(0, len(i), 8192)] or [np.zeros(0, np.int64)])
        keep = (num + den) * bound >= need
        return i[keep], j[keep], bound[keep]

    count = np.bincount(rows.group) if len(rows.group) else np.zeros(0, np.int64)
    leaf = (count[rows.group] <= FANOUT) & ~rows.two
    at = np.flatnonzero(leaf)
    i, j = small_group_pairs(rows.group[at])
    found = [judged(at[i[k : k + 1 << 20]], at[j[k : k + 1 << 20]]) for k in range(0, len(i), 1 << 20)]
    for g in np.unique(rows.group[~leaf]).tolist():
        at = np.arange(*np.searchsorted(rows.group, [g, g + 1]))
        part = rows.part[at]
        two = bool(rows.two[at[0]])
        left, right = (at[part == part.min()], at[part == part.max()]) if two else (at, at)
        if two and part.min() == part.max():
            continue  # the other block is empty; this one meets itself elsewhere
        tree = CountTree(rows.points[right], likeness)
        for x in left.tolist():
            y = right[tree.search(rows.points[x])]
            found.append(judged(np.full(len(y), x), y) if two else judged(np.full((y > x).sum(), x), y[y > x]))
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))  # type: ignore[return-value]


@dataclass
class Meeting:
    """Rows of whole groups that meet, one group after another."""

    group: np.ndarray
    cid: np.ndarray
    comp: np.ndarray
    points: np.ndarray
    part: np.ndarray
    two: np.ndarray
    pos: np.ndarray


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // GROUPS}").astype(np.int64)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, likeness: Likeness) -> DataFrame:
    """Of pairs (a, b) those that link: first by fine counts, a sixteenth of the bytes or less, then by the whole sets."""
    near = stored(_compared(pairs, classes.select("cid", F.col("fine").alias("s")), lambda a, b: _may_link(a, b, likeness), "<u2"), "ngram-near")
    wanted = near.select(F.col("a").alias("cid")).union(near.select(F.col("b").alias("cid"))).distinct()
    wanted = classes.select("cid", F.col("rep").alias("doc_id"), "digest").join(small(wanted), "cid", "left_semi")

    def sets(batches):
        for b in batches:
            cids, found = [], []
            for cid, digest, s in zip(b.column("cid").to_pylist(), b.column("digest").to_pylist(), batch_sets(b.column("text"), width), strict=True):
                if digest_of(s) == digest:  # one doc_id may have several texts
                    cids.append(cid), found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(found, pa.binary())], ["cid", "s"])

    whole = arrow_map(docs.join(small(wanted), "doc_id").select("cid", "digest", "text"), sets, "cid long, s binary").dropDuplicates(["cid"])
    return _compared(near, whole, lambda a, b: _linked(a, b, likeness), "<u8")


def _compared(pairs: DataFrame, sets: DataFrame, test: Callable, kind: str) -> DataFrame:
    """Of pairs (a, b) those that pass test by their sets (cid, s). Pairs are dealt by a, those of a hot a by the hash of b as well, so
    a task holds one set and looks at others one after another; no more than two sets go out for a pair."""
    hot = hot_keys(pairs, "a")
    pairs = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"))
    first = pairs.select("a", "_salt").distinct().join(sets.withColumnRenamed("cid", "a"), "a").select("a", "_salt", F.lit(None).cast("long").alias("b"), "s")
    rows = first.unionByName(pairs.join(sets.withColumnRenamed("cid", "b"), "b").select("a", "_salt", "b", "s"))
    rows = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "_salt").sortWithinPartitions("a", "_salt", F.asc_nulls_first("b"))

    def run(batches):
        own = None
        for batch in batches:
            out = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("s"), strict=True):
                if b is None:
                    own = np.frombuffer(s.as_py(), kind)
                elif test(own, np.frombuffer(s.as_py(), kind)):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return arrow_map(rows.select("a", "b", "s"), run, "a long, b long", rows=256)


def _may_link(a: np.ndarray, b: np.ndarray, likeness: Likeness) -> bool:
    num, den = likeness
    while len(a) > len(b):
        a = a.reshape(-1, 2).sum(1)
    while len(b) > len(a):
        b = b.reshape(-1, 2).sum(1)
    return (num + den) * int(np.minimum(a, b).sum()) >= num * (int(a.sum()) + int(b.sum()))


def _linked(a: np.ndarray, b: np.ndarray, likeness: Likeness) -> bool:
    num, den = likeness
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return den * both >= num * (len(a) + len(b) - both)


def blocked(meet: DataFrame, classes: DataFrame, likeness: Likeness) -> DataFrame:
    """meet (tok, k, pos, cid, ..) with its block and the pair of blocks (lo, hi) in which a row is searched, a row for each. BLOCK classes or fewer
    are one block; more are dealt by level, the logarithm of their size to a base at which linked sizes differ by one level or
    less, and by hash within a level."""
    num, den = likeness
    base = math.log(den / num) * 1.001
    single = meet.filter(F.col("k") <= BLOCK).withColumns({c: F.lit(0).cast("long") for c in ("own", "lo", "hi")})
    rows = meet.filter(F.col("k") > BLOCK).join(classes.select("cid", "n"), "cid").withColumn("level", F.floor(F.log("n") / base).cast("int"))
    cells = rows.groupBy("tok", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("c"))
    cells = cells.groupBy("tok").agg(F.map_from_entries(F.collect_list(F.struct("level", "c"))).alias("cells"))  # levels are few
    rows = dealt_join(rows, cells, "tok", "cid", hot_keys(rows, "tok"))
    code = lambda level, cell: level.cast("long") * (1 << 32) + cell
    rows = rows.withColumn("own", code(F.col("level"), F.pmod(F.xxhash64("cid"), F.element_at("cells", F.col("level"))).cast("long")))
    here = lambda d: F.coalesce(F.try_element_at("cells", F.col("level") + d), F.lit(0))
    at = lambda d: F.when(here(d) > 0, F.transform(F.sequence(F.lit(0), here(d) - 1), lambda c: code(F.col("level") + d, c))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("other", F.explode(F.concat(at(-1), at(0), at(1))))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return single.select(*meet.columns, "own", "lo", "hi").unionByName(rows.select(*meet.columns, "own", "lo", "hi"))


def heads_of(meet: DataFrame) -> DataFrame:
    """(cid, heads): the first HEADS shingles in which a class meets others, in the order of all shingles."""
    met = F.slice(F.array_sort(F.collect_list(F.struct("pos", "tok"))), 1, HEADS)  # one class's first shingles
    return meet.groupBy("cid").agg(F.transform(met, lambda x: x["tok"]).alias("heads"))


def first_met(i: np.ndarray, j: np.ndarray, earlier: pa.ChunkedArray) -> np.ndarray:
    """Which of the pairs of rows i, j share none of the shingles that either has before the one they meet in. The order is one for all
    texts, so a pair passes in the first shingle in which it meets, and beyond HEADS perhaps in others too, but never in none."""
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    before = [frozenset(x) for x in earlier.take(pa.array(rows)).to_pylist()]
    return np.fromiter((before[x].isdisjoint(before[y]) for x, y in at.reshape(2, -1).T.tolist()), bool, len(i))


def searched(meet: DataFrame, classes: DataFrame, heads: DataFrame, likeness: Likeness, best: bool) -> DataFrame:
    """meet: (tok, k, pos, cid, comp), heads: heads_of() it or of more. The pairs (a, b), a < b, of different components that meet and may
    link by their counts; best: for each b only the a with the largest share of common counts."""
    spark = meet.sparkSession
    rows = blocked(meet, classes, likeness).join(classes.select("cid", "counts"), "cid").join(heads, "cid")
    place = F.array_position("heads", F.col("tok")).cast("int")
    rows = rows.withColumn("earlier", F.when(place > 0, F.slice("heads", F.lit(1), F.greatest(place - 1, F.lit(0)))).otherwise(F.col("heads")))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "tok", "lo", "hi").sortWithinPartitions("tok", "lo", "hi")
    rows = rows.select("tok", "lo", "hi", "own", "cid", "comp", "pos", "counts", "earlier")

    def pairs_of(held: list[pa.RecordBatch], open_: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        """Pairs of the groups held, and the rows of the last one, if more of it may come."""
        table = pa.Table.from_batches(held).combine_chunks()
        tok, lo, hi, own, cid, comp, pos = (table.column(c).to_numpy() for c in ("tok", "lo", "hi", "own", "cid", "comp", "pos"))
        new = np.append(True, (tok[1:] != tok[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
        group = np.cumsum(new) - 1
        end = int(np.flatnonzero(new)[-1]) if open_ else len(tok)
        points = np.array([_vector(v) for v in table.column("counts").slice(0, end).to_pylist()]).reshape(-1, GROUPS)
        meeting = Meeting(group[:end], cid[:end], comp[:end], points, own[:end], (lo != hi)[:end], pos[:end].astype(np.int64))
        i, j, bound = bounded_pairs(meeting, likeness)
        once = first_met(i, j, table.column("earlier"))
        i, j, bound = i[once], j[once], bound[once]
        a, b = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
        sizes = points.sum(1)
        score = bound / np.maximum(1, sizes[i] + sizes[j] - bound)
        keep = np.arange(len(a))
        if best and len(a):
            order = np.lexsort((a, -score, b))
            keep = order[np.append(True, b[order][1:] != b[order][:-1])]
        out = pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(score[keep])], ["a", "b", "score"])
        return out, table.slice(end).to_batches()[0] if open_ else None

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            last = held[0].slice(0, 1).select(["tok", "lo", "hi"]).to_pylist() == batch.slice(batch.num_rows - 1).select(["tok", "lo", "hi"]).to_pylist()
            if n >= 4096 and not last:  # else they all are one group, which is two blocks at most
                out, rest = pairs_of(held, True)
                held, n = ([rest], rest.num_rows) if rest is not None else ([], 0)
                yield out
        if held:
            yield pairs_of(held, False)[0]

    found = arrow_map(rows, run, "a long, b long, score double", rows=2048)
    if not best:
        return found.select("a", "b").distinct()
    return found.groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a")).select("a", "b")


def classes_of(docs: DataFrame, width: int = WIDTH, likeness: Likeness = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n and digest of every row of docs; and of every class with a named document its digest, cid, n, rep
    (least doc_id), n_links (to other classes, as found), group and component_id (least doc_id of the group)."""
    docs = docs.select("doc_id", "text")
    table = stored(sets_table(docs, frequent(docs, width), width, likeness), "ngram-sets")
    classes = table.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "first", "counts", "fine")])
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")
    posts = classes.select("cid", F.posexplode("first").alias("pos", "tok"))
    shared = stored(posts.groupBy("tok").agg(F.count("*").alias("k")).filter("k > 1"), "ngram-shared")
    hot = hot_counts(shared, "tok", "k", shared.agg(F.coalesce(F.sum("k"), F.lit(0))).head()[0])
    every = stored(dealt_join(posts, shared, "tok", "cid", hot), "ngram-every")
    h = F.xxhash64("cid")  # of all shingles that the same classes share, the first is enough
    who = [F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 32)).alias("y"), F.count("*").alias("n"), F.sum("pos").alias("at")]
    firsts = every.groupBy("tok").agg(*who).groupBy("x", "y", "n").agg(F.min_by("tok", F.struct("at", "tok")).alias("tok"))
    firsts = stored(firsts.select("tok"), "ngram-firsts")
    meet = stored(dealt_join(every, firsts, "tok", "cid", hot), "ngram-meet", done=[every, firsts])
    heads = stored(heads_of(meet), "ngram-heads")
    tries = stored(searched(meet.withColumn("comp", F.col("cid")), classes, heads, likeness, best=True), "ngram-tries")
    linked = stored(_verified(tries, docs, classes, width, likeness), "ngram-links")
    comp = components(linked)
    named = meet.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    named = stored(named, "ngram-named", done=[meet])
    several = stored(named.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("tok"), "ngram-several")
    again = stored(dealt_join(named, several, "tok", "cid", hot), "ngram-again", done=[named, several, shared])
    pairs = stored(searched(again, classes, heads, likeness, best=False).join(tries, ["a", "b"], "left_anti"), "ngram-pairs", done=[again, tries, heads])
    links = stored(linked.union(_verified(pairs, docs, classes, width, likeness)), "ngram-links", done=[linked, pairs])
    degree = links.select(F.col("a").alias("cid")).union(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n_links"))
    out = classes.select("digest", "cid", "n", "rep").join(degree, "cid", "left").join(components(links).withColumnRenamed("node", "cid"), "cid", "left")
    out = stored(out.select("digest", "cid", "n", "rep", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "cid").alias("group")), "ngram-groups")
    least = out.groupBy("group").agg(F.min("rep").alias("component_id"))
    return table.select("doc_id", "n", "digest"), out.join(least, "group")


def join(docs: DataFrame, width: int = WIDTH, likeness: Likeness = LIKENESS) -> DataFrame:
    """doc_id, n_shingles, n_links (of its class to others, as found) and component_id of every row of docs."""
    rows, classes = classes_of(docs, width, likeness)
    out = dealt_join(rows, classes.select("digest", "component_id", "n_links"), "digest", "doc_id", hot_keys(rows, "digest"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


def survivors(docs: DataFrame, width: int = WIDTH, likeness: Likeness = LIKENESS) -> DataFrame:
    """The rows of docs without near copies: of each group the text with the least doc_id stays, once. A doc_id that stands for one row
    decides by itself, and no text is shuffled for it (unless those that go are too many to broadcast). Rows that share a doc_id with
    other rows, or have none, are judged one by one by their texts: of several like texts the least stays, and a text without a
    named copy is a group with its equals. Texts without words are linked with nothing and all stay."""
    rows, classes = classes_of(docs, width, likeness)
    first = classes.groupBy("group").agg(F.min(F.struct("rep", "digest")).alias("first"))
    verdict = classes.join(first, "group").select("digest", F.col("first.rep").alias("chosen"), (F.col("first.digest") == F.col("digest")).alias("is_first"))
    verdict = stored(verdict, "ngram-verdict")
    judged = dealt_join(rows, verdict, "digest", "doc_id", hot_keys(rows, "digest"), "left")
    stays = F.col("digest").isNull() | F.coalesce(F.col("is_first") & (F.col("chosen") == F.col("doc_id")), F.lit(False))
    counted_ = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(stays).alias("stays"))
    counted_ = stored(counted_, "ngram-counted")
    gone = counted_.filter("n > 1 or not stays").select("doc_id")
    once = docs.filter("doc_id is not null").join(small(gone), "doc_id", "left_anti")
    several = docs.filter("doc_id is null").unionByName(docs.join(small(counted_.filter("n > 1").select("doc_id")), "doc_id", "left_semi").select(*docs.columns))
    if not several.select("doc_id").limit(1).count():
        return once.select(*docs.columns)
    names = [fresh(docs, n) for n in ("_digest", "_place", "_text_hash")]
    digest, place, hashed = names

    def digests(batches):
        for b in batches:
            found = [digest_of(s) for s in batch_sets(b.column("text"), width)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, digest])

    held = several.withColumns({place: F.monotonically_increasing_id(), hashed: F.xxhash64("text")})
    held = stored(arrow_map(held, digests, T.StructType([*held.schema.fields, T.StructField(digest, T.BinaryType())])), "ngram-several")
    alike = held.select(F.col(digest).alias("digest"), "doc_id", F.struct(F.col(hashed), F.col(place)).alias("row"))
    alike = dealt_join(alike, verdict, "digest", "doc_id", hot_keys(alike, "digest"), "left")
    alike = alike.filter(F.col("digest").isNull() | F.col("chosen").isNull() | (F.col("is_first") & F.col("doc_id").eqNullSafe(F.col("chosen"))))
    least = alike.filter("digest is not null").groupBy("digest").agg(F.min("row").alias("row")).select(F.col("row")[place].alias(place))
    least = least.union(alike.filter("digest is null").select(F.col("row")[place].alias(place)))
    return once.select(*docs.columns).unionByName(held.join(small(least), place, "left_semi").select(*docs.columns))
