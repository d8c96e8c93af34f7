"""Filtered exact nearest-neighbour search and its query form."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab
from ..functions.scalar import cosine_distance, degenerate


@dataclass(frozen=True)
class Lookup:
    """One lookup of a search: any of its parts may be missing, not all. neighbors is None where none were asked for; an
    empty list asks for the neighbours of nothing."""

    query: tuple[float, ...] | None = None
    entry_type: tuple[str, ...] = ()
    exact_match: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    neighbors: tuple[tuple[str, str], ...] | None = None
    count: int = vocab.LOOKUP_COUNT

    def __post_init__(self) -> None:
        if not (self.query or self.entry_type or self.exact_match or self.source or self.neighbors is not None):
            raise ValueError("a lookup needs at least one predicate")


@dataclass(frozen=True)
class ToolCall:
    lookups: tuple[Lookup, ...]
    plan: str = ""
    dropped: tuple[str, ...] = field(default=())


def tool_call(raw: dict) -> ToolCall:
    """A tool call of loose JSON: lists are capped, counts clamped to 1..20, unknown kinds dropped, at most three lookups."""
    listed = lambda v: tuple(str(x).strip() for x in (v if isinstance(v, list) else [v]) if x is not None and str(x).strip())
    out, dropped = [], []
    items = raw.get("lookups") or raw.get("queries") or []
    for item in items if isinstance(items, list) else [items]:
        if not isinstance(item, dict):
            dropped.append("not an object")
            continue
        try:
            count = max(1, min(vocab.LOOKUP_MAX, int(item.get("count") or item.get("k") or vocab.LOOKUP_COUNT)))
        except (TypeError, ValueError):
            count = vocab.LOOKUP_COUNT
        near = item.get("has_neighbor")
        anchors = None if near is None else tuple(tuple(x.split("/", 1)) for x in listed(near) if "/" in x)
        kinds = tuple(k for k in listed(item.get("entry_type")) if k in vocab.RECORD_KINDS)
        try:
            out.append(Lookup(item.get("query") or None, kinds, listed(item.get("exact_match"))[:8], listed(item.get("source"))[:8], anchors, count))
        except ValueError as e:
            dropped.append(str(e))
    return ToolCall(tuple(out[: vocab.LOOKUPS_MAX]), str(raw.get("plan") or "")[:500], tuple(dropped))


def any_contains(column: Column, needles: tuple[str, ...]) -> Column:
    """Whether the column holds any needle, whatever its case; no needles hold nothing back."""
    if not needles:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(n.lower()) for n in needles]), lambda n: F.contains(F.lower(column), n))


def where(records: DataFrame, kinds: tuple = (), exact: tuple = (), files: tuple = (), neighbors: DataFrame | None = None) -> DataFrame:
    """The AND of: kind in kinds; text holds any of exact; file holds any of files; (kind, record_id) among neighbors."""
    out = records.filter(F.col("kind").isin(*kinds)) if kinds else records
    if exact:
        out = out.filter(any_contains(F.col("text"), exact))
    if files:
        out = out.filter(any_contains(F.col("file_id"), files))
    return out if neighbors is None else out.join(neighbors.select("kind", "record_id").distinct(), ["kind", "record_id"], "left_semi")


def neighbors_of(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(kind, record_id) one edge away from anchors (kind, record_id)."""
    a = anchors.select(F.col("kind").alias("src_kind"), F.col("record_id").alias("src_id")).distinct()
    return edges.join(a, ["src_kind", "src_id"], "left_semi").select(F.col("dst_kind").alias("kind"), F.col("dst_id").alias("record_id")).distinct()


def nearest(records: DataFrame, query: Column, k: int, vector: str = "embedding", order: str = "rowid", floor: float | None = None) -> DataFrame:
    """The k records nearest to query by cosine distance, filters having been applied before; with floor, only nearer ones."""
    out = records.withColumn("distance", cosine_distance(F.col(vector), query))
    return (out if floor is None else out.filter(F.col("distance") <= floor)).orderBy("distance", order).limit(k)


#: Records and queries of one tile; a task holds one tile of each.
TILE = 4096

#: Queries of a tile whose distances to the other tile are worked out at once, and pairs that are summed in order at once.
BLOCK, PAIRS = 512, 1 << 16


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column with most rows' length as doubles, and the places of their rows; rows without a whole vector have none."""
    vectors = [None if v is None or any(x is None for x in v) else v for v in column.to_pylist()]
    sizes = Counter(len(v) for v in vectors if v is not None)
    size = sizes.most_common(1)[0][0] if sizes else 0
    if len(sizes) > 1:
        raise ValueError("vectors of one search need one length")
    at = np.array([i for i, v in enumerate(vectors) if v is not None], np.int64)
    return np.array([vectors[i] for i in at], np.float64).reshape(len(at), size), at


def _in_order(e: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs (record i, query j), summed in the order of cosine_distance()."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        products = e[i[at : at + PAIRS]] * q[j[at : at + PAIRS]]
        total = np.zeros(len(products))
        for k in range(products.shape[1]):
            total += products[:, k]
        out[at : at + PAIRS] = 1.0 - total
    return out


def _blocks(e: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """(first query, distances by query and record, bound of their error) of a tile's queries in blocks; the products are summed in any order."""
    most = float(np.abs(e).max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, e.shape[1])
    for at in range(0, len(q), BLOCK):
        yield at, 1.0 - q[at : at + BLOCK] @ e.T, 1e-12 * (1.0 + most)


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """round() of Spark: halves away from zero, by the shortest decimal form of a double."""
    scaled = x * 10.0**places
    out = np.rint(scaled) / 10.0**places + 0.0
    near = np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-5)
    for i in near.tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0
    return out


def met(records: DataFrame, queries: DataFrame, id_: str, run: Callable, schema: str, vector: str = "embedding") -> DataFrame:
    """Every record (rowid, vector) meets every query (id_, query), tile by tile: tiles are dealt by hash, each pair of tiles is a key of its own, and run tells a
    pair's rows from two Arrow tables. What is shuffled is each side once for each tile of the other; a task holds two tiles, however many rows there are."""
    n, m = (max(1, -(-df.count() // TILE)) for df in (records, queries))
    tile = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    a = records.select("rowid", F.col(vector).alias("v"), tile("rowid", n).alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_b"))
    b = queries.select(id_, F.col("query").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_a"), tile(id_, m).alias("_b"))
    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(run, schema)


def nearest_each(records: DataFrame, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """For every query (query_id, query) of a stated set its k nearest records. A pair of tiles keeps k a query: products of matrices say which records may be
    among them, and these are summed in order, so that equal distances are equal; ranks follow over what the tiles kept."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        e, rows = _matrix(left["v"])
        q, asked = _matrix(right["v"])
        rowid, ids = left["rowid"].to_numpy()[rows], right["query_id"].to_numpy()[asked]
        found = []
        for at, d, error in _blocks(e, q) if len(e) and len(q) else ():
            least = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            j, i = np.nonzero(~(d > (least + 2e-6 + 2 * error)[:, None]))
            distance = rounded(_in_order(e, q, i, j + at))
            order = np.lexsort((rowid[i], distance, j))
            i, j, distance = i[order], j[order], distance[order]
            place = np.arange(len(j)) - np.searchsorted(j, j)
            top = place < k
            found.append((ids[j[top] + at], rowid[i[top]], distance[top]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "rowid", "distance"), columns, strict=True)))

    kept = met(records, queries, "query_id", run, "query_id long, rowid long, distance double", vector)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "rowid"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k)


def hits_each(records: DataFrame, queries: DataFrame, floor: float, vector: str = "embedding") -> DataFrame:
    """For every query (lookup, query) of a stated set how many records lie within floor (`hits`), and the least and largest of their distances (`nearest`,
    `farthest`). Pairs of tiles hand on these three; a pair whose distance is within its error of the floor is summed in order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        e, _ = _matrix(left["v"])
        q, asked = _matrix(right["v"])
        ids = right["lookup"].to_numpy()[asked]
        found = []
        for at, d, error in _blocks(e, q) if len(e) and len(q) else ():
            j, i = np.nonzero(np.abs(d - floor) <= error)
            d[j, i] = _in_order(e, q, i, j + at)
            within = d <= floor
            hits = within.sum(1)
            some = np.flatnonzero(hits)
            first, last = np.where(within, d, np.inf).argmin(1)[some], np.where(within, d, -np.inf).argmax(1)[some]
            found.append((ids[some + at], hits[some], _in_order(e, q, first, some + at), _in_order(e, q, last, some + at)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table(dict(zip(("lookup", "hits", "nearest", "farthest"), columns, strict=True)))

    parts = met(records, queries, "lookup", run, "lookup long, hits long, nearest double, farthest double", vector)
    return parts.groupBy("lookup").agg(F.sum("hits").alias("hits"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))


def without_ties(hits: DataFrame, lookup: str = "lookup") -> DataFrame:
    """Lookups of two hits or more whose distances are all alike say nothing and are dropped."""
    w = Window.partitionBy(lookup)
    spread = F.max("distance").over(w) - F.min("distance").over(w)
    return hits.withColumn("_s", spread).withColumn("_n", F.count("*").over(w)).filter((F.col("_n") < 2) | (F.col("_s") > 1e-6)).drop("_s", "_n")


def union_of(hits: DataFrame, key: list[str], keep: int = vocab.UNION_MAX, then: list[Column] | None = None) -> DataFrame:
    """Hits of all lookups, each record once with its least distance; hits of a query first, by distance, then the others."""
    out = hits.groupBy(*key).agg(F.min("distance").alias("distance"), F.bool_or("is_query").alias("is_query"))
    return out.orderBy(F.desc("is_query"), F.asc_nulls_last("distance"), *(then or []), *key).limit(keep)


def salience_order(kind: Column, index: Column, mentions: Column, date: Column, record_id: Column) -> list[Column]:
    """The order within what was found by filters alone."""
    ranks = F.create_map(*[F.lit(x) for k, r in vocab.RETRIEVAL_RANK.items() for x in (k, r)])
    return [F.element_at(ranks, kind), F.asc_nulls_last(index), F.desc_nulls_last(mentions), F.desc_nulls_last(date), record_id.asc()]


def run(call: ToolCall, records: DataFrame, edges: DataFrame, floor: float = vocab.JUNK_DISTANCE) -> DataFrame:
    """One job for all lookups of a call: kind, record_id, distance, is_query, best first. What filters alone find comes by salience, of
    which position, mention_count and file_date are read where records have them."""
    spark = records.sparkSession
    null = lambda name, kind: F.col(name) if name in records.columns else F.lit(None).cast(kind)
    order = salience_order(F.col("kind"), null("position", "long"), null("mention_count", "long"), null("file_date", "string"), F.col("record_id"))
    found = None
    for n, lookup in enumerate(call.lookups):
        near = None
        if lookup.neighbors is not None:
            near = neighbors_of(edges, spark.createDataFrame(list(lookup.neighbors), "kind string, record_id string"))
        rows = where(records, lookup.entry_type, lookup.exact_match, lookup.source, near)
        if lookup.query:
            query = F.array(*[F.lit(float(x)) for x in lookup.query])
            hits = nearest(rows.filter(~degenerate(query)), query, lookup.count, floor=floor)
        else:
            hits = rows.orderBy(*order).limit(lookup.count).withColumn("distance", F.lit(None).cast("double"))
        hits = hits.select("kind", "record_id", "distance", F.lit(bool(lookup.query)).alias("is_query"), F.lit(n).alias("lookup"))
        hits = without_ties(hits) if lookup.query else hits
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "kind string, record_id string, distance double, is_query boolean")
    return union_of(found, ["kind", "record_id"])


def accumulated(hops: DataFrame, cap: int = 240) -> DataFrame:
    """(hop, pos, kind, record_id) of all hops, each record once where it came first; at most cap."""
    first = hops.groupBy("kind", "record_id").agg(F.min(F.struct("hop", "pos")).alias("f"))
    return first.select("kind", "record_id", "f.hop", "f.pos").orderBy("hop", "pos", "kind", "record_id").limit(cap)
