"""Property-graph operators: components, containment, overlap, provenance, siblings, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import bounded, checkpointed


def both_ways(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges and their reverses: src_kind, src_id, dst_kind, dst_id, edge_kind."""
    rev = edges.select(F.col("dst_kind").alias("src_kind"), F.col("dst_id").alias("src_id"), F.col("src_kind").alias("dst_kind"), F.col("src_id").alias("dst_id"), "edge_kind")
    out = edges.select("src_kind", "src_id", "dst_kind", "dst_id", "edge_kind").unionByName(rev)
    return out if kind is None else out.withColumn("edge_kind", F.lit(kind))


def first_edges(edges: DataFrame, priority: Column, parts: int | None = None) -> DataFrame:
    """One edge for each pair of nodes: of several kinds the one of least priority stays. parts says over how many partitions pairs are dealt, where these are
    to grow with the edges."""
    key = ["src_kind", "src_id", "dst_kind", "dst_id"]
    edges = edges if parts is None else edges.repartition(parts, *key)
    return edges.groupBy(*key).agg(F.min_by("edge_kind", F.struct(priority, F.col("edge_kind"))).alias("edge_kind"))


def partitions(df: DataFrame, times: int = 1) -> int:
    """How many partitions hold `times` rows for each of df, ROWS each; no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-times * df.count() // ROWS))


def live_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (kind, record_id)."""
    out = edges
    for side in ("src", "dst"):
        ends = nodes.select(F.col("kind").alias(f"{side}_kind"), F.col("record_id").alias(f"{side}_id"))
        out = out.join(ends, [f"{side}_kind", f"{side}_id"], "left_semi")
    return out


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes (kind, record_id) without an outgoing edge, by kind; kinds without any count 0."""
    src = edges.select(F.col("src_kind").alias("kind"), F.col("src_id").alias("record_id")).distinct()
    flagged = nodes.join(src.withColumn("_out", F.lit(1)), ["kind", "record_id"], "left")
    return flagged.groupBy("kind").agg(F.count_if(F.col("_out").isNull()).alias("dead_ends"), F.count("*").alias("nodes"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component) with the least node reachable; a checkpoint each round cuts the lineage."""
    sym = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).filter("x <> y").distinct()
    sym = checkpointed(sym)
    labels = checkpointed(sym.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(rounds):
        near = sym.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("component").alias("up"))
        new = checkpointed(step.join(up, "m", "left").select("node", F.least("m", F.coalesce("up", "m")).alias("component"), F.col("component").alias("was")))
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"not settled after {rounds} rounds")


def contained(points: DataFrame, spans: DataFrame, file: str, at: str, begin: str, end: str) -> DataFrame:
    """Points within spans (begin <= at < end) of one file, as an equi-join, whatever the spans' lengths: a span lies in bins as wide as its length,
    rounded up to a power of two, of which it meets two at most; a point looks into the one bin of each width that spans have."""
    width = F.greatest(F.lit(0), F.ceil(F.log2(F.col(end) - F.col(begin)))).cast("int")
    spans = spans.filter(F.col(end) > F.col(begin)).withColumn("_width", width)
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.expr(f"shiftright(CAST({begin} AS BIGINT), _width)"), F.expr(f"shiftright(CAST({end} - 1 AS BIGINT), _width)"))))
    widths = spans.agg(F.sort_array(F.collect_set("_width")).alias("w"))  # 63 at most
    points = points.withColumn("_width", F.explode(widths.scalar())).withColumn("_bin", F.expr(f"shiftright(CAST({at} AS BIGINT), _width)"))
    return points.join(spans, [file, "_width", "_bin"]).filter((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bin", "_width")


#: Sizes of aligned pieces, as powers of two, that a place looks up at once; so many pieces of the least of these have the next greater one in common.
SIZES = 10


def held(points: DataFrame, spans: DataFrame, file: str, at: str, begin: str, end: str) -> DataFrame:
    """points that lie in spans (begin <= at < end) of their file, with the number of those (`spans`) and the least and largest length (`shortest`, `longest`);
    what contained() says when its pairs are counted, without a pair: a span is cut into aligned pieces whose sizes are powers of two, two of a size at most,
    spans are folded by piece, and a place looks up the one piece of each size that it lies in. Work grows with points and spans, whatever lies on one place.

    Sizes are looked up from the largest down, SIZES at a time, by the distinct pieces that hold a point; what these find is one more piece to those within. So a piece is met
    by 2^SIZES others at most, not by all points of its file. The joins are merged: a size that is guessed from files knows nothing of rows that are made from one row."""
    down = lambda c: F.expr(f"shiftright(CAST({c} AS BIGINT), _level)")
    size = F.col(end) - F.col(begin)
    largest = F.floor(F.log2(size)).cast("int")
    spans = spans.filter(F.col(end) > F.col(begin))
    top = spans.agg(F.max(largest)).head()[0] or 0
    odd = lambda c, piece: F.when(F.col(c) % 2 != 0, piece)
    key, folded = [file, "_level", "_piece"], [F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most")]
    found = None
    for least in range(top // SIZES * SIZES, -1, -SIZES):
        most = min(top, least + SIZES - 1)
        rows = spans.filter(largest >= least).select(file, begin, end, F.explode(F.sequence(F.lit(least), F.least(F.lit(most), largest))).alias("_level"))
        rows = rows.withColumn("_l", -down(f"-{begin}")).withColumn("_r", down(end)).filter("_l < _r")  # the whole pieces of this size within the span
        rows = rows.withColumn("_piece", F.explode(F.array(odd("_l", F.col("_l")), odd("_r", F.col("_r") - 1)))).filter("_piece IS NOT NULL")  # that no larger piece holds
        pieces = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min(size).alias("_least"), F.max(size).alias("_most"))
        if found is not None:
            pieces, most = pieces.unionByName(found.withColumnRenamed("_place", "_piece").withColumn("_level", F.lit(least + SIZES))), least + SIZES
        places = points.select(file, F.expr(f"shiftright(CAST({at} AS BIGINT), {least})").alias("_place")).distinct()
        looked = places.withColumn("_level", F.explode(F.sequence(F.lit(least), F.lit(most)))).withColumn("_piece", F.expr(f"shiftright(_place, _level - {least})"))
        found = looked.join(pieces.hint("merge"), key).groupBy(file, "_place").agg(*folded)
    rows = points.groupBy(*points.columns).agg(F.count("*").alias("_times")).withColumn("_place", F.col(at).cast("long"))
    met = rows.join(checkpointed(found).hint("merge"), [file, "_place"])  # shuffled on both sides, so that a place with many points may be split
    return met.select(*points.columns, (F.col("_n") * F.col("_times")).alias("spans"), F.col("_least").alias("shortest"), F.col("_most").alias("longest"))


def located(points: DataFrame, segments: DataFrame, file: str, at: str, begin: str, end: str) -> DataFrame:
    """points with the columns of the segment of their file that they lie in (begin <= at < end), null where they lie in none. Segments of a file do not
    overlap, gaps are allowed. An as-of join: both sides are put in order of place together, and each point takes the last segment before it. The order is dealt
    by ranges, not by file, so that a file of any size is spread; what a range takes over from those before it is one row a range."""
    own = [c for c in segments.columns if c != file]
    rows = points.select(F.struct(*points.columns).alias("_p"), F.col(file).alias("_f"), F.col(at).cast("long").alias("_at"), F.lit(None).cast(segments.select(F.struct(*own)).schema[0].dataType).alias("_s"), F.lit(1).alias("_kind"))
    opened = segments.select(F.lit(None).cast(rows.schema["_p"].dataType).alias("_p"), F.col(file).alias("_f"), F.col(begin).cast("long").alias("_at"), F.struct(*own).alias("_s"), F.lit(0).alias("_kind"))
    order = ["_f", "_at", "_kind"]
    both = checkpointed(rows.unionByName(opened).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    named = F.when(F.col("_kind") == 0, F.struct("_f", "_s"))
    last = both.groupBy("_range").agg(F.max_by(named, F.when(F.col("_kind") == 0, F.struct(*order))).alias("_last"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))  # as many rows as ranges
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last(named, ignorenulls=True).over(inside)).filter("_kind = 1").join(F.broadcast(carried), "_range")
    found = found.withColumn("_got", F.coalesce("_here", "_carried"))
    holds = (F.col("_got._f") == F.col("_f")) & (F.col("_at") < F.col(f"_got._s.{end}"))
    return found.select("_p.*", *[F.when(holds, F.col(f"_got._s.{c}")).alias(c) for c in own])


def document_sections(chunks: DataFrame, file: str, path: str, at: str) -> DataFrame:
    """(file, path, place) of the distinct paths of a file's chunks, numbered in the order in which they are first seen; empty paths are none."""
    firsts = chunks.filter(F.size(path) > 0).groupBy(file, path).agg(F.min(at).alias("_first"))
    return firsts.select(file, path, (F.row_number().over(Window.partitionBy(file).orderBy("_first", path)) - 1).alias("place"))


#: Members of an item beyond which the pairs that share it are dealt over several tasks.
BLOCK = 1000


def shared_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, item: str, block: int | None = None) -> DataFrame:
    """(item, left_id, right_id) of the distinct rows that share an item. An item with more than BLOCK members on a side is cut into blocks by hash of the id, and each
    pair of blocks is a key of its own: no task meets all pairs of a hot item."""
    block = block or BLOCK
    sides = [df.select(F.col(id_), F.col(item)).distinct() for df, id_ in ((left, left_id), (right, right_id))]
    hot = [s.groupBy(item).agg(F.ceil(F.count("*") / block).cast("int").alias(n)).filter(F.col(n) > 1) for s, n in zip(sides, ("_a", "_b"), strict=True)]
    blocks = bounded(checkpointed(hot[0].join(hot[1], item, "full_outer").select(item, F.coalesce("_a", F.lit(1)).alias("_a"), F.coalesce("_b", F.lit(1)).alias("_b"))))

    def dealt(side: DataFrame, id_: str, own: str, other: str) -> DataFrame:
        rows = side.join(blocks, item, "left").withColumn(own, F.pmod(F.xxhash64(id_), F.coalesce(own, F.lit(1))).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))

    return dealt(sides[0], left_id, "_a", "_b").join(dealt(sides[1], right_id, "_b", "_a"), [item, "_a", "_b"]).select(item, left_id, right_id)


#: Rows of a partition where pairs are counted.
ROWS = 100_000


def pair_counts(df: DataFrame, id_: str, item: str, count: str = "shared", block: int | None = None) -> DataFrame:
    """(entity, other, count) of the ids that share items, both ways, with how many. An item's members go with each of them to the partition that counts this
    one's pairs, so pairs are made where they are counted and are never shuffled; partitions grow in number with the rows, not in size. Items with more than
    BLOCK members are dealt by shared_pairs()."""
    block = block or BLOCK
    rows = df.select(F.col(id_).alias("entity"), F.col(item).alias("_i")).filter("entity IS NOT NULL AND _i IS NOT NULL")
    parts = partitions(rows)
    rows = rows.repartition(parts, "_i").distinct()
    hot = checkpointed(rows.groupBy("_i").agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select("_i"))
    some = not hot.isEmpty()
    hot = bounded(hot)
    lists = (rows.join(hot, "_i", "left_anti") if some else rows).groupBy("_i").agg(F.collect_list("entity").alias("_l"))
    pairs = lists.select(F.explode("_l").alias("entity"), "_l").repartition(parts, "entity").select("entity", F.explode("_l").alias("other"))
    found = pairs.filter("entity <> other").groupBy("entity", "other").agg(F.count("*").alias(count))
    if not some:
        return found
    left = rows.join(hot, "_i", "left_semi")
    dealt = shared_pairs(left, left.withColumnRenamed("entity", "other"), "entity", "other", "_i", block).filter("entity <> other")
    return found.union(dealt.groupBy("entity", "other").agg(F.count("*").alias(count))).repartition(parts, "entity").groupBy("entity", "other").agg(F.sum(count).alias(count))


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str, item: str) -> DataFrame:
    """Pairs that share items, with how many: items are joined, sets are never compared."""
    return shared_pairs(left, right, left_id, right_id, item).groupBy(left_id, right_id).agg(F.count("*").alias("shared"))


def top_by(df: DataFrame, partition: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col(name) <= k)


def siblings(df: DataFrame, partition: list[str], order: list[str], id_: str) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumns({"previous": F.lag(id_).over(w), "next": F.lead(id_).over(w)})


def canonical(df: DataFrame, key: list[str], rank: list[str]) -> DataFrame:
    """Adds the least row of each provenance key (struct of rank); a key with a null part is the row's own."""
    own = F.struct(*rank)
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    return df.withColumn("canonical", F.when(missing, own).otherwise(F.min(own).over(Window.partitionBy(*key))))


def anchors(df: DataFrame, partition: list[str], kind: str, order: list[str]) -> DataFrame:
    """Adds type-scoped anchors: the kind in lower case with hyphens, and a running number from 1."""
    n = F.row_number().over(Window.partitionBy(*partition, kind).orderBy(*order))
    return df.withColumn("anchor", F.concat(F.replace(F.lower(kind), F.lit(" "), F.lit("-")), F.lit("-"), n.cast("string")))


def path_confidence(*steps: tuple[DataFrame, str, str, str]) -> DataFrame:
    """Joins steps (edges, from, to, confidence) end to end and multiplies confidences. A missing step leaves a broken path (null)."""
    first, src, dst, conf = steps[0]
    out = first.select(F.col(src).alias("n0"), F.col(dst).alias("n1"), F.col(conf).alias("path_conf"))
    for i, (edges, src, dst, conf) in enumerate(steps[1:], 1):
        step = edges.select(F.col(src).alias(f"n{i}"), F.col(dst).alias(f"n{i + 1}"), F.col(conf).alias("_c"))
        out = out.join(step, f"n{i}", "left").withColumn("path_conf", F.col("path_conf") * F.col("_c")).drop("_c")
    return out


def shares(df: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """Each group's share of all positive weight."""
    by = df.groupBy(*group).agg(F.sum(weight).alias("weight")).filter("weight > 0")
    return by.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def sweep(spans: DataFrame, file: str, begin: str, end: str) -> DataFrame:
    """How many spans are open after each offset where one begins or ends; ends come first."""
    events = spans.select(file, F.col(begin).alias("at"), F.lit(1).alias("delta")).union(spans.select(file, F.col(end), F.lit(-1)))
    by = events.groupBy(file, "at").agg(F.sum("delta").alias("delta"))
    return by.withColumn("open", F.sum("delta").over(Window.partitionBy(file).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
