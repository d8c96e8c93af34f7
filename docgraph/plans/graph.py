"""Queries over the property graph: customers, orders, line items and parts play actions, insights, patterns and facts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as G
from ..operators import split
from .registry import query, table


def _edges(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    derived = o.select(F.lit("action").alias("src_kind"), s("o_custkey").alias("src_id"), F.lit("insight").alias("dst_kind"), s("o_orderkey").alias("dst_id"), F.lit("derivation").alias("edge_kind"))
    mention = li.select(F.lit("insight").alias("src_kind"), s("l_orderkey").alias("src_id"), F.lit("fact").alias("dst_kind"), s("l_partkey").alias("dst_id"), F.lit("mention").alias("edge_kind"))
    return G.both_ways(derived).unionByName(mention)


_EDGES = """e AS (SELECT 'action' AS src_kind, CAST(o_custkey AS VARCHAR) AS src_id, 'insight' AS dst_kind, CAST(o_orderkey AS VARCHAR) AS dst_id, 'derivation' AS edge_kind FROM orders
    UNION ALL SELECT 'insight', CAST(o_orderkey AS VARCHAR), 'action', CAST(o_custkey AS VARCHAR), 'derivation' FROM orders
    UNION ALL SELECT 'insight', CAST(l_orderkey AS VARCHAR), 'fact', CAST(l_partkey AS VARCHAR), 'mention' FROM lineitem)"""


@query("graph_edges", f"WITH {_EDGES} SELECT src_kind, dst_kind, edge_kind, count(*) AS edges FROM (SELECT DISTINCT * FROM e) GROUP BY 1, 2, 3")
def graph_edges(spark, d):
    priority = F.when(F.col("edge_kind") == "mention", 0).otherwise(1)
    return G.first_edges(_edges(spark, d), priority).groupBy("src_kind", "dst_kind", "edge_kind").agg(F.count("*").alias("edges"))


@query(
    "graph_dead_ends",
    f"""WITH {_EDGES}, n AS (SELECT 'action' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT 'fact', CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'insight', CAST(o_orderkey AS VARCHAR) FROM orders)
    SELECT kind, CAST(sum(CASE WHEN s.src_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dead_ends, count(*) AS nodes FROM n LEFT JOIN (SELECT DISTINCT src_kind, src_id FROM e) s ON s.src_kind = kind AND s.src_id = id GROUP BY kind""",
)
def graph_dead_ends(spark, d):
    node = lambda t, k, c: table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).cast("string").alias("record_id"))
    nodes = node("customer", "action", "c_custkey").union(node("part", "fact", "p_partkey")).union(node("orders", "insight", "o_orderkey"))
    return G.dead_ends(nodes, _edges(spark, d))


@query(
    "graph_live_edges",
    f"""WITH {_EDGES} SELECT edge_kind, count(*) AS edges FROM e WHERE (src_kind <> 'action' OR CAST(src_id AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AND (dst_kind <> 'action' OR CAST(dst_id AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AND dst_kind <> 'fact' GROUP BY 1""",
)
def graph_live_edges(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 0").select(F.lit("action").alias("kind"), F.col("c_custkey").cast("string").alias("record_id"))
    i = table(spark, d, "orders").select(F.lit("insight").alias("kind"), F.col("o_orderkey").cast("string").alias("record_id"))
    return G.live_edges(_edges(spark, d), a.union(i)).groupBy("edge_kind").agg(F.count("*").alias("edges"))


@query(
    "prov_path_confidence",
    """SELECT c_custkey AS action, o_orderkey AS insight, l_linenumber AS pattern, l_partkey AS fact, round((1.0 - (o_custkey % 10) / 20.0) * (1 - l_discount), 9) AS path_conf
    FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
)
def prov_path_confidence(spark, d):
    first = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    first = first.withColumn("w", 1.0 - (F.col("o_custkey") % 10) / 20.0)
    second = table(spark, d, "lineitem").withColumns({"line": F.struct("l_linenumber", "l_partkey"), "w": 1 - F.col("l_discount")})
    out = G.path_confidence((first, "c_custkey", "o_orderkey", "w"), (second, "l_orderkey", "line", "w"))
    return out.select(F.col("n0").alias("action"), F.col("n1").alias("insight"), F.col("n2.l_linenumber").alias("pattern"), F.col("n2.l_partkey").alias("fact"), F.round("path_conf", 9).alias("path_conf"))


@query(
    "prov_shares",
    "WITH w AS (SELECT l_suppkey AS file, sum(CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS weight FROM lineitem GROUP BY 1) SELECT file, CAST(weight AS BIGINT) AS weight, round(weight / (SELECT sum(weight) FROM w), 9) AS share FROM w WHERE weight > 0",
)
def prov_shares(spark, d):
    weight = F.col("l_quantity").cast("long") * F.round(F.col("l_discount") * 100).cast("long")
    out = G.shares(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "file"), ["file"], weight)
    return out.select("file", "weight", F.round("share", 9).alias("share"))


@query(
    "prov_cited_by",
    "WITH c AS (SELECT l_partkey, l_orderkey, l_linenumber, round(1 - l_discount, 2) AS conf FROM lineitem) SELECT l_partkey AS fact, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY conf DESC, l_orderkey, l_linenumber) AS cited_by FROM c GROUP BY 1",
)
def prov_cited_by(spark, d):
    rows = table(spark, d, "lineitem").withColumn("c", -F.round(1 - F.col("l_discount"), 2))
    ref = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("ref")
    listed = F.sort_array(F.collect_list(F.struct("c", "l_orderkey", "l_linenumber", ref)))
    return rows.groupBy(F.col("l_partkey").alias("fact")).agg(F.array_join(F.transform(listed, lambda x: x["ref"]), ",").alias("cited_by"))


@query(
    "graph_range_containment",
    """WITH c AS (SELECT doc_id, unnest(generate_series(0, greatest(n_chars - 1, 0), 1344)) AS b, n_chars FROM documents WHERE n_chars > 0), s AS (SELECT doc_id, b, least(b + 1536, n_chars) AS e FROM c),
    p AS (SELECT doc_id, (doc_id * 7919) % n_chars AS at FROM documents WHERE n_chars > 0) SELECT p.doc_id, p.at, s.b AS begin_char FROM p JOIN s ON s.doc_id = p.doc_id AND p.at >= s.b AND p.at < s.e""",
)
def graph_range_containment(spark, d):
    docs = table(spark, d, "documents").filter("n_chars > 0").select("doc_id", "n_chars")
    spans = docs.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(1344).cast("long"))))
    spans = spans.select("doc_id", F.col("b").alias("begin_char"), F.least(F.col("b") + 1536, F.col("n_chars")).alias("end_char"))
    points = docs.select("doc_id", ((F.col("doc_id") * 7919) % F.col("n_chars")).alias("at"))
    return G.contained(points, spans, "doc_id", "at", "begin_char", "end_char").select("doc_id", "at", "begin_char")


@query("hist_topic", "SELECT source AS topic, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source")
def hist_topic(spark, d):
    by = table(spark, d, "documents").groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "topic")))


@query(
    "hist_date_span",
    "SELECT o_custkey, CASE WHEN min(CAST(o_orderdate AS DATE)) = max(CAST(o_orderdate AS DATE)) THEN strftime(min(o_orderdate), '%Y-%m-%d') ELSE strftime(min(o_orderdate), '%Y-%m-%d') || '..' || strftime(max(o_orderdate), '%Y-%m-%d') END AS span FROM orders GROUP BY 1",
)
def hist_date_span(spark, d):
    lo, hi = F.date_format(F.min("o_orderdate"), "yyyy-MM-dd"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.when(lo == hi, lo).otherwise(F.concat(lo, F.lit(".."), hi)).alias("span"))


@query(
    "anchor_running_count",
    "SELECT event_id, replace(lower(event_type), ' ', '-') || '-' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS anchor FROM events",
)
def anchor_running_count(spark, d):
    return G.anchors(table(spark, d, "events"), ["user_id"], "event_type", ["event_id"]).select("event_id", "anchor")


@query(
    "prev_next_sibling",
    "SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)",
)
def prev_next_sibling(spark, d):
    return G.siblings(table(spark, d, "documents"), ["source"], ["n_chars", "doc_id"], "doc_id").select("doc_id", "previous", "next")


@query(
    "sibling_edges",
    "WITH s AS (SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) SELECT a AS src, b AS dst FROM s WHERE b IS NOT NULL UNION ALL SELECT b, a FROM s WHERE b IS NOT NULL",
)
def sibling_edges(spark, d):
    s = G.siblings(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"], "doc_id").filter("next IS NOT NULL")
    return s.select(F.col("doc_id").alias("src"), F.col("next").alias("dst")).union(s.select("next", "doc_id"))


@query(
    "overlap_rank",
    """WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), o AS (SELECT a.l_suppkey AS entity, b.l_suppkey AS other, count(*) AS shared FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY shared DESC, other) AS rank FROM o) SELECT entity, other, shared, rank FROM r WHERE rank <= 3""",
)
def overlap_rank(spark, d):
    o = G.pair_counts(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")
    return G.top_by(o, ["entity"], [F.desc("shared"), "other"], 3)


@query(
    "fact_canonical",
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical_id, count(*) OVER (PARTITION BY text) AS aliases FROM documents",
)
def fact_canonical(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    out = G.canonical(rows, ["key"], ["doc_id"])
    return out.select("doc_id", F.col("canonical.doc_id").alias("canonical_id"), F.count("*").over(Window.partitionBy("key")).alias("aliases"))


@query(
    "alias_drift",
    "WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS variants FROM lineitem GROUP BY 1) SELECT l_partkey AS canonical, variants FROM g WHERE variants > 1",
)
def alias_drift(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("canonical")).agg(F.countDistinct("l_suppkey").alias("variants")).filter("variants > 1")


@query(
    "span_sweep",
    """WITH e AS (SELECT source AS file, doc_id AS pos, 1 AS delta FROM documents UNION ALL SELECT source AS file, doc_id + 40 AS pos, -1 AS delta FROM documents), b AS (SELECT file, pos, sum(delta) AS delta FROM e GROUP BY 1, 2)
    SELECT file, pos, CAST(delta AS BIGINT) AS delta, CAST(sum(delta) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS opened FROM b""",
)
def span_sweep(spark, d):
    spans = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("b"), (F.col("doc_id") + 40).alias("e"))
    return G.sweep(spans, "file", "b", "e").withColumnsRenamed({"at": "pos", "open": "opened"})


@query(
    "transitive_facts",
    "SELECT o_custkey AS action, count(DISTINCT l_partkey) AS facts, count(DISTINCT l_orderkey) AS insights FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def transitive_facts(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("action")).agg(F.countDistinct("l_partkey").alias("facts"), F.countDistinct("l_orderkey").alias("insights"))


@query(
    "relation_both_ends",
    "SELECT entity, count(*) AS relations FROM (SELECT l_suppkey AS entity FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY 1",
)
def relation_both_ends(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity")).union(li.select("l_partkey")).groupBy("entity").agg(F.count("*").alias("relations"))


@query(
    "stale_files",
    "SELECT 'f' || doc_id AS path FROM documents EXCEPT SELECT 'f' || doc_id FROM labels",
)
def stale_files(spark, d):
    path = lambda t: table(spark, d, t).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    return path("documents").join(path("labels"), "path", "left_anti").distinct()


@query("reverse_chronology", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS pos FROM orders")
def reverse_chronology(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("pos"))


@query(
    "graph_spans_of_any_length",
    """WITH s AS (SELECT l_suppkey % 10 AS file, (l_partkey * 7907) % 1000000 AS b, (l_partkey * 7907) % 1000000 + CAST(pow(10, l_linenumber - 1) AS BIGINT) AS e FROM lineitem),
    p AS (SELECT c_custkey, c_custkey % 10 AS file, (c_custkey * 7919) % 1500000 AS place FROM customer)
    SELECT c_custkey, count(*) AS spans, min(e - b) AS shortest, max(e - b) AS longest FROM p JOIN s ON s.file = p.file AND place >= b AND place < e GROUP BY c_custkey""",
)
def graph_spans_of_any_length(spark, d):
    """Points in overlapping spans of 1 to 10^6 characters."""
    begin = (F.col("l_partkey") * 7907) % 1000000
    spans = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("file"), begin.alias("b"), (begin + F.pow(F.lit(10), F.col("l_linenumber") - 1).cast("long")).alias("e"))
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("file"), ((F.col("c_custkey") * 7919) % 1500000).alias("place"))
    return G.held(points, spans, "file", "place", "b", "e").select("c_custkey", "spans", "shortest", "longest")


@query(
    "graph_inner_entry",
    """WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations), e AS (SELECT conv_id % 7 AS batch, conv_id, turn, sum(n + 5) OVER w - n - 5 AS b, sum(n + 5) OVER w - 5 AS e FROM c WINDOW w AS (PARTITION BY conv_id % 7 ORDER BY conv_id, turn)),
    z AS (SELECT batch, max(e) AS n FROM e GROUP BY 1), p AS (SELECT doc_id, doc_id % 7 AS batch, (doc_id * 104729) % n AS place FROM documents JOIN z ON batch = doc_id % 7)
    SELECT doc_id, place, conv_id, turn FROM p LEFT JOIN e ON e.batch = p.batch AND place >= b AND place < e""",
)
def graph_inner_entry(spark, d):
    """The entry of a batch, of which there are few long ones, that holds an offset; offsets on what lies between entries have none."""
    w = Window.partitionBy("batch").orderBy("conv_id", "turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "conversations").select((F.col("conv_id") % 7).alias("batch"), "conv_id", "turn", F.length("text").alias("n"))
    entries = rows.withColumn("to", F.sum(F.col("n") + 5).over(w)).select("batch", "conv_id", "turn", (F.col("to") - F.col("n") - 5).alias("b"), (F.col("to") - 5).alias("e"))
    sizes = entries.groupBy("batch").agg(F.max("e").alias("n"))
    points = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 7).alias("batch")).join(F.broadcast(sizes), "batch")  # seven rows
    points = points.select("doc_id", "batch", ((F.col("doc_id") * 104729) % F.col("n")).alias("place"))
    return G.located(points, entries, "batch", "place", "b", "e").select("doc_id", "place", "conv_id", "turn")


@query(
    "graph_document_sections",
    """WITH r AS (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2)
    SELECT conv_id AS doc_id, role AS section, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS INTEGER) AS place FROM r""",
)
def graph_document_sections(spark, d):
    """Conversations as documents with a heading before each turn; the paths of their chunks in the order in which they come first."""
    turns = table(spark, d, "conversations")
    part = F.concat(F.lit("# "), "role", F.lit("\n"), F.translate("text", "#", ""), F.lit("\n"))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]), "").alias("text"))
    found = G.document_sections(split.chunk(docs, limit=1), "doc_id", "section_path", "char_offset")
    return found.select("doc_id", F.array_join("section_path", "/").alias("section"), "place")
