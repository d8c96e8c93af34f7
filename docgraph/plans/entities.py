"""Queries of entity resolution over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions.ordered import in_order
from ..operators import entities as E
from ..operators import graph
from ..operators.facts import folded_name
from .registry import query, table


def _mentions(spark, d):
    """Customers as mentions: the market segment is the name, with a mark on some; orders are facts."""
    c = table(spark, d, "customer")
    name = F.concat(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" Ltd.")).when(F.col("c_custkey") % 3 == 1, F.lit(" ltd")).otherwise(F.lit("  LTD!")))
    return c.select(name.alias("name"), F.col("c_nationkey").alias("kind"), F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 40).alias("fact"), F.col("c_mktsegment").alias("topic"))


_MENTIONS = """m AS (SELECT c_mktsegment || CASE c_custkey % 3 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' ltd' ELSE '  LTD!' END AS name, c_nationkey AS kind, c_custkey AS pos, c_custkey % 40 AS fact FROM customer),
    n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_ ]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM m)"""


@query(
    "ent_group_longest_name",
    f"""WITH {_MENTIONS} SELECT norm, kind, first(name ORDER BY length(name) DESC, pos) AS canonical_name, count(*) AS mention_count, count(DISTINCT fact) AS facts, min(pos) AS first_pos FROM n GROUP BY norm, kind""",
)
def ent_group_longest_name(spark, d):
    m = _mentions(spark, d).withColumn("norm", S.normalized_ascii_name(F.col("name")))
    return E.grouped(m, "norm", "kind", "name", "fact", "topic", "pos").drop("aliases", "topics")


@query(
    "ent_folded_names",
    "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_ ]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM part",
)
def ent_folded_names(spark, d):
    return table(spark, d, "part").select("p_partkey", folded_name("p_name").alias("norm"))


@query(
    "ent_comention_catalog",
    "WITH m AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS f FROM lineitem) SELECT a.s AS entity, b.s AS other, count(*) AS facts FROM m a JOIN m b ON a.f = b.f AND a.s <> b.s GROUP BY 1, 2",
)
def ent_comention_catalog(spark, d):
    return E.comentions(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@query(
    "ent_components",
    """WITH RECURSIVE e AS (SELECT o_custkey AS a, 1000000000 + o_orderkey AS b FROM orders), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r AS (SELECT DISTINCT x AS node, x AS seen FROM s UNION SELECT r.node, s.y FROM r JOIN s ON s.x = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def ent_components(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 1_000_000_000).alias("b"))
    return graph.components(e, "a", "b")


@query(
    "ent_merged_records",
    """WITH r AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, count(l_orderkey) AS mention_count FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
    c AS (SELECT id, name, mention_count, min(id) OVER (PARTITION BY nation) AS component FROM r)
    SELECT component, first(name ORDER BY mention_count DESC, length(name) DESC, id) AS canonical_name, CAST(sum(mention_count) AS BIGINT) AS mention_count, count(*) AS members FROM c GROUP BY component""",
)
def ent_merged_records(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    records = sup.join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("mention_count"))
    nations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("b"))
    links = nations.filter("b IS NOT NULL")
    return E.merged(records, graph.components(links, "a", "b"))


@query(
    "ent_relation_winner",
    """WITH r AS (SELECT l_suppkey % 20 AS from_id, l_partkey % 20 AS to_id, l_returnflag AS relation, l_discount AS confidence, l_orderkey AS evidence FROM lineitem WHERE l_suppkey % 20 <> l_partkey % 20),
    b AS (SELECT from_id, to_id, relation, count(DISTINCT evidence) AS n, max(confidence) AS confidence FROM r GROUP BY 1, 2, 3),
    w AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY n DESC, confidence DESC, relation) AS rn FROM b),
    t AS (SELECT from_id, to_id, count(DISTINCT evidence) AS evidence FROM r GROUP BY 1, 2)
    SELECT w.from_id, w.to_id, relation, confidence, evidence FROM w JOIN t ON w.from_id = t.from_id AND w.to_id = t.to_id WHERE rn = 1""",
)
def ent_relation_winner(spark, d):
    rows = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("from_id"), (F.col("l_partkey") % 20).alias("to_id"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("confidence"), F.col("l_orderkey").alias("evidence")
    )
    return E.winning_relations(rows)


@query(
    "ent_disambiguate",
    """WITH s AS (SELECT p_partkey, replace(lower(p_brand), '#', '-') AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)
    SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS canonical_id FROM r""",
)
def ent_disambiguate(spark, d):
    rows = table(spark, d, "part").select("p_partkey", S.slug(F.col("p_brand")).alias("slug"))
    return E.disambiguated(rows, "slug", ["p_partkey"]).select("p_partkey", "canonical_id")


@query(
    "ent_name_similar_pairs",
    """WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS t FROM nation) SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON a.k < b.k AND (a.t = b.t OR (length(a.t) >= 3 AND length(b.t) >= 3 AND (
      (abs(length(a.t) - length(b.t)) <= 2 AND (starts_with(a.t, b.t) OR starts_with(b.t, a.t))) OR (length(a.t) >= 5 AND length(b.t) >= 5 AND damerau_levenshtein(a.t, b.t) <= 1))))""",
)
def ent_name_similar_pairs(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("t"))  # 25 rows by definition
    a, b = n.select(F.col("k").alias("a"), F.col("t").alias("ta")), n.select(F.col("k").alias("b"), F.col("t").alias("tb"))
    return a.join(F.broadcast(b), (F.col("a") < F.col("b")) & S.tokens_similar(F.col("ta"), F.col("tb"))).select("a", "b")


@query(
    "ent_merge_verdicts",
    """WITH p AS (SELECT event_id, value / 100.0 AS confidence, user_id % 3 = 0 AS same_type, event_id % 10 <> 0 AS valid, event_id % 4 = 1 AS overlap FROM events)
    SELECT CASE WHEN NOT valid THEN 'invalid' WHEN confidence < 0.85 THEN 'low_confidence' WHEN overlap OR (same_type AND confidence >= 0.9) THEN 'kept' ELSE 'no_overlap' END AS verdict, count(*) AS pairs FROM p GROUP BY 1""",
)
def ent_merge_verdicts(spark, d):
    e = table(spark, d, "events")
    names = lambda k: F.when(F.col("event_id") % 4 == k, F.lit("sir thomas hale")).otherwise(F.lit("martin cook"))
    verdict = E.merge_verdict(F.col("event_id") % 10 != 0, F.col("value") / 100.0, E.names_overlap(names(1), F.lit("crew t hale")), F.col("user_id") % 3 == 0)
    return e.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("pairs"))


@query(
    "ent_bundles",
    "SELECT lang, count(DISTINCT source) AS files, count(DISTINCT source) > 1 AS bundle FROM documents GROUP BY lang",
)
def ent_bundles(spark, d):
    n = F.countDistinct("source")
    return table(spark, d, "documents").groupBy("lang").agg(n.alias("files"), (n > 1).alias("bundle"))


@query(
    "ent_subject",
    "SELECT c_name AS canonical_name, c_acctbal AS likelihood, c_custkey AS mention_count FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1",
)
def ent_subject(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_name").alias("canonical_name"), F.col("c_acctbal").alias("likelihood"), F.col("c_custkey").alias("mention_count"))
    return E.subject(rows)


@query(
    "ent_resolved_candidates",
    """WITH g AS (SELECT c_mktsegment AS name, c_nationkey AS entity_type, count(*) AS mention_count, min(c_name) AS canonical_name FROM customer GROUP BY 1, 2),
    c AS (SELECT o_orderkey AS candidate, c_mktsegment AS name, c_nationkey + (o_orderkey % 2) * 100 AS kind FROM orders JOIN customer ON o_custkey = c_custkey),
    r AS (SELECT c.candidate, canonical_name, entity_type, row_number() OVER (PARTITION BY candidate ORDER BY kind = entity_type DESC, mention_count DESC, lower(canonical_name) DESC) AS rn FROM c JOIN g ON c.name = g.name)
    SELECT candidate, canonical_name, entity_type FROM r WHERE rn = 1""",
)
def ent_resolved_candidates(spark, d):
    c = table(spark, d, "customer")
    groups = c.groupBy(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("entity_type")).agg(F.count("*").alias("mention_count"), F.min("c_name").alias("canonical_name"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    cand = o.select(F.col("o_orderkey").alias("candidate"), F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") + (F.col("o_orderkey") % 2) * 100).alias("kind"))
    return E.resolved(cand, groups, "name", "kind").select("candidate", "canonical_name", "entity_type")


@query(
    "ent_topic_context",
    "SELECT p_brand AS topic, count(DISTINCT l_suppkey) AS entities FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def ent_topic_context(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("topic")).agg(F.countDistinct("l_suppkey").alias("entities"))


@query(
    "ent_dedupe_rows",
    "WITH r AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rn, count(*) OVER () AS n FROM supplier) SELECT s_suppkey, CASE WHEN rn <= n // 4 THEN s_name || ' (full)' ELSE s_name END AS line FROM r",
)
def ent_dedupe_rows(spark, d):
    suppliers = table(spark, d, "supplier")
    n = suppliers.agg(F.count("*").alias("n")).scalar()
    rows = in_order(suppliers, [F.desc("s_acctbal"), F.asc("s_suppkey")], "rn").withColumn("n", n)
    return rows.select("s_suppkey", F.when(F.col("rn") <= F.floor(F.col("n") / 4), F.concat("s_name", F.lit(" (full)"))).otherwise(F.col("s_name")).alias("line"))
