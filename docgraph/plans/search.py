"""Queries over the vector store and the chat turn."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import search
from .registry import query, table

_DIST = "1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _records(spark, d):
    return table(spark, d, "embeddings").withColumn("rowid", F.col("vec_id"))


def _vector(spark, d, vec_id: int):
    found = table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").head()
    return F.array(*[F.lit(float(x)) for x in found[0]])


@query("knn_global", f"SELECT e.vec_id, round({_DIST}, 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_DIST}, e.vec_id LIMIT 15")
def knn_global(spark, d):
    return search.nearest(_records(spark, d), _vector(spark, d, 0), 15).select("vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(
    "knn_filtered_before_topk",
    f"SELECT e.vec_id, e.label, round({_DIST}, 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label IN (1, 3) ORDER BY {_DIST}, e.vec_id LIMIT 20",
)
def knn_filtered_before_topk(spark, d):
    rows = _records(spark, d).filter(F.col("label").isin(1, 3))
    return search.nearest(rows, _vector(spark, d, 7), 20).select("vec_id", "label", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(
    "knn_each",
    f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS rowid, round({_DIST}, 6) + 0.0 AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rowid) AS rank FROM p) SELECT query_id, rowid, distance, rank FROM r WHERE rank <= 5""",
)
def knn_each(spark, d):
    rows = _records(spark, d)
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.nearest_each(rows, queries, 5)


@query(
    "knn_multi_lookup_union",
    f"""WITH a AS (SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q ORDER BY 2, 1 LIMIT 15),
    b AS (SELECT e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE label = 2 ORDER BY 2, 1 LIMIT 15),
    c AS (SELECT vec_id, CAST(NULL AS DOUBLE) AS distance FROM embeddings WHERE label = 4 ORDER BY vec_id LIMIT 15)
    SELECT vec_id, round(min(distance), 6) + 0.0 AS distance, bool_or(q) AS is_query FROM (SELECT *, TRUE AS q FROM a UNION ALL SELECT *, TRUE FROM b UNION ALL SELECT *, FALSE FROM c) GROUP BY vec_id ORDER BY 3 DESC, min(distance) NULLS LAST, vec_id LIMIT 50""",
)
def knn_multi_lookup_union(spark, d):
    rows = _records(spark, d)
    a = search.nearest(rows, _vector(spark, d, 1), 15).withColumn("is_query", F.lit(True))
    b = search.nearest(rows.filter("label = 2"), _vector(spark, d, 2), 15).withColumn("is_query", F.lit(True))
    c = rows.filter("label = 4").orderBy("rowid").limit(15).withColumns({"distance": F.lit(None).cast("double"), "is_query": F.lit(False)})
    hits = [x.select("vec_id", "distance", "is_query") for x in (a, b, c)]
    return search.union_of(hits[0].unionByName(hits[1]).unionByName(hits[2]), ["vec_id"]).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(
    "filter_select",
    "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND (contains(lower(text), 'license') OR contains(lower(text), 'the and')) AND (contains(lower(source), 'src1') OR contains(lower(source), 'src3')) ORDER BY doc_id LIMIT 50",
)
def filter_select(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("kind"), "text", F.col("source").alias("file_id"), "doc_id")
    found = search.where(docs, ("en", "fr"), ("License", "the and"), ("SRC1", "src3"))
    return found.orderBy("doc_id").limit(50).select("doc_id", F.col("file_id").alias("source"))


@query(
    "knn_neighbor_filter",
    f"""WITH nb AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (1, 2, 3, 4, 5)) SELECT e.vec_id, round({_DIST}, 6) + 0.0 AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.vec_id IN (SELECT id % 500 FROM nb) ORDER BY {_DIST}, e.vec_id LIMIT 10""",
)
def knn_neighbor_filter(spark, d):
    edges = table(spark, d, "lineitem").select(
        F.lit("order").alias("src_kind"), F.col("l_orderkey").cast("string").alias("src_id"), F.lit("vec").alias("dst_kind"), (F.col("l_partkey") % 500).cast("string").alias("dst_id")
    )
    anchors = spark.range(1, 6).select(F.lit("order").alias("kind"), F.col("id").cast("string").alias("record_id"))
    rows = _records(spark, d).withColumns({"kind": F.lit("vec"), "record_id": F.col("vec_id").cast("string")})
    found = search.where(rows, neighbors=search.neighbors_of(edges, anchors))
    return search.nearest(found, _vector(spark, d, 3), 10).select("vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(
    "vec_unit_norm",
    "SELECT label, count(*) AS vectors, CAST(sum(CASE WHEN abs(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) - 1) <= 0.001 THEN 1 ELSE 0 END) AS BIGINT) AS unit FROM embeddings GROUP BY label",
)
def vec_unit_norm(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.count_if(F.abs(S.squared_norm(F.col("embedding")) - 1) <= 1e-3).alias("unit"))


@query(
    "vec_degenerate",
    "SELECT vec_id, (list_max(x) - list_min(x) <= 1e-6 OR list_dot_product(x, x) <= 1e-12) AS degenerate FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN [0.5, 0.5, 0.5] WHEN vec_id % 10 = 1 THEN [0.0, 0.0, 1e-9] ELSE CAST(embedding AS DOUBLE[]) END AS x FROM embeddings)",
)
def vec_degenerate(spark, d):
    k = F.col("vec_id") % 10
    flat, null = F.array(*[F.lit(0.5)] * 3), F.array(F.lit(0.0), F.lit(0.0), F.lit(1e-9))
    v = F.when(k == 0, flat).when(k == 1, null).otherwise(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", S.degenerate(v).alias("degenerate"))


@query(
    "knn_ties_and_junk",
    f"""WITH h AS (SELECT q.vec_id AS lookup, e.vec_id, {_DIST} AS distance FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
    SELECT lookup, count(*) AS hits, round(min(distance), 6) AS nearest FROM h WHERE distance <= 0.9 GROUP BY lookup HAVING count(*) < 2 OR max(distance) - min(distance) > 1e-6""",
)
def knn_ties_and_junk(spark, d):
    rows = _records(spark, d)
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("lookup"), F.col("embedding").alias("query"))
    hits = search.hits_each(rows, queries, 0.9)
    return hits.filter((F.col("hits") < 2) | (F.col("farthest") - F.col("nearest") > 1e-6)).select("lookup", "hits", F.round("nearest", 6).alias("nearest"))


@query(
    "search_accumulate",
    """WITH h AS (SELECT user_id % 4 AS hop, event_id AS pos, event_type AS kind, CAST(user_id AS VARCHAR) AS record_id FROM events), f AS (SELECT kind, record_id, hop, pos, row_number() OVER (PARTITION BY kind, record_id ORDER BY hop, pos) AS rn FROM h)
    SELECT kind, record_id, hop, pos FROM f WHERE rn = 1 ORDER BY hop, pos LIMIT 240""",
)
def search_accumulate(spark, d):
    hops = table(spark, d, "events").select((F.col("user_id") % 4).alias("hop"), F.col("event_id").alias("pos"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("record_id"))
    return search.accumulated(hops)


@query(
    "chat_history_window",
    """WITH r AS (SELECT conv_id, turn, role, regexp_replace(text, '\\[[0-9]+\\]', '', 'g') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role <> 'system')
    SELECT conv_id, turn, role, text FROM r WHERE rn <= 4""".replace("\\\\", "\\"),
)
def chat_history_window(spark, d):
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = table(spark, d, "conversations").filter("role <> 'system'").withColumn("rn", rn).filter("rn <= 4")
    return rows.select("conv_id", "turn", "role", F.regexp_replace("text", r"\[[0-9]+\]", "").alias("text"))


@query(
    "cite_refs",
    """WITH a AS (SELECT doc_id, 'see [' || (doc_id % 7) || '] and [' || (doc_id % 90) || '] then [' || (doc_id % 7) || ']' AS answer FROM documents),
    r AS (SELECT doc_id, unnest([doc_id % 7, doc_id % 90]) AS n FROM a)
    SELECT DISTINCT doc_id, n AS ref FROM r WHERE n BETWEEN 1 AND 50""",
)
def cite_refs(spark, d):
    n = lambda m: (F.col("doc_id") % m).cast("string")
    answer = F.concat(F.lit("see ["), n(7), F.lit("] and ["), n(90), F.lit("] then ["), n(7), F.lit("]"))
    refs = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("bigint"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(refs)).alias("ref"))
    return rows.filter("ref BETWEEN 1 AND 50")


@query(
    "search_run",
    """WITH r AS (SELECT CASE label % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'chunk' ELSE 'entity' END AS kind, CAST(vec_id AS VARCHAR) AS record_id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
    d AS (SELECT kind, record_id, vec_id, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS distance FROM r, q WHERE kind IN ('fact', 'chunk')),
    n AS (SELECT kind, record_id, distance, true AS is_query FROM d WHERE distance <= 0.5 ORDER BY distance, vec_id LIMIT 5),
    f AS (SELECT kind, record_id, NULL::DOUBLE AS distance, false AS is_query FROM r WHERE label IN (1, 2) ORDER BY CASE kind WHEN 'entity' THEN 3 WHEN 'fact' THEN 4 ELSE 6 END, label DESC, record_id LIMIT 20)
    SELECT kind, record_id, round(min(distance), 6) + 0.0 AS distance, bool_or(is_query) AS is_query FROM (SELECT * FROM n UNION ALL SELECT * FROM f) GROUP BY 1, 2""",
)
def search_run(spark, d):
    """A nearest-neighbour lookup among two kinds and a lookup by text alone, in one job."""
    e = table(spark, d, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ("fact", "chunk", "entity"))), F.col("label") % 3 + 1)
    records = e.select(kind.alias("kind"), F.col("vec_id").cast("string").alias("record_id"), F.col("vec_id").alias("rowid"), F.concat(F.lit("label "), "label").alias("text"), F.lit("f").alias("file_id"), F.col("label").cast("long").alias("mention_count"), "embedding")
    first = e.orderBy("vec_id").select("embedding").head()  # the vector of the question
    call = search.ToolCall((search.Lookup(tuple(first[0]) if first else None, ("fact", "chunk"), count=5), search.Lookup(exact_match=("label 1", "label 2"), count=20)))
    edges = spark.createDataFrame([], "src_kind string, src_id string, dst_kind string, dst_id string, edge_kind string")
    found = search.run(call, records.withColumn("label", F.col("mention_count")), edges)
    return found.select("kind", "record_id", (F.round("distance", 6) + 0.0).alias("distance"), "is_query")
