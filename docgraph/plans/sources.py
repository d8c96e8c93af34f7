"""Queries over sources: reject reasons, chat turns, month and year buckets, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources import chats, files
from .registry import query, table


@query(
    "src_reject_reason",
    """WITH f AS (SELECT 'doc' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.json' END AS path, length(text) * 20000 AS size FROM documents
      UNION ALL SELECT 'p' || page_id || '.html', length(html) FROM pages),
    r AS (SELECT path, CASE WHEN size > 41943040 THEN 'size' WHEN path LIKE '%.html' THEN 'excluded' WHEN path LIKE '%.exe' OR path NOT LIKE '%.%' THEN 'unsupported' END AS reason FROM f)
    SELECT coalesce(reason, 'accepted') AS reason, count(*) AS files, min(path) AS first_path FROM r GROUP BY 1""",
)
def src_reject_reason(spark, d):
    k = F.col("doc_id") % 5
    ext = F.when(k == 0, ".txt").when(k == 1, ".MD").when(k == 2, ".exe").when(k == 3, "").otherwise(".json")
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext).alias("path"), (F.length("text").cast("long") * 20000).alias("size"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.length("html").cast("long").alias("size"))
    both = docs.unionByName(pages).withColumn("reason", F.coalesce(files.reject_reason(F.col("path"), F.col("size")), F.lit("accepted")))
    return both.groupBy("reason").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@query(
    "src_user_turns_concat",
    "SELECT conv_id, count(*) AS turns, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id",
)
def src_user_turns_concat(spark, d):
    return chats.user_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(
    "src_month_buckets",
    """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS entries, string_agg(event_type, chr(10) ORDER BY event_id) AS text, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT event_type AS x FROM events)) AS groups FROM events GROUP BY 1""",
)
def src_month_buckets(spark, d):
    return chats.month_histories(table(spark, d, "events"), "ts", "event_type", ["event_id"], "event_type")


@query(
    "src_year_buckets_home",
    """WITH y AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y') AS year, 'j' || (o_custkey % 10) || '.json' AS file_id FROM orders),
    n AS (SELECT *, max(year) OVER (PARTITION BY file_id) AS newest FROM y),
    t AS (SELECT o_orderkey, year, CASE WHEN year = newest THEN file_id ELSE replace(file_id, '.json', '-' || year || '.json') END AS destination FROM n)
    SELECT destination, destination || '::entry_' || CASE WHEN rn < 1000 THEN lpad(CAST(rn AS VARCHAR), 3, '0') ELSE CAST(rn AS VARCHAR) END AS entry_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY year, o_orderkey) - 1 AS rn FROM t)""",
)
def src_year_buckets_home(spark, d):
    file_id = F.concat(F.lit("j"), (F.col("o_custkey") % 10).cast("string"), F.lit(".json"))
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("year"), file_id.alias("file_id"))
    return chats.destinations(rows, "file_id", "year", ["o_orderkey"]).select("destination", "entry_id", "o_orderkey")


@query(
    "src_manifest_upsert",
    """WITH o AS (SELECT 'f' || doc_id AS file_path, sha256(text) AS h, row_number() OVER (ORDER BY 'f' || doc_id) - 1 AS position FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    n AS (SELECT 'f' || doc_id AS file_path, sha256(CASE WHEN n_chars % 2 = 0 THEN text || '!' ELSE text END) AS h FROM documents),
    j AS (SELECT coalesce(o.file_path, n.file_path) AS file_path, coalesce(n.h, o.h) AS content_hash, CASE WHEN o.file_path IS NULL THEN 'new' ELSE 'old' END AS added_at, o.position AS p FROM o FULL OUTER JOIN n ON o.file_path = n.file_path)
    SELECT file_path, content_hash, added_at, CAST(coalesce(p, (SELECT max(position) FROM o) + row_number() OVER (PARTITION BY p IS NULL ORDER BY file_path)) AS BIGINT) AS position FROM j""",
)
def src_manifest_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), "text", "n_chars")
    empty = spark.createDataFrame([], "file_path string, content_hash string, added_at string, position long")
    old = files.upserted(empty, docs.join(table(spark, d, "labels"), "doc_id", "left_semi").select("file_path", files.content_hash(F.col("text")).alias("content_hash")), F.lit("old"))
    new = docs.select("file_path", files.content_hash(F.when(F.col("n_chars") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return files.upserted(old, new, F.lit("new"))


@query(
    "src_statistics",
    """WITH f AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'png' WHEN 2 THEN 'pdf' ELSE 'exe' END AS e, n_chars FROM documents)
    SELECT CAST(sum(CASE WHEN e = 'png' THEN 1 ELSE 0 END) AS BIGINT) AS images, CAST(sum(CASE WHEN e IN ('txt', 'pdf') THEN 1 ELSE 0 END) AS BIGINT) AS text_files, CAST(sum(CASE WHEN e = 'txt' THEN n_chars WHEN e = 'pdf' THEN 10000 ELSE 0 END) AS BIGINT) AS bytes FROM f""",
)
def src_statistics(spark, d):
    k = F.col("doc_id") % 4
    path = F.concat(F.lit("a."), F.when(k == 0, "txt").when(k == 1, "png").when(k == 2, "pdf").otherwise("exe"))
    return files.statistics(table(spark, d, "documents").select(path.alias("path"), F.col("n_chars").alias("length")))


@query(
    "src_merge_offsets",
    """WITH r AS (SELECT source, doc_id, '## ' || lang || ' (' || CAST(doc_id AS VARCHAR) || ')' || chr(10) || chr(10) AS head, text FROM documents),
    o AS (SELECT source, doc_id, head, text, coalesce(sum(length(head) + length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS origin FROM r)
    SELECT source AS file_id, sha256(string_agg(head || text, chr(10) || chr(10) ORDER BY doc_id)) AS content_hash, string_agg(CAST(CAST(origin AS BIGINT) AS VARCHAR), ',' ORDER BY doc_id) AS origins FROM o GROUP BY source HAVING count(*) > 1""",
)
def src_merge_offsets(spark, d):
    docs = table(spark, d, "documents")
    docs = docs.select(F.col("source").alias("file_id"), "doc_id", F.col("lang").alias("title"), F.col("doc_id").cast("string").alias("date"), F.col("text").alias("content"))
    out = files.merged(docs, ["doc_id"]).filter(F.size("origins") > 1)
    return out.select("file_id", files.content_hash(F.col("content")).alias("content_hash"), F.array_join("origins", ",").alias("origins"))


@query(
    "src_iso_dates",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS iso_date, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS ord_date FROM events",
)
def src_iso_dates(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    n = F.when(F.col("event_id") % 2 == 0, F.floor(micros / 1000)).otherwise(F.floor(micros / 1_000_000))
    rows = table(spark, d, "events").select("event_id", F.date_format(S.epoch_timestamp(n), "yyyy-MM-dd").alias("iso_date"))
    return rows.withColumn("ord_date", S.ordinal_date(F.col("iso_date")))


@query(
    "src_json_shape",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'code_history' WHEN 1 THEN 'codex_history' END AS shape FROM events",
)
def src_json_shape(spark, d):
    k = F.col("event_id") % 3
    line = F.when(k == 0, F.to_json(F.struct(F.lit("x").alias("display"), F.lit("p").alias("project"), F.col("event_id")))).when(
        k == 1, F.to_json(F.struct(F.lit("s").alias("session_id"), F.lit("t").alias("text"), F.col("event_id").alias("ts")))
    ).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", chats.shape(line, chats.JSONL_SHAPES).alias("shape"))


@query(
    "src_usual_place",
    """WITH r AS (SELECT o_orderpriority AS place, CAST(o_orderdate AS DATE) AS dt FROM orders), m AS (SELECT max(dt) AS m FROM r)
    SELECT place, count(*) AS n FROM r, m WHERE dt >= m - 90 GROUP BY place ORDER BY n DESC, place LIMIT 1""",
)
def src_usual_place(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("place"))
    return chats.usual_place(rows, "date", "place")
