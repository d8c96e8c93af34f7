"""Queries of the small functions: normal forms, validity, numbers of calls, texts of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import display, facts, split, synthesis
from ..operators import entities as E
from .registry import query, table


@query(
    "fact_normalized",
    r"SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g')) AS normal FROM documents",
)
def fact_normalized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.normalized_fact(F.col("text"))).alias("normal"))


@query(
    "ent_without_determiners",
    r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(substr(text, 1, 60)), '[^\p{L}\p{M}\p{N}\p{Pc}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM documents)
    SELECT doc_id, array_to_string(list_filter(string_split(n, ' '), lambda t: t NOT IN ('the', 'a', 'an')), ' ') AS name FROM n""",
)
def ent_without_determiners(spark, d):
    return table(spark, d, "documents").select("doc_id", S.without_determiners(S.normalized_ascii_name(F.substring("text", 1, 60))).alias("name"))


@query(
    "fact_relation_candidates",
    """WITH r AS (SELECT CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE l_returnflag END AS a, CASE WHEN l_linenumber % 3 = 0 THEN lower(l_returnflag) ELSE l_linestatus END AS b, CAST(l_linenumber AS VARCHAR) AS verb FROM lineitem)
    SELECT a AS "from", b AS "to", verb, count(*) AS n FROM r WHERE trim(a) <> '' AND trim(b) <> '' AND lower(a) <> lower(b) GROUP BY 1, 2, 3""",
)
def fact_relation_candidates(spark, d):
    a, b = F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise(F.col("l_returnflag")), F.when(F.col("l_linenumber") % 3 == 0, F.lower("l_returnflag")).otherwise(F.col("l_linestatus"))
    rows = table(spark, d, "lineitem").select(facts.relation_candidate(a, b, F.col("l_linenumber").cast("string"), F.col("l_discount")).alias("r")).filter("r IS NOT NULL")
    return rows.groupBy("r.from", "r.to", "r.verb").agg(F.count("*").alias("n"))


WORDS = ("the", "of", "and", "de", "la", "der", "et")


@query(
    "fact_affects",
    f"""WITH w AS (SELECT doc_id, lang, list_transform(string_split(substr(text, 1, 200), ' '), lambda x: lower(x)) AS w FROM documents)
    SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_contains({list(WORDS)}, x) AND list_position(w, x) = i)[1:2], ' ') AS affects, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS kind FROM w""",
)
def fact_affects(spark, d):
    words = F.split(F.substring("text", 1, 200), " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(facts.affects(words, WORDS), " ").alias("affects"), facts.coerced(F.col("lang"), ("en", "de"), "other").alias("kind"))


@query(
    "fact_payload_outcomes",
    """WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k FROM events)
    SELECT ['ok', 'empty', 'parse_error', 'parse_error', 'parse_error'][k + 1] AS outcome, count(*) AS n FROM k GROUP BY 1""",
)
def fact_payload_outcomes(spark, d):
    """Replies with items, without items, cut, of another shape, and without the key."""
    k = F.from_json("props", "k bigint")["k"] % 5
    whole = F.concat(F.lit('{"items": ['), F.col("props"), F.lit("]}"))
    reply = F.when(k == 0, whole).when(k == 1, '{"items": []}').when(k == 2, F.substring(whole, F.lit(1), F.length(whole) - 2)).when(k == 3, '{"items": {"a": 1}}').otherwise(F.col("props"))
    return table(spark, d, "events").select(facts.payload_outcome(reply, "items").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "fact_dedup_members",
    r"""WITH n AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g') AS k FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first FROM n WHERE k <> ''""",
)
def fact_dedup_members(spark, d):
    return facts.dedup_members(table(spark, d, "documents").select("doc_id", S.normalized_fact(F.col("text")).alias("k")), "k", "doc_id")


@query("spl_prompt_tokens", "SELECT conv_id, CAST(sum(length(text)) // 3 AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def spl_prompt_tokens(spark, d):
    """The tokens of a prompt of many parts: their characters are summed first."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(S.tokens_from_chars(F.sum(F.length("text"))).alias("tokens"))


@query(
    "tel_call_ids",
    """WITH i AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN 'x' || event_id WHEN 3 THEN '-5' WHEN 4 THEN '' ELSE '99999' END AS id FROM events)
    SELECT event_id, CASE event_id % 6 WHEN 2 THEN -1 WHEN 3 THEN -5 WHEN 4 THEN -1 WHEN 5 THEN 99999 ELSE event_id END AS number, CASE WHEN event_id % 6 < 2 AND event_id < 10000 THEN lpad(CAST(event_id AS VARCHAR), 4, '0') END AS padded,
      CASE WHEN event_id % 6 > 2 THEN 'ab' || (2 + event_id % 7) || 'z' END AS short FROM i""",
)
def tel_call_ids(spark, d):
    k, own = F.col("event_id") % 6, F.col("event_id").cast("string")
    id_ = F.when(k == 0, own).when(k == 1, F.concat(F.lit(" "), own, F.lit(" "))).when(k == 2, F.concat(F.lit("x"), own)).when(k == 3, "-5").when(k == 4, "").otherwise("99999")
    good = F.concat(F.lit("ab"), (2 + F.col("event_id") % 7).cast("string"), F.lit("z"))
    name = F.when(k == 0, "2024-01-02T03-04-05Z-ab1z").when(k == 1, "2024").when(k == 2, F.concat(F.lit("run-"), good, F.lit("q"))).otherwise(F.concat(F.lit("2024-01-02T03-04-05Z-"), good))
    return table(spark, d, "events").select("event_id", S.call_number(id_, -1).cast("long").alias("number"), S.padded_call_id(id_).alias("padded"), S.short_id(name).alias("short"))


@query(
    "ent_numbered_groups",
    """WITH p AS (SELECT p_brand, p_type, p_partkey FROM part), f AS (SELECT l_partkey, min(l_orderkey) AS pos FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1),
    g AS (SELECT p_brand || '/' || p_type AS name, coalesce(min(pos), 9223372036854775807) AS first_pos, count(*) AS members FROM p LEFT JOIN f ON l_partkey = p_partkey GROUP BY 1)
    SELECT 'g' || row_number() OVER (ORDER BY first_pos, name) AS gid, name, members FROM g""",
)
def ent_numbered_groups(spark, d):
    """Groups by the earliest place of their facts, those without a fact last, then by name."""
    first = table(spark, d, "lineitem").filter("l_partkey % 3 = 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("pos"))
    rows = table(spark, d, "part").join(first, "p_partkey", "left").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("name"))
    groups = rows.agg(F.coalesce(F.min("pos"), F.lit((1 << 63) - 1)).alias("first_pos"), F.count("*").alias("members"))
    return E.numbered(groups, ["first_pos", "name"]).select("gid", "name", "members")


@query(
    "syn_fanned_out",
    r"""WITH n AS (SELECT doc_id, source, lang, md5(text) AS k FROM documents WHERE text <> ''), m AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM n), r AS (SELECT source || '/' || lang AS pattern, first AS idx, max((doc_id % 10) / 10.0) AS conf FROM m WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2)
    SELECT pattern, m.doc_id AS original, CAST(max(conf) AS DOUBLE) AS conf FROM r JOIN m ON m.first = r.idx GROUP BY 1, 2""",
)
def syn_fanned_out(spark, d):
    """References to the first of equal documents as references to all of them."""
    docs = table(spark, d, "documents").filter("text <> ''")
    members = facts.dedup_first(docs.select("doc_id", F.md5("text").alias("k")), "k", "doc_id")
    firsts = facts.dedup_members(docs.select("doc_id", F.md5("text").alias("k")), "k", "doc_id")
    refs = docs.join(firsts, "doc_id").filter("source IS NOT NULL AND lang IS NOT NULL").groupBy(F.concat_ws("/", "source", "lang").alias("pattern"), F.col("first").alias("doc_id")).agg(F.max(F.col("doc_id") % 10 / 10).alias("conf"))
    return synthesis.fanned_out(refs.select("pattern", "doc_id", "conf"), members, "doc_id")


@query(
    "graph_synthesis_texts",
    """WITH r AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS kind, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS x, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE p_type END AS y FROM part)
    SELECT id, concat_ws(chr(10), name, nullif(kind, ''), x, 'mechanism: ' || nullif(trim(y), ''), 'implication: ' || x) AS insight,
      concat_ws(chr(10), name, nullif(kind, ''), 'objective: ' || x, 'why: ' || nullif(trim(y), ''), 'immediate action: ' || x, 'habit: ' || name, 'success metric: ' || nullif(trim(y), '')) AS action,
      'Type: ' || CASE WHEN id % 2 = 0 THEN 'document section' ELSE 'insight' END AS header FROM r""",
)
def graph_synthesis_texts(spark, d):
    """The texts of insights and actions as they are embedded, and the line that tells their kind; what is missing leaves no line."""
    c = F.col
    k = c("p_partkey")
    kind, x, y = F.when(k % 2 == 0, "").otherwise(c("p_type")), F.when(k % 3 != 0, c("p_brand")), F.when(k % 5 == 0, "  ").otherwise(c("p_type"))
    return table(spark, d, "part").select(
        k.alias("id"), display.insight_text(c("p_name"), kind, x, y, x).alias("insight"), display.action_text(c("p_name"), kind, x, y, x, c("p_name"), y).alias("action"),
        display.type_header(F.when(k % 2 == 0, "chunk").otherwise("insight")).alias("header"),
    )


@query(
    "spl_stamped_lines",
    """SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN strftime(TIMESTAMP '2024-01-02 09:00:00' + INTERVAL 7 HOUR * turn, '%Y-%m-%d %H:%M') END AS at FROM conversations""",
)
def spl_stamped_lines(spark, d):
    """Times of chat lines in two of the known forms; other lines have none."""
    at = F.expr("TIMESTAMP '2024-01-02 09:00:00' + make_dt_interval(0, 7 * turn)")
    line = F.when(F.col("turn") % 3 == 0, F.date_format(at, "'['dd/MM/yyyy, HH:mm'] A: x'")).when(F.col("turn") % 3 == 1, F.date_format(at, "dd/MM/yyyy, h:mm a' - A: x'")).otherwise("no time here")
    rows = table(spark, d, "conversations").select("conv_id", "turn", split.line_time(line).alias("t"))
    return rows.select("conv_id", "turn", F.date_format("t", "yyyy-MM-dd HH:mm").alias("at"))
