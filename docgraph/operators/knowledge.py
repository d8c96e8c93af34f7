"""The whole graph of a run: record ids, edges of all kinds, record texts, and small helpers of the passes around it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import truncated
from . import graph


def _edge(df: DataFrame, src_kind: str, src: str, dst_kind: str, dst: str, kind: str) -> DataFrame:
    c = lambda x: F.col(x).cast("string")
    return df.select(F.lit(src_kind).alias("src_kind"), c(src).alias("src_id"), F.lit(dst_kind).alias("dst_kind"), c(dst).alias("dst_id"), F.lit(kind).alias("edge_kind"))


def build_edges(chunk_facts: DataFrame, siblings: DataFrame, fact_entities: DataFrame, pattern_facts: DataFrame, relations: DataFrame, insight_patterns: DataFrame, action_insights: DataFrame) -> DataFrame:
    """All edges, both ways but for chunk to entity and entity to action. Inputs are pairs of ids: (chunk, fact), (a, b), (fact,
    entity), (pattern, fact), (a, b), (insight, pattern), (action, insight); reaches across levels are equi-joins on facts."""
    parts = graph.partitions(fact_entities)
    fact_entities = fact_entities.repartition(parts, "fact")  # joins and edges below are dealt over partitions that grow in number with the facts, not in size
    insight_facts = insight_patterns.join(pattern_facts, "pattern").select("insight", "fact").distinct()
    action_patterns = action_insights.join(insight_patterns, "insight").select("action", "pattern").distinct()
    action_facts = action_insights.join(insight_facts, "insight").select("action", "fact").distinct()
    touched = lambda df, k: df.join(fact_entities, "fact").select("entity", k).distinct()
    two_way = [
        _edge(chunk_facts, "chunk", "chunk", "fact", "fact", "containment"), _edge(siblings, "fact", "a", "fact", "b", "sibling"), _edge(fact_entities, "fact", "fact", "entity", "entity", "mention"),
        _edge(pattern_facts, "pattern", "pattern", "fact", "fact", "derivation"), _edge(relations, "entity", "a", "entity", "b", "relation"),
        _edge(touched(pattern_facts, "pattern"), "entity", "entity", "pattern", "pattern", "mention"), _edge(touched(insight_facts, "insight"), "entity", "entity", "insight", "insight", "mention"),
        _edge(insight_patterns, "insight", "insight", "pattern", "pattern", "derivation"), _edge(action_insights, "action", "action", "insight", "insight", "derivation"),
        _edge(action_patterns, "action", "action", "pattern", "pattern", "derivation"),
    ]
    one_way = [
        _edge(chunk_facts.join(fact_entities, "fact").select("chunk", "entity").distinct(), "chunk", "chunk", "entity", "entity", "mention"),
        _edge(touched(action_facts, "action"), "entity", "entity", "action", "action", "mention"),
    ]
    out = None
    for e in [graph.both_ways(x) for x in two_way] + one_way:
        out = e if out is None else out.unionByName(e)
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(("containment", "mention", "sibling", "derivation", "relation")) for x in (k, i)]), F.col("edge_kind"))
    return graph.first_edges(out, order, graph.partitions(fact_entities, 4))


def top_listed(df: DataFrame, key: str, item: str, k: int, sep: str = ", ") -> DataFrame:
    """For each key its k most frequent items with their counts, as one text."""
    by = df.groupBy(key, item).agg(F.count("*").alias("n"))
    top = graph.top_by(by, [key], [F.desc("n"), item], k)
    line = F.concat(F.col(item).cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), sep).alias("text"))


def context_lines(df: DataFrame, partition: list[str], order: list, kind: Column, text: Column, width: int = 600) -> DataFrame:
    """Numbered lines of a context: [n] kind: text on one line."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    flat = truncated(F.regexp_replace(text, r"\s*\n\s*", " "), width)
    return df.withColumn("line", F.concat(F.lit("["), n.cast("string"), F.lit("] "), kind, F.lit(": "), flat))


def collapsed_refs(refs: DataFrame, owner: str, key: list[str], topic: str, idx: str) -> DataFrame:
    """References to one fact under several topics as the one of the least topic; references without a key stay."""
    own = F.concat_ws("\0", *key, *[F.when(F.coalesce(*[F.col(k).cast("string") for k in key]).isNull(), F.col(c).cast("string")) for c in (topic, idx)])
    return refs.groupBy(owner, own.alias("_k")).agg(F.min_by(F.struct(topic, idx), F.struct(topic, idx)).alias("r")).select(owner, "r.*")


def narrators(spans: DataFrame, file: str, first_person: str, named: str) -> DataFrame:
    """Files that get a narrator of their own: first person in two facts or more, half of them or more naming nobody."""
    by = spans.groupBy(file).agg(F.count_if(F.col(first_person)).alias("fp"), F.count_if(F.col(first_person) & ~F.col(named)).alias("unnamed"))
    several = F.count("*").over(Window.partitionBy()) > 1
    return by.filter("fp > 0").withColumn("_s", several).filter(F.col("_s") & (F.col("fp") >= 2) & (F.col("unnamed") * 2 >= F.col("fp"))).drop("_s")


def remapped(relations: DataFrame, remap: DataFrame) -> DataFrame:
    """Relations after merges: ends take their new ids, and those that then run from an entity to itself are dropped."""
    out = relations
    for end in ("from_id", "to_id"):
        new = remap.select(F.col("old").alias(end), F.col("new").alias("_new"))
        out = out.join(new, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return out.filter("from_id <> to_id")


def annotations(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The first annotation of each known group and target; unknown targets and a group's own are dropped, verbs in snake case."""
    known = groups.select("gid").distinct()
    out = rows.join(known, "gid", "left_semi").join(known.withColumnRenamed("gid", "to_gid"), "to_gid", "left_semi").filter("gid <> to_gid")
    out = out.withColumn("verb", F.regexp_replace(F.lower(F.trim("verb")), r"[^a-z0-9]+", "_"))
    return graph.top_by(out, ["gid", "to_gid"], ["pos"], 1).drop("rank")


_FENCE = re.compile(r"\[(\d+)\]")


def rewritten_anchors(anchors: list[str], accumulated: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """[n] as kind/id of the n-th record found so far, and why others were dropped."""
    kept, dropped = [], []
    for a in anchors:
        m = _FENCE.fullmatch(a.strip())
        if m is None:
            (kept if "/" in a else dropped).append(a if "/" in a else "malformed")
        elif 1 <= int(m[1]) <= len(accumulated):
            kept.append("/".join(accumulated[int(m[1]) - 1]))
        else:
            dropped.append("out_of_range")
    return kept, dropped


def halves(content: str) -> tuple[str, str] | None:
    """A text in two near its middle, at a paragraph, a line or a sentence within a tenth where there is one."""
    n = len(content)
    if n < 200:
        return None
    middle, reach = n // 2, max(40, n // 10)
    for sep in ("\n\n", "\n", ". "):
        after, before = content.find(sep, middle, min(n, middle + reach)), content.rfind(sep, max(0, middle - reach), middle)
        places = [p + len(sep) for p in (after, before) if p >= 0]
        if places:
            at = min(places, key=lambda p: abs(p - middle))
            return content[:at], content[at:]
    return content[:middle], content[middle:]


def batch_budget(sizes: DataFrame, column: str, chunk_cap: int, total_cap: int = 16_000) -> DataFrame:
    """One row: the budget of a batch, average size times the root of their number, within its bounds."""
    t = sizes.agg(F.sum(column).alias("t"), F.count("*").alias("n"))
    avg = F.col("t") / F.greatest(F.lit(1), F.col("n"))
    budget = F.greatest(F.floor(F.least(avg * F.sqrt("n"), F.lit(chunk_cap))), F.floor(2 * avg), F.lit(4000))
    return t.select(F.when(F.col("t") > chunk_cap, F.least(budget, F.lit(total_cap))).otherwise(budget).cast("long").alias("budget"))


def date_slices(facts: DataFrame, owner: str, order: list, size: str, budget: int) -> DataFrame:
    """Facts of each owner in equal slices by order: the least power of two of slices whose largest stays within budget, found
    all powers tried in one pass of partial sums."""
    w = Window.partitionBy(owner)
    rows = facts.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    tried = rows.select(owner, "_r", "_n", size, F.explode(F.array(*[F.lit(2**i) for i in range(8)])).alias("k"))
    at = F.floor(F.col("_r") / F.ceil(F.col("_n") / F.least(F.col("k"), F.col("_n"))))
    worst = tried.groupBy(owner, "k", at.alias("_s")).agg(F.sum(size).alias("t")).groupBy(owner, "k").agg(F.max("t").alias("worst"))
    chosen = worst.groupBy(owner).agg(F.coalesce(F.min(F.when(F.col("worst") <= budget, F.col("k"))), F.max("k")).alias("slices"))
    rows = rows.join(chosen, owner)
    return rows.withColumn("slice", F.floor(F.col("_r") / F.ceil(F.col("_n") / F.least(F.col("slices"), F.col("_n")))).cast("int")).drop("_r", "_n")
