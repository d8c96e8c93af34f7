"""A finished run as linked markdown pages, cut at a privacy level: every page is a table of lines with their order, and nothing gathers a page.

Records are tables: facts (topic, topic_no, idx, type, summary, occurred_at, confidence, entities, topics, tags, evidence), patterns (topic, idx, name, kind, count,
domain, description, source_facts, hallucinated), insights (scope, idx, name, domains, description, mechanism, implication, proposed_actions, source_patterns,
hallucinated), actions (idx, recommendation, ..., source_insights, hallucinated), entities (canonical_id, ..., refs), relations and stats. A line is (path, at, text):
`at` is a struct (group, section, part, a, b, c, d) that orders the lines of a page; a text of several lines is written as it is. Trees of provenance are joins, level by
level; each step keeps the confidences of its edges, so that a path's is multiplied from its root. sources.pages writes the lines of each path, in order, into one file.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Levels from the least raw on, folders of pages, what may follow a marker, the most references of an entity that are listed.
LEVELS = ("actions", "insights", "patterns", "entities", "facts", "raw")
INPUTS, FACTS, ENTITIES, PATTERNS, INSIGHTS, ACTIONS = "0-inputs", "1-facts", "2-entities", "3-patterns", "4-insights", "5-actions"
AFTER_SPAN = ".!?,;:\"')]}"
MOST_REFS = 30
SCORES = (("regret", "regret_reduction"), ("leverage", "leverage"), ("consequence", "consequence"), ("generativity", "generativity"), ("decisiveness", "decisiveness"), ("feedback-speed", "time_to_feedback"), ("constraint-fit", "constraint_fit"))
TAG = r"(?<!`)<(/?[A-Za-z][A-Za-z0-9]*(?::[A-Za-z0-9_.+-]+)?(?:\s[^<>`]*)?)>(?!`)"

PLACE = ("group", "section", "part", "a", "b", "c", "d")


@dataclass(frozen=True)
class Run:
    """The tables of a run, what links of its pages begin with, and the rawest level that is exported."""

    facts: DataFrame
    patterns: DataFrame
    insights: DataFrame
    actions: DataFrame
    entities: DataFrame
    relations: DataFrame
    stats: DataFrame
    inputs: DataFrame
    subject: str | None = None
    name: str = ""
    level: str = "raw"

    def has(self, level: str) -> bool:
        return LEVELS.index(level) <= LEVELS.index(self.level)

    @property
    def prefix(self) -> str:
        return f"{self.name}/" if self.name else ""


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def titled(t: Column) -> Column:
    """Runs of letters with a capital first and small letters after it."""
    runs = F.regexp_extract_all(t, F.lit("([a-zA-Z]+|[^a-zA-Z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.when(w.rlike("^[a-zA-Z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))).otherwise(w)), "")


def two_places(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(F.coalesce(x, F.lit(0.0)) * 100) / 100)


def percent(x: Column) -> Column:
    return F.bround(x * 100).cast("long").cast("string")


def counted(n: Column, noun: str) -> Column:
    return text(n, f" {noun}", F.when(n == 1, "").otherwise("s"))


def trimmed(t: Column) -> Column:
    return F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)^\s+|\s+$", "")


def escaped(t: Column) -> Column:
    """Tags in backticks, unless they are already."""
    return F.regexp_replace(t, TAG, "`<$1>`")


def quoted(t: Column) -> Column:
    return escaped(F.replace(trimmed(t), F.lit("\n"), F.lit(" ")))


def link(target: Column, shown: Column) -> Column:
    return text("[[", target, "|", shown, "]]")


def shown_name(topic: Column | None, anchor: Column, stage: str = "") -> Column:
    """What a link to a record says: its topic (or its stage) in the singular, its type and number."""
    kind, n = F.regexp_extract(anchor, r"^(.+)-(\d+)$", 1), F.regexp_extract(anchor, r"^(.+)-(\d+)$", 2)
    kind = titled(F.translate(kind, "-_", "  "))
    if topic is None:
        return text(f"{stage} " if stage else "", kind, " ", n)
    one = titled(topic)
    one = F.when(one.endswith("s") & ~one.endswith("ss"), F.substring(one, F.lit(1), F.length(one) - 1)).otherwise(one)
    return text(one, " ", kind, " ", n)


def insight_anchor(scope: Column, idx: Column) -> Column:
    return text(F.replace(scope, F.lit("cross_domain"), F.lit("cross-domain")), "-", idx + 1)


def place(**at: Column | int) -> Column:
    of = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[of(at.get(p, 0)).cast("long").alias(p) for p in PLACE])


def lines(df: DataFrame, path: Column, at: Column, line: Column) -> DataFrame:
    return df.select(path.alias("path"), at.alias("at"), line.alias("text"))


def anchored(run: Run) -> tuple[DataFrame, DataFrame]:
    """facts and patterns with their anchors: the type (or kind, small and hyphened) and a running number within topic and type."""
    number = lambda kind: F.row_number().over(Window.partitionBy("topic", kind).orderBy("idx"))
    first = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    facts = run.facts.withColumn("_kind", first("type", "fact"))
    facts = facts.withColumn("anchor", text(F.col("_kind"), "-", number("_kind"))).drop("_kind")
    patterns = run.patterns.withColumn("_kind", F.regexp_replace(F.lower(first("kind", "pattern")), r"\s+", "-"))
    return facts, patterns.withColumn("anchor", text(F.col("_kind"), "-", number("_kind"))).drop("_kind")


def ranked(df: DataFrame, keys: list[str], edges: str, order: Column | None = None) -> DataFrame:
    """A row for each edge of an array of structs with `conf`, the surest first: keys, rank (from 1) and e."""
    listed = F.transform(edges, lambda e, i: F.struct((-e["conf"]).alias("o"), i.alias("i"), e.alias("e")))
    return df.select(*keys, F.posexplode(F.array_sort(listed)).alias("_r", "_e")).select(*keys, (F.col("_r") + 1).alias("rank"), F.col("_e.e").alias("e"))


# trees of provenance: key columns, ranks r1, r2, ..., depth, edges (confidences from the root on), target, shown, said, approximate, own (a line that is no link)

NODE = ("depth", "edges", "target", "shown", "said", "approximate", "own")


def _node(depth: Column, edges: Column, target=None, shown=None, said=None, approximate=None, own=None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [
        depth.cast("int").alias("depth"), edges.alias("edges"), (none if target is None else target).alias("target"), (none if shown is None else shown).alias("shown"), (none if said is None else said).alias("said"),
        (F.lit(False) if approximate is None else F.coalesce(approximate, F.lit(False))).alias("approximate"), (none if own is None else own).alias("own"),
    ]


def below_cut(n: Column, noun: str) -> Column:
    return text("- *↳ ", counted(n, noun), " below the privacy cut (not exported)*")


def fact_trees(run: Run, facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of each pattern (topic, idx): its facts and their sources; r1, r2."""
    none = F.array().cast("array<double>")
    if not run.has("facts"):
        n = F.size("source_facts")
        return patterns.filter(n > 0).select("topic", "idx", F.lit(1).alias("r1"), F.lit(0).alias("r2"), *_node(F.lit(0), none, own=below_cut(n, "fact")))
    edges = ranked(patterns, ["topic", "idx"], "source_facts").select("topic", "idx", F.col("rank").alias("r1"), F.col("e.idx").alias("f"), F.col("e.conf").alias("conf"))
    known = facts.select("topic", F.col("idx").alias("f"), "anchor", "summary", "evidence")
    rows = edges.join(known, ["topic", "f"], "left")
    target = text(f"{run.prefix}{FACTS}/", F.col("topic"), "#^", F.col("anchor"))
    broken = text(f"- **[Fact]** `{run.prefix}{FACTS}/", F.col("topic"), "#^fact-", F.col("f") + 1, "` · edge ", two_places(F.col("conf")), " · *broken*")
    found = F.col("anchor").isNotNull()
    own = rows.select("topic", "idx", "r1", F.lit(0).alias("r2"), *_node(F.lit(0), F.array("conf"), F.when(found, target), shown_name(F.col("topic"), F.col("anchor")), F.coalesce("summary", F.lit("")), own=F.when(~found, broken)))
    cited = F.filter("evidence", lambda e: F.coalesce(e["file_path"], F.lit("")) != "")
    if not run.has("raw"):
        n = F.size(cited)
        sources = rows.filter(found & (n > 0)).select("topic", "idx", "r1", F.lit(1).alias("r2"), *_node(F.lit(1), F.array("conf"), own=below_cut(n, "source excerpt")))
    else:
        each = rows.filter(found).select("topic", "idx", "r1", "conf", F.posexplode(cited).alias("_i", "e"))
        target, name = source_link(run, F.col("e"))
        said = F.replace(trimmed(F.col("e.text")), F.lit("\n"), F.lit(" "))
        sources = each.select("topic", "idx", "r1", (F.col("_i") + 1).alias("r2"), *_node(F.lit(1), F.array("conf"), target, name, said, F.col("e.approximate")))
    return own.unionByName(sources)


def source_link(run: Run, e: Column) -> tuple[Column, Column]:
    """Target and text of a link to where an excerpt stands."""
    placed = e["file_offset"].isNotNull() & e["file_length"].isNotNull()
    target = text(f"{run.prefix}{INPUTS}/", e["file_path"], F.when(placed, text("#^offset-", e["file_offset"])))
    return target, F.when(placed, text(e["file_path"], " @ ", e["file_offset"], ":", e["file_length"])).otherwise(e["file_path"])


def _under(upper: DataFrame, keys: list[str], on: list[str], tree: DataFrame, ranks: list[str]) -> DataFrame:
    """tree, keyed by `on`, hung below the rows of upper (keys, on, rank, conf)."""
    lower = upper.join(tree, on)
    moved = [F.col("rank").alias("r1"), *[F.col(r).alias(f"r{i + 2}") for i, r in enumerate(ranks)]]
    return lower.select(*[F.col(k) for k in keys], *moved, (F.col("depth") + 1).alias("depth"), F.concat(F.array("conf"), "edges").alias("edges"), *NODE[2:])


def pattern_trees(run: Run, patterns: DataFrame, insights: DataFrame, trees: DataFrame) -> DataFrame:
    """Of each insight (scope, idx): its patterns and what is below them; r1, r2, r3."""
    none = F.array().cast("array<double>")
    zero = [F.lit(0).alias("r2"), F.lit(0).alias("r3")]
    if not run.has("patterns"):
        n = F.size("source_patterns")
        return insights.filter(n > 0).select("scope", "idx", F.lit(1).alias("r1"), *zero, *_node(F.lit(0), none, own=below_cut(n, "pattern")))
    edges = ranked(insights, ["scope", "idx"], "source_patterns").select("scope", "idx", "rank", F.col("e.topic").alias("topic"), F.col("e.idx").alias("p"), F.col("e.conf").alias("conf"))
    rows = edges.join(patterns.select("topic", F.col("idx").alias("p"), "anchor", "description", "name"), ["topic", "p"], "left")
    found = F.col("anchor").isNotNull()
    target = text(f"{run.prefix}{PATTERNS}/", F.col("topic"), "#^", F.col("anchor"))
    broken = text(f"- **[Pattern]** `{run.prefix}{PATTERNS}/", F.col("topic"), "#^pattern-", F.col("p") + 1, "` · edge ", two_places(F.col("conf")), " · *broken*")
    said = F.coalesce(F.nullif(F.col("description"), F.lit("")), "name", F.lit(""))
    own = rows.select("scope", "idx", F.col("rank").alias("r1"), *zero, *_node(F.lit(0), F.array("conf"), F.when(found, target), shown_name(F.col("topic"), F.col("anchor")), said, own=F.when(~found, broken)))
    below = _under(rows.filter(found).select("scope", "idx", "topic", "p", "rank", "conf"), ["scope", "idx"], ["topic", "p"], trees.withColumnRenamed("idx", "p"), ["r1", "r2"])
    return own.unionByName(below)


def insight_trees(run: Run, insights: DataFrame, actions: DataFrame, trees: DataFrame) -> DataFrame:
    """Of each action (idx): its insights and what is below them; r1 to r4."""
    edges = ranked(actions, ["idx"], "source_insights").select("idx", "rank", F.col("e.scope").alias("scope"), F.col("e.idx").alias("i"), F.col("e.conf").alias("conf"))
    rows = edges.join(insights.select("scope", F.col("idx").alias("i"), "description", F.col("name").alias("_name")), ["scope", "i"], "left")
    found, anchor = F.col("_name").isNotNull(), insight_anchor(F.col("scope"), F.col("i"))
    target = text(f"{run.prefix}{INSIGHTS}#^", anchor)
    broken = text(f"- **[Insight]** `{run.prefix}{INSIGHTS}#^", anchor, "` · edge ", two_places(F.col("conf")), " · *broken*")
    said = F.coalesce(F.nullif(F.col("description"), F.lit("")), "_name", F.lit(""))
    zero = [F.lit(0).alias(f"r{i}") for i in (2, 3, 4)]
    own = rows.select("idx", F.col("rank").alias("r1"), *zero, *_node(F.lit(0), F.array("conf"), F.when(found, target), shown_name(None, anchor, "Insight"), said, own=F.when(~found, broken)))
    below = _under(rows.filter(found).select("idx", "scope", "i", "rank", "conf"), ["idx"], ["scope", "i"], trees.withColumnRenamed("idx", "i"), ["r1", "r2", "r3"])
    return own.unionByName(below)


def tree_lines(trees: DataFrame, path: Column, group: Column | int, section: Column, part: int, ranks: list[str]) -> DataFrame:
    """The bullets of trees, indented by depth."""
    sure = F.aggregate("edges", F.lit(1.0), lambda acc, x: acc * x)
    said = F.replace(F.replace(quoted(F.col("said")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    bullet = text("- **", percent(sure), "% match**  ", F.when(F.col("approximate"), "≈ ").otherwise(""), link(F.col("target"), F.col("shown")), F.when(F.col("said") != "", text(': *"', said, '"*')))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce("own", bullet))
    return lines(trees, path, place(group=group, section=section, part=part, **dict(zip("abcd", [F.col(r) for r in ranks], strict=False))), line)


def _page(topic: Column, folder: str) -> Column:
    return text(f"{folder}/", topic, ".md")


def _bullets(df: DataFrame, path: Column, group: Column | int, section: Column, part: int, rank: Column, line: Column, head: str, once: Column) -> DataFrame:
    """A heading before the first row of each section, and the rows."""
    title = lines(df.filter(once), path, place(group=group, section=section, part=part), F.lit(f"\n**{head}**"))
    return title.unionByName(lines(df, path, place(group=group, section=section, part=part, a=rank), line))


def _counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").cast("long").alias("n"))


def facts_pages(run: Run, facts: DataFrame, patterns: DataFrame) -> DataFrame:
    path = _page(F.col("topic"), FACTS)
    front = lines(_counts(facts, ["topic"]), path, place(), text("---\ntopic: ", F.col("topic"), "\nlayer: facts\ncount: ", F.col("n"), "\n---\n\n# ", titled(F.col("topic")), " — facts\n"))
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("fact"))
    listed = lambda head, c, of, by: F.when(F.size(c) > 0, text(f"**{head}:** ", F.array_join(F.transform(c, of), by)))
    quote = lambda e: escaped(F.replace(trimmed(e["text"]), F.lit("\n"), F.lit(" ")))
    mark = lambda e: F.when(F.coalesce(e["approximate"], F.lit(False)), "≈ ").otherwise("")
    cited = lambda e: text("- ", mark(e), link(*source_link(run, e)), "\n  > ", quote(e))
    said = F.transform("evidence", lambda e: F.when(F.coalesce(e["file_path"], F.lit("")) != "", cited(e)).otherwise(text("- ", mark(e), "> ", quote(e))))
    source = said if run.has("raw") else F.array(below_cut(F.size("evidence"), "source excerpt"))
    parts = F.array(
        text("## [", F.col("anchor"), "] ", F.col("summary")),
        text("*", F.coalesce(F.nullif(F.col("occurred_at"), F.lit("")), F.lit("undated")), " · ", kind, " · confidence ", two_places(F.coalesce("confidence", F.lit(1.0))), "* ^", F.col("anchor"), "\n"),
        listed("Entities", "entities", lambda e: text(e["name"], " (", e["type"], "/", e["role"], ")"), ", "), listed("Topics", "topics", lambda t: text("`", t, "`"), ", "), listed("Tags", "tags", lambda t: t, ", "),
        F.lit("\n**Source:**"),
    )
    body = F.array_join(F.filter(F.concat(parts, source), lambda x: x.isNotNull()), "\n")
    own = lines(facts, path, place(group=1, section=F.col("idx")), body)
    ends = lines(facts, path, place(group=1, section=F.col("idx"), part=9), F.lit("\n"))
    by = ranked(patterns.withColumn("_p", F.col("idx")), ["topic", "_p", "anchor"], "source_facts").select("topic", F.col("e.idx").alias("idx"), F.col("e.conf").alias("conf"), "_p", "anchor")
    by = by.join(facts.select("topic", "idx"), ["topic", "idx"], "left_semi")
    w = Window.partitionBy("topic", "idx").orderBy(F.desc("conf"), "_p")  # the patterns that cite one fact
    by = by.withColumn("rank", F.row_number().over(w))
    line = text("- ", link(text(f"{run.prefix}{PATTERNS}/", F.col("topic"), "#^", F.col("anchor")), text("patterns/", F.col("topic"), "/", F.col("anchor"))), " · confidence ", two_places(F.col("conf")))
    return reduce(DataFrame.unionByName, [front, own, _bullets(by, path, 1, F.col("idx"), 1, F.col("rank"), line, "Cited by (patterns):", F.col("rank") == 1), ends])


def _doubtful(df: DataFrame, path: Column, group: Column | int, section: Column) -> DataFrame:
    return lines(df.filter("hallucinated > 0"), path, place(group=group, section=section, part=3), text("\n*⚠ ", F.col("hallucinated"), " hallucinated refs*"))


def patterns_pages(run: Run, patterns: DataFrame, insights: DataFrame, trees: DataFrame) -> DataFrame:
    path, section = _page(F.col("topic"), PATTERNS), F.col("idx")
    front = lines(_counts(patterns, ["topic"]), path, place(), text("---\ntopic: ", F.col("topic"), "\nlayer: patterns\ncount: ", F.col("n"), "\n---\n\n# ", titled(F.col("topic")), " — patterns\n"))
    kind, domain = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("pattern")), F.coalesce(F.nullif(F.col("domain"), F.lit("")), "topic")
    own = lines(patterns, path, place(group=1, section=section), text("## [", F.col("anchor"), "] ", F.col("name"), "\n*", kind, " · count ", F.col("count"), " · domain ", domain, "* ^", F.col("anchor"), "\n\n", F.col("description")))
    head = lines(patterns.filter(F.size("source_facts") > 0), path, place(group=1, section=section, part=1), F.lit("\n**Provenance:**"))
    walk = tree_lines(trees, path, 1, section, 1, ["r1", "r2"])
    by = insights.select(F.col("scope"), F.col("idx").alias("i"), F.explode("source_patterns").alias("e")).select("scope", "i", F.col("e.topic").alias("topic"), F.col("e.idx").alias("idx"), F.col("e.conf").alias("conf"))
    by = by.join(patterns.select("topic", "idx"), ["topic", "idx"], "left_semi")
    by = by.withColumn("rank", F.row_number().over(Window.partitionBy("topic", "idx").orderBy(F.desc("conf"), "scope", "i")))
    a = insight_anchor(F.col("scope"), F.col("i"))
    line = text("- ", link(text(f"{run.prefix}{INSIGHTS}#^", a), text("insights/", a)), " · confidence ", two_places(F.col("conf")))
    ends = lines(patterns, path, place(group=1, section=section, part=9), F.lit("\n"))
    return reduce(DataFrame.unionByName, [front, own, head, walk, _bullets(by, path, 1, section, 2, F.col("rank"), line, "Cited by (insights):", F.col("rank") == 1), _doubtful(patterns, path, 1, section), ends])


def insights_page(run: Run, patterns: DataFrame, insights: DataFrame, actions: DataFrame, trees: DataFrame) -> DataFrame:
    path, section = F.lit(f"{INSIGHTS}.md"), F.col("idx")
    cross = lambda: F.count_if(F.col("scope") == "cross_domain")
    n = insights.agg(cross().alias("x"), F.count("*").alias("all")).select("x", (F.col("all") - F.col("x")).alias("c"))
    n = n.withColumn("t", patterns.agg(F.count_distinct("topic").alias("t")).scalar())
    jump = F.array_join(F.filter(F.array(F.when(F.col("x") > 0, "[Cross-domain](#cross-domain)"), F.when(F.col("c") > 0, "[Critical](#critical)"), link(F.lit(f"{run.prefix}{ACTIONS}"), F.lit("→ Actions"))), lambda v: v.isNotNull()), " · ")
    some = (F.col("x") > 0) | (F.col("c") > 0)
    front = lines(n, path, place(), text(
        "---\nlayer: insights\ncross_domain: ", F.col("x"), "\ncritical: ", F.col("c"), "\n---\n\n# Insights\n\n> Higher-level patterns synthesized across ", counted(F.col("t"), "topic"), ". **", F.col("x"), "** cross-domain, **",
        F.col("c"), "** critical.\n", F.when(some, text("\nJump to: ", jump, "\n")).otherwise("\n*(no insights detected)*\n"),
    ))
    group = F.when(F.col("scope") == "cross_domain", 1).otherwise(2)
    heads = lines(insights.filter("idx = 0"), path, place(group=group, section=-1), F.when(F.col("scope") == "cross_domain", "## Cross-domain\n").otherwise("## Critical\n"))
    numbered = insights.crossJoin(F.broadcast(n.select("x")))  # one row
    nth, anchor = F.when(F.col("scope") == "cross_domain", 0).otherwise(F.col("x")) + F.col("idx") + 1, insight_anchor(F.col("scope"), F.col("idx"))
    domains = F.when(F.size("domains") > 0, F.array_join("domains", ", ")).otherwise("—")
    asked = F.when(F.size("proposed_actions") > 0, text("\n\n**Proposed actions:**\n", F.array_join(F.transform("proposed_actions", lambda a: text("- ", a)), "\n")))
    own = lines(numbered, path, place(group=group, section=section), text(
        "### [", nth, "] ", F.col("name"), "\n*", F.translate("scope", "_", "-"), " · domains: ", domains, "* ^", anchor, "\n\n", F.col("description"), "\n\n**Mechanism:** ", F.col("mechanism"),
        "\n\n**Implication:** ", F.col("implication"), asked,
    ))
    head = lines(insights.filter(F.size("source_patterns") > 0), path, place(group=group, section=section, part=1), F.lit("\n**Provenance:**"))
    walk = tree_lines(trees, path, group, section, 1, ["r1", "r2", "r3"])
    by = actions.select(F.col("idx").alias("a"), F.explode("source_insights").alias("e")).select("a", F.col("e.scope").alias("scope"), F.col("e.idx").alias("idx"), F.col("e.conf").alias("conf"))
    by = by.join(insights.select("scope", "idx"), ["scope", "idx"], "left_semi")
    by = by.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "idx").orderBy(F.desc("conf"), "a")))
    to = text("action-", F.col("a") + 1)
    line = text("- ", link(text(f"{run.prefix}{ACTIONS}#^", to), text("actions/", to)), " · confidence ", two_places(F.col("conf")))
    ends = lines(insights, path, place(group=group, section=section, part=9), F.lit("\n"))
    return reduce(DataFrame.unionByName, [front, heads, own, head, walk, _bullets(by, path, group, section, 2, F.col("rank"), line, "Leads to actions:", F.col("rank") == 1), _doubtful(insights, path, group, section), ends])


def linked_numbers(run: Run, t: Column, cross: Column, total: Column) -> Column:
    """A text in which [N], the running number of an insight over both scopes, links to it."""
    pieces = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(?s)((?<![A-Za-z0-9])\[\d+\]|.)"), F.lit(1))

    def one(piece: Column) -> Column:
        n = F.regexp_extract(piece, r"^\[(\d+)\]$", 1).try_cast("long")
        anchor = F.when(n <= cross, text("cross-domain-", n)).otherwise(text("critical-", n - cross))
        return F.when((n >= 1) & (n <= total), link(text(f"{run.prefix}{INSIGHTS}#^", anchor), n)).otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def actions_page(run: Run, insights: DataFrame, actions: DataFrame, trees: DataFrame) -> DataFrame:
    path, section = F.lit(f"{ACTIONS}.md"), F.col("idx")
    n = actions.agg(F.count("*").alias("n"))
    none = F.when(F.col("n") == 0, "\n*(no actions generated)*\n")
    front = lines(n, path, place(), text("---\nlayer: actions\ncount: ", F.col("n"), "\n---\n\n# Actions\n\nPrioritized from the proposed actions across all insights.\n`review_date` is the next **check-in**, not a completion deadline.\n", none))
    counts = insights.agg(F.count_if(F.col("scope") == "cross_domain").alias("_x"), F.count("*").alias("_all"))
    rows = actions.crossJoin(F.broadcast(counts))  # one row
    prose = lambda c: linked_numbers(run, F.col(c), F.col("_x"), F.col("_all"))
    anchor = text("action-", F.col("idx") + 1)
    told = [p for head, c in (("Objective", "objective"), ("Why", "why"), ("Immediate action (7d)", "immediate_action"), ("Habit", "habit"), ("Success metric", "success_metric")) for p in (f"\n\n**{head}:** ", prose(c))]
    weights = (0.25, 0.20, 0.15, 0.15, 0.10, 0.075, 0.075)
    score = F.coalesce("score", reduce(lambda a, b: a + b, [w * F.coalesce(c, F.lit(0.0)) for w, (_, c) in zip(weights, SCORES, strict=True)]))
    scores = [p for i, (name, c) in enumerate(SCORES) for p in (f"{' · ' if i else ''}{name} ", two_places(F.col(c)))]
    own = lines(rows, path, place(group=1, section=section), text(
        "## [", anchor, "] ", F.col("recommendation"), "\n*", F.col("horizon"), " horizon · score ", two_places(score), " · confidence ", two_places(F.coalesce("confidence", F.lit(1.0))), " · review ", F.col("review_date"), "* ^", anchor,
        *told, "\n\n**Scores:** ", F.when(F.coalesce("kind", F.lit("")) != "", text(F.col("kind"), " · ")), *scores,
    ))
    head = lines(actions.filter(F.size("source_insights") > 0), path, place(group=1, section=section, part=1), F.lit("\n**Provenance:**"))
    walk = tree_lines(trees, path, 1, section, 1, ["r1", "r2", "r3", "r4"])
    ends = lines(actions, path, place(group=1, section=section, part=9), F.lit("\n"))
    return reduce(DataFrame.unionByName, [front, own, head, walk, _doubtful(actions, path, 1, section), ends])


def entity_pages(run: Run, facts: DataFrame) -> DataFrame:
    ents = run.entities
    path = text(f"{ENTITIES}/", F.col("canonical_id"), ".md")
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.when(F.col("canonical_id") == F.lit(run.subject), "subject"))
    about = trimmed(F.col("description"))
    front = lines(ents, path, place(), text(
        "---\nlayer: entity\ncanonical_id: ", F.col("canonical_id"), "\nentity_type: ", F.col("entity_type"), F.when(role.isNotNull(), text("\nrole: ", role)), "\n---\n\n# ", F.col("canonical_name"), "\n\n*",
        F.when(about != "", about).otherwise("(no description)"), "* ^entity\n",
    ))
    other = lines(ents.filter(F.size("aliases") > 0), path, place(group=1), text("## Aliases\n", F.array_join(F.transform("aliases", lambda a: text("- ", a)), "\n"), "\n"))
    ends = F.array_distinct(F.array("from_id", "to_id"))
    rel = run.relations.select("*", F.explode(ends).alias("canonical_id")).join(ents.select("canonical_id"), "canonical_id", "left_semi")
    names = ents.select(F.col("canonical_id").alias("_id"), F.col("canonical_name").alias("_n"))
    rel = rel.join(names.select(F.col("_id").alias("from_id"), F.col("_n").alias("_from")), "from_id", "left").join(names.select(F.col("_id").alias("to_id"), F.col("_n").alias("_to")), "to_id", "left")
    sure = F.coalesce("confidence", F.lit(1.0))
    rel = rel.withColumn("rank", F.row_number().over(Window.partitionBy("canonical_id").orderBy(sure.desc(), F.coalesce("relation", F.lit("")), "from_id", "to_id")))
    to = lambda side: link(text(f"{run.prefix}{ENTITIES}/", F.col(f"{side}_id"), "#^entity"), F.coalesce(F.nullif(F.col(f"_{side}"), F.lit("")), F.col(f"{side}_id")))
    ties = lines(rel, path, place(group=2, section=F.col("rank")), text(F.when(F.col("rank") == 1, "## Relations\n"), "- ", to("from"), " is ", F.col("relation"), " of ", to("to"), " (confidence ", two_places(sure), ")"))
    tail = lines(rel.filter("rank = 1"), path, place(group=2, section=F.lit((1 << 62))), F.lit(""))
    cited = ents.filter(F.size("refs") > 0)
    if not run.has("facts"):
        refs = lines(cited, path, place(group=3), text("## Cited in facts\n", below_cut(F.size("refs"), "fact")))
    else:
        each = cited.select("canonical_id", F.posexplode(F.slice("refs", F.lit(1), F.lit(MOST_REFS))).alias("i", "r")).select("canonical_id", "i", F.col("r.topic").alias("topic"), F.col("r.idx").alias("idx"))
        each = each.join(facts.select("topic", "idx", "anchor"), ["topic", "idx"], "left").withColumn("anchor", F.coalesce("anchor", text("fact-", F.col("idx") + 1)))
        refs = lines(each, path, place(group=3, section=F.col("i")), text(F.when(F.col("i") == 0, "## Cited in facts\n"), "- ", link(text(f"{run.prefix}{FACTS}/", F.col("topic"), "#^", F.col("anchor")), text(F.col("topic"), "/", F.col("anchor")))))
        refs = refs.unionByName(lines(cited.filter(F.size("refs") > MOST_REFS), path, place(group=3, section=MOST_REFS), text("- *(+", F.size("refs") - MOST_REFS, " more)*")))
    last = lines(cited, path, place(group=4), F.lit(""))
    return reduce(DataFrame.unionByName, [front, other, ties, tail, refs, last])


def index_page(run: Run) -> DataFrame:
    path = F.lit("index.md")
    one = run.stats.sparkSession.range(1)
    told = [(True, f"- {_plain_link(run, ACTIONS, 'Actions')}"), (True, f"- {_plain_link(run, INSIGHTS, 'Insights')}"), (run.has("patterns"), f"- {PATTERNS}/ — one file per topic"), (run.has("entities"), f"- {ENTITIES}/ — one file per canonical entity")]
    told += [(run.has("facts"), f"- {FACTS}/ — one file per topic"), (run.has("raw"), f"- {INPUTS}/ — preprocessed source files")]
    body = "\n## Top-level artifacts\n\n" + "\n".join(t for there, t in told if there) + "\n"
    stats = lines(run.stats, path, place(group=1, section=F.col("position")), text("- **", F.col("name"), "**: ", F.col("value")))
    return lines(one, path, place(), F.lit("# Run summary\n")).unionByName(stats).unionByName(lines(one, path, place(group=2), F.lit(body)))


def _plain_link(run: Run, target: str, shown: str) -> str:
    return f"[[{run.prefix}{target}|{shown}]]"


def spliced(body: str, spans: list[tuple[int, int, str]]) -> str:
    """body with a marker after each span (begin, end, marker) and its closing punctuation, and one anchor at the end of each line in which spans end: the begin, among
    spans by their end, that no line further down has taken. Lines with an anchor stand between blank lines."""
    marks: dict[int, str] = {}
    ends: dict[int, list[int]] = {}
    for begin, end, marker in sorted(spans, key=lambda s: s[1]):
        at = end
        while at < len(body) and body[at] in AFTER_SPAN:
            at += 1
        marks[at] = marks.get(at, "") + marker
        stop = body.find("\n", end)
        ends.setdefault(stop if stop >= 0 else len(body), []).append(begin)
    anchors, taken = {}, set()
    for stop in sorted(ends, reverse=True):
        own = next((b for b in ends[stop] if b not in taken), None)
        if own is not None:
            taken.add(own)
            anchors[stop] = f" ^offset-{own}"
    blank = set()
    for stop in ends:
        start = body.rfind("\n", 0, max(0, stop)) + 1
        if start >= 2 and body[start - 2] != "\n":
            blank.add(start)
        if stop + 1 < len(body) and body[stop + 1] != "\n":
            blank.add(stop + 1)
    out, at = [], 0
    for place_ in sorted({*marks, *anchors, *blank}):
        cut = min(place_, len(body))
        out += [body[at:cut], f" {marks[place_]}" if place_ in marks else "", "\n" if place_ in blank else "", anchors.get(place_, "")]
        at = cut
    return "".join([*out, body[at:]])


def input_spans(run: Run, facts: DataFrame) -> DataFrame:
    """file_id and the spans (begin, end, marker) of all excerpts that stand in it, in order of topics, facts and excerpts."""
    each = facts.select("topic", "topic_no", "idx", "anchor", F.posexplode("evidence").alias("i", "e")).filter("e.file_path <> '' AND e.file_offset IS NOT NULL AND e.file_length IS NOT NULL")
    marker = link(text(f"{run.prefix}{FACTS}/", F.col("topic"), "#^", F.col("anchor")), text("[", F.col("topic"), "/", F.col("anchor"), "]"))
    span = F.struct("topic_no", "idx", "i", F.col("e.file_offset").alias("begin"), (F.col("e.file_offset") + F.col("e.file_length")).alias("end"), marker.alias("marker"))
    return each.groupBy(F.col("e.file_path").alias("file_id")).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def input_pages(run: Run, facts: DataFrame) -> DataFrame:
    """The input files with markers and anchors; a file is read once, from its begin to its end."""
    spans = F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["marker"].alias("marker")))
    rows = run.inputs.join(input_spans(run, facts), "file_id", "left").select("file_id", F.col("text").alias("body"), spans.alias("spans"))

    def run_(batches):
        for b in batches:
            own = [[(s["begin"], s["end"], s["marker"]) for s in (spans if spans is not None else ())] for spans in b["spans"]]
            yield pd.DataFrame({"file_id": b["file_id"], "n": [len(s) for s in own], "body": [spliced(t or "", s) for t, s in zip(b["body"], own, strict=True)]})

    made = rows.mapInPandas(run_, "file_id string, n long, body string")
    front = text("---\nlayer: input\nfile_id: ", F.col("file_id"), "\ncited_facts: ", F.col("n"), "\n---\n\n# ", F.col("file_id"), "\n", escaped(F.col("body")))
    return lines(made, text(f"{INPUTS}/", F.col("file_id"), ".md"), place(), front)


def page_lines(run: Run) -> DataFrame:
    """(path, at, text) of all pages of a run under its level."""
    facts, patterns = anchored(run)
    run = replace(run, facts=facts, patterns=patterns)
    of_facts = fact_trees(run, facts, patterns)
    of_patterns = pattern_trees(run, patterns, run.insights, of_facts)
    pages = [index_page(run), actions_page(run, run.insights, run.actions, insight_trees(run, run.insights, run.actions, of_patterns)), insights_page(run, patterns, run.insights, run.actions, of_patterns)]
    if run.has("patterns"):
        pages.append(patterns_pages(run, patterns, run.insights, of_facts))
    if run.has("entities"):
        pages.append(entity_pages(run, facts))
    if run.has("facts"):
        pages.append(facts_pages(run, facts, patterns))
    if run.has("raw"):
        pages.append(input_pages(run, facts))
    return reduce(DataFrame.unionByName, pages)
