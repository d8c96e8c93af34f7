"""Display texts: what a reader sees of records, numbers, dates and provenance. Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import truncated
from .graph import located

# Labels of record kinds, patterns of what models say before a description, the most runs a list shows.
KIND_LABELS = {"chunk": "document section", "fact": "fact", "entity": "entity", "pattern": "pattern", "insight": "insight", "action": "action", "document": "document"}
PREAMBLES = (
    r"(?i)^(got it|sure|here(?: is| you go)|let me|okay|ok)[,.!]?\s*.*?[.\n]",
    r"(?i)^(the image shows|this image (?:shows|contains|depicts))\s*.*?[.\n]",
    r"(?i)^i('ll| will| can)?\s*(transcribe|describe|analyze).*?[.\n]",
)
RECENT_RUNS = 20


def present(text: Column, before: str = "", after: str = "") -> Column:
    """before, the trimmed text and after; null where there is no text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t != "", F.concat(F.lit(before), t, F.lit(after)))


def listed(items: Column, before: str = "", sep: str = ", ") -> Column:
    return F.when(F.size(F.coalesce(items, F.array())) > 0, F.concat(F.lit(before), F.array_join(items, sep)))


def kind_label(kind: Column) -> Column:
    """The label of a kind; an unknown kind is its own."""
    out = kind
    for k, label in KIND_LABELS.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def type_header(kind: Column) -> Column:
    return F.concat(F.lit("Type: "), kind_label(kind))


def type_and_role(kind: Column, role: Column) -> Column:
    return F.nullif(F.concat_ws(" · ", F.nullif(kind, F.lit("")), F.nullif(role, F.lit(""))), F.lit(""))


def fact_text(summary: Column, date: Column, topics: Column, tags: Column) -> Column:
    return F.concat_ws("\n", present(summary), present(date, "date: "), listed(topics, "topics: "), listed(tags, "tags: "))


def entity_text(name: Column, kind: Column, role: Column, aliases: Column, description: Column) -> Column:
    return F.concat_ws("\n", present(name), type_and_role(kind, role), listed(aliases, "aliases: "), present(description))


def pattern_text(name: Column, kind: Column, domain: Column, description: Column) -> Column:
    return F.concat_ws("\n", present(name), type_and_role(kind, domain), present(description))


def insight_text(name: Column, kind: Column, description: Column, mechanism: Column, implication: Column) -> Column:
    return F.concat_ws("\n", present(name), present(kind), present(description), present(mechanism, "mechanism: "), present(implication, "implication: "))


def action_text(recommendation: Column, kind: Column, objective: Column, why: Column, now: Column, habit: Column, metric: Column) -> Column:
    labels = ((objective, "objective: "), (why, "why: "), (now, "immediate action: "), (habit, "habit: "), (metric, "success metric: "))
    return F.concat_ws("\n", present(recommendation), present(kind), *(present(c, label) for c, label in labels))


def section_prefix(path: Column) -> Column:
    return F.coalesce(F.concat(listed(path, "Section: ", " › "), F.lit("\n\n")), F.lit(""))


def chunk_text(file_id: Column, path: Column, text: Column) -> Column:
    """Source, section and text; one blank line before the text."""
    source = F.when(F.coalesce(file_id, F.lit("")) != "", F.concat(F.lit("Source: "), file_id, F.when(F.size(path) > 0, "\n").otherwise("\n\n")))
    return F.concat(F.coalesce(source, F.lit("")), section_prefix(path), text)


def document_text(file_id: Column, date: Column, title: Column, chunks: Column, sections: Column, summaries: Column, width: int = 200) -> Column:
    many = F.concat(chunks.cast("string"), F.when(chunks == 1, " chunk").otherwise(" chunks"))
    points = F.transform(summaries, lambda s: F.concat(F.lit("- "), truncated(s, width)))
    said = F.when(F.size(summaries) > 0, F.concat(F.lit("\nSummary:\n"), F.array_join(points, "\n")))
    return F.concat_ws("\n", F.concat(F.lit("File: "), file_id), present(date, "Date: "), present(title, "Title: "), many, listed(sections, "Sections: ", "; "), said)


def without_preamble(text: Column, layers: int = 3) -> Column:
    """A description without what models say before it, up to three layers of it."""
    t = F.regexp_replace(text, r"^\s+", "")
    for _ in range(layers):
        for pattern in PREAMBLES:  # they match at the begin alone, so at most once
            t = F.regexp_replace(F.regexp_replace(t, pattern, ""), r"^\s+", "")
    return F.regexp_replace(t, r"\s+$", "")


def without_fences(raw: Column) -> Column:
    """What the last fenced block holds; without a closed block, the text without fence marks."""
    blocks = F.regexp_extract_all(raw, F.lit(r"```(?:json)?\s*\n?([\s\S]*?)```"), F.lit(1))
    kept = F.when(F.size(blocks) > 0, F.get(blocks, F.size(blocks) - 1)).otherwise(F.regexp_replace(raw, r"```(?:json)?", ""))
    return F.regexp_replace(F.coalesce(kept, F.lit("")), r"^\s+|\s+$", "")


def grouped_number(n: Column) -> Column:
    """Thousands apart, two decimals if it is no whole number, a dash for none."""
    whole = F.format_string("%,d", n.cast("long"))
    return F.when(n.isNull(), "—").when(n == F.floor(n), whole).otherwise(F.format_string("%,.2f", n.cast("double")))


def duration(ms: Column) -> Column:
    """Milliseconds as ms, s, m s or h m s."""
    s = F.floor(ms / 1000).cast("long")
    return (
        F.when(ms.isNull(), "—").when(ms < 1000, F.concat(F.floor(ms).cast("string"), F.lit("ms"))).when(ms < 60_000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))
        .when(ms < 3_600_000, F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60))
        .otherwise(F.format_string("%dh %dm %ds", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60))
    )


def pretty_date(day: Column, today: Column) -> Column:
    """Month and day, and the year if it is not this one."""
    return F.when(F.year(day) == F.year(today), F.date_format(day, "MMM d")).otherwise(F.date_format(day, "MMM d, yyyy"))


def graph_line(indent: Column, link: Column, percent: Column, snippet: Column, approximate: Column) -> Column:
    """A bullet of a provenance tree."""
    said = F.when(F.coalesce(F.trim(snippet), F.lit("")) != "", F.concat(F.lit(': *"'), F.regexp_replace(F.trim(snippet), "\n", " "), F.lit('"*'))).otherwise("")
    return F.concat(F.repeat(F.lit("  "), indent), F.lit("- **"), percent, F.lit("% match**  "), F.when(approximate, "≈ ").otherwise(""), link, said)


def boundary_line(indent: Column, n: Column, noun: str) -> Column:
    """What stands for a level that is not exported."""
    return F.concat(F.repeat(F.lit("  "), indent), F.lit("- *↳ "), n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"), F.lit(" below the privacy cut (not exported)*"))


def run_list(runs: DataFrame, name: str, created: str, insights: str, recent: int = RECENT_RUNS) -> DataFrame:
    """One row, readme: how many runs there are and links to the newest ones, by name where two are as new. Only those are gathered."""
    newest = runs.orderBy(F.desc(created), F.desc(name)).limit(recent)
    link = F.concat(F.lit("- [["), F.col(name), F.when(F.col(insights), "/4-insights").otherwise(""), F.lit("|"), F.col(name), F.lit("]]"))
    lines = newest.agg(F.sort_array(F.collect_list(F.struct(F.col(created).alias("c"), F.col(name).alias("n"), link.alias("l"))), asc=False).alias("x"))
    total = runs.agg(F.count("*").alias("n")).scalar()
    head = F.format_string("# Runs\n\nTotal runs: %d\n\n## Most recent\n\n", total)
    tail = F.when(total > recent, F.format_string("\n\n*(+%d older runs)*", total - recent)).otherwise("")
    return lines.select(F.concat(head, F.array_join(F.transform("x", lambda r: r["l"]), "\n"), tail, F.lit("\n")).alias("readme"))


def found_in(docs: DataFrame, doc: str, text: str, needle: str, most: int = 5000) -> DataFrame:
    """doc and the begin of each match of a literal in its text, the first `most` of a text (as many as a reader steps through)."""
    parts = F.split(F.col(text), re.escape(needle))
    rows = docs.select(doc, F.posexplode(F.slice(parts, F.lit(1), F.least(F.size(parts) - 1, F.lit(most)))).alias("nth", "part"))
    before = Window.partitionBy(doc).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(doc, "nth", (F.sum(F.length("part")).over(before) + F.col("nth") * len(needle)).alias("begin"))


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, segment, seg_begin, seg_end) of a text's lines: segments that follow each other without gaps; a line ends after its feed."""
    parts = docs.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("segment", "part"), F.length(text).alias("_n"))
    before = Window.partitionBy(doc).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("_to", F.sum(F.length("part") + 1).over(before))
    return rows.select(doc, "segment", (F.col("_to") - F.length("part") - 1).alias("seg_begin"), F.least("_to", F.col("_n").cast("long")).alias("seg_end")).filter("seg_end > seg_begin")


def found_in_segments(docs: DataFrame, segments: DataFrame, doc: str, text: str, needle: str, most: int = 5000) -> DataFrame:
    """found_in() with the segments (doc, segment, seg_begin, seg_end) that hold the first and the last character of each match."""
    hits = found_in(docs, doc, text, needle, most)
    ends = hits.withColumn("_ends", F.array(F.struct(F.lit(0).alias("which"), F.col("begin").alias("at")), F.struct(F.lit(1).alias("which"), (F.col("begin") + len(needle) - 1).alias("at"))))
    placed = located(ends.select(doc, "nth", "begin", F.explode("_ends").alias("e")).select(doc, "nth", "begin", "e.which", "e.at"), segments, doc, "at", "seg_begin", "seg_end")
    of = lambda which: F.max(F.when(F.col("which") == which, F.col("segment")))
    return placed.groupBy(doc, "nth", "begin").agg(of(0).alias("segment"), of(1).alias("last_segment"))
