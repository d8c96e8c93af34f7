"""Greedy bins over ranges, runs of small units and the lead of a run, against one pass."""

from __future__ import annotations

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from docgraph.functions import scalar as S
from docgraph.operators import split
from docgraph.plans import registry

SF = f"{DATA}/sf0.001"


def one_pass(rows, budget):
    """bin of each (group, id): rows are (group, id, size, spare)."""
    out, load, bin_, key = {}, 0, 0, object()
    for g, i, n, less in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n = n or 0
        if g != key:
            key, bin_, load = g, 0, n - less
        elif load + n > budget:
            bin_, load = bin_ + 1, n - less
        else:
            load += n
        out[g, i] = bin_
    return out


@pytest.mark.parametrize("seed", range(6))
def test_bins_over_ranges(spark, seed):
    """A hot group, small groups, a null group; empty rows, rows beyond the budget, and spared parts."""
    rng = random.Random(seed)
    sizes = [[1, 2, 3], [0, 0, 5], [40, 0, 150, 1], [99, 100, 101], [0], [7, 300]][seed]
    rows = [("hot", i, rng.choice(sizes), 0) for i in range(700)] + [(rng.choice(["a", "b", None]), i, rng.choice(sizes), 0) for i in range(60)] + [("c", 0, None, 0)]
    if seed % 2:
        rows = [(g, i, n, rng.randrange((n or 0) + 1)) for g, i, n, _ in rows]
    df = spark.createDataFrame(rows, "g string, i int, n long, less long").repartition(9)
    got = {(r.g, r.i): r.bin for r in split.greedy_pack(df, ["g"], ["i"], "n", 100, "less").collect()}
    assert got == one_pass(rows, 100)
    assert split.greedy_pack(df.limit(0), ["g"], ["i"], "n", 100).count() == 0


def test_ranges_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lit("one").alias("g"), F.length("text").cast("long").alias("n"))
    got = {("one", r.doc_id): r.bin for r in split.greedy_pack(docs.repartition(4), ["g"], ["doc_id"], "n", 3000).collect()}
    assert got == one_pass([("one", r.doc_id, r.n, 0) for r in docs.collect()], 3000) and max(got.values()) > 3


def test_runs_are_combined(spark):
    units = [("s", i, kind, n) for i, (kind, n) in enumerate([("a", 30), ("a", 30), ("b", 10), (None, 50), (None, 50), ("a", 60), ("a", 30), ("a", 20), ("a", 90)])]
    df = spark.createDataFrame(units, "source string, id int, kind string, n int")
    got = {r.id: (r.run, r.bin) for r in split.combined(df, ["source"], ["id"], F.col("kind"), F.col("n"), F.lit(5), 100, most=80).collect()}
    runs = [got[i][0] for i in range(9)]
    assert [runs[k] == runs[k - 1] for k in range(1, 9)] == [True, False, False, False, False, True, True, True]
    assert got[0][1] == got[1][1] == 0  # 30 + 5 + 30 fit the budget as they are
    assert [got[i][1] for i in range(5, 9)] == [0, 1, 1, 2]


def test_lead_is_carved(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.length("text") > 900).select("doc_id", "text")
    rows = sorted(registry.QUERIES["spl_carved"](spark, SF).collect(), key=lambda r: (r.doc_id, r.piece))
    texts = {r.doc_id: r.text for r in docs.collect()}
    lead = min(texts)
    heads, whole = [r for r in rows if r.doc_id == lead], [r for r in rows if r.doc_id != lead]
    assert {r.doc_id: r.text for r in whole} == {i: t for i, t in texts.items() if i != lead} and all(r.kind == "whole" for r in whole)
    bounds = split.greedy_bounds(texts[lead], 150)
    text = texts[lead]
    parts = [(a, text[a:z]) for a, z in bounds if text[a:z].strip()]
    second = parts[1][0] + len(parts[1][1]) - len(parts[1][1].lstrip())
    assert (heads[0].kind, heads[0].text) == ("head", parts[0][1].strip())
    rest = text[second:]
    want = [(second + a + len(rest[a:z]) - len(rest[a:z].lstrip()), rest[a:z].strip()) for a, z in split.greedy_bounds(rest, 200) if rest[a:z].strip()]
    assert [(r.origin_char, r.text) for r in heads[1:]] == want and all(r.kind == "rest" for r in heads[1:])
    assert all(text[r.origin_char :].startswith(r.text) for r in heads)


def test_what_is_not_carved(spark):
    schema = "doc_id long, text string"
    small = spark.createDataFrame([(1, "short"), (2, "x" * 5000)], schema)
    assert {(r.doc_id, r.kind) for r in split.carved(small, "doc_id", cap=100).collect()} == {(1, "whole"), (2, "whole")}
    long = spark.createDataFrame([(1, "A sentence of words. " * 100), (2, "y")], schema)
    assert {r.kind for r in split.carved(long, "doc_id", cap=100, joined=F.lit(True)).collect()} == {"whole"}
    assert {r.kind for r in split.carved(long, "doc_id", cap=100).collect()} == {"head", "rest", "whole"}
    assert split.carved(long.limit(0), "doc_id").count() == 0
    assert S.count_tokens(F.lit("")) is not None


def chunks_by_hand(text, limit):
    """Sections by lines, then windows of a section that is too long."""
    if len(text) // 3 <= limit:
        return [(0, [], text.strip())] if text.strip() else []
    sections, stack, at = [(0, [])], [], 0
    for line in text.splitlines(keepends=True):
        head = line.rstrip("\n")
        mark = head.split(None, 1)[0] if head.startswith("#") and len(head.split(None, 1)) == 2 else ""
        if mark in ("#", "##", "###") and head[len(mark)].isspace():
            stack = [x for x in stack if x[0] < len(mark)] + [(len(mark), head[len(mark) :].strip())]
            sections.append((at, [t for _, t in stack]))
        at += len(line)
    sections = [(b, p, e) for (b, p), (e, _) in zip(sections, [*sections[1:], (len(text), None)], strict=True) if e > b]
    out, size, stride = [], limit * 3, (limit - limit // 8) * 3
    for b, path, e in sections:
        at = b
        while at < e:
            to = e if (e - b) // 3 <= limit else min(e, at + size)
            if text[at:to].strip():
                out.append((at, path, text[at:to].strip()))
            at = e if to == e else at + stride
    return out


def test_sections_by_hand(spark):
    texts = ["", "short", "# A\n\nfirst words\n## B\nsecond\n### C\nthird part\n# D\n" + "long words " * 30, "before\n# One\nx\n#no heading\n####  four\n## Two \n" + "y " * 40, "no headings at all " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (8, 20, 500):
        got = {}
        for r in split.chunk(docs, limit).collect():
            got.setdefault(r.doc_id, []).append((r.char_offset, list(r.section_path), r.chunk))
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(c) for i, t in enumerate(texts) if (c := chunks_by_hand(t, limit))}
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {}
    for r in registry.QUERIES["spl_sections"](spark, SF).collect():
        found.setdefault(r.doc_id, []).append((r.char_offset, list(r.section_path), r.chunk))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(c) for i, t in rows.items() if (c := chunks_by_hand(t, 512))}
