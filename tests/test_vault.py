"""Whole runs as pages: the golden files of the fixtures, levels, splices and the writer."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docgraph.operators import vault
from docgraph.sources import pages

#: A folder of runs with `inputs` (JSON) and `golden` (pages), where there is one.
GOLDEN = os.environ.get("GOLDEN_RUNS", "")
EVIDENCE = "array<struct<text:string,file_path:string,file_offset:bigint,file_length:bigint,approximate:boolean>>"
SCHEMAS = {
    "facts": f"topic string, topic_no int, idx long, type string, summary string, occurred_at string, confidence double, entities array<struct<name:string,type:string,role:string>>, topics array<string>, tags array<string>, evidence {EVIDENCE}",
    "patterns": "topic string, idx long, name string, kind string, count long, domain string, description string, source_facts array<struct<idx:long,conf:double>>, hallucinated long",
    "insights": "scope string, idx long, name string, domains array<string>, description string, mechanism string, implication string, proposed_actions array<string>, source_patterns array<struct<topic:string,idx:long,conf:double>>, hallucinated long",
    "actions": "idx long, recommendation string, kind string, objective string, why string, immediate_action string, habit string, success_metric string, horizon string, review_date string, regret_reduction double, leverage double, consequence double, generativity double, decisiveness double, time_to_feedback double, constraint_fit double, confidence double, score double, source_insights array<struct<scope:string,idx:long,conf:double>>, hallucinated long",
    "entities": "canonical_id string, canonical_name string, entity_type string, role string, description string, aliases array<string>, refs array<struct<topic:string,idx:long>>",
    "relations": "from_id string, to_id string, relation string, confidence double", "stats": "position int, name string, value long", "inputs": "file_id string, text string",
}


def named(schema: str, row: dict) -> dict:
    names = [f.split(" ", 1)[0] for f in schema.replace(", ", ",").split(",") if " " in f]
    return {n: row.get(n) for n in names}


def loaded(spark, folder: Path, name: str, level: str = "raw") -> vault.Run:
    read = lambda n: json.loads((folder / f"{n}.json").read_text()) if (folder / f"{n}.json").exists() else None
    floats = lambda xs, k: [(*x[:k], float(x[k])) for x in xs or []]
    facts, patterns, insights, actions, entities, stats = map(read, ("facts", "patterns", "insights", "actions", "entities", "stats"))
    rows: dict[str, list] = {k: [] for k in SCHEMAS}
    for t_no, (topic, own) in enumerate((facts or {}).items()):
        for i, f in enumerate(own):
            evidence = [{k: e.get(k) for k in ("text", "file_path", "file_offset", "file_length", "approximate")} for e in f.get("evidence") or []]
            ents = [{k: e.get(k) for k in ("name", "type", "role")} for e in f.get("entities") or []]
            rows["facts"].append({"topic": topic, "topic_no": t_no, "idx": i, **{k: f.get(k) for k in ("type", "summary", "occurred_at", "topics", "tags")}, "confidence": None if f.get("confidence") is None else float(f["confidence"]), "entities": ents, "evidence": evidence})
    for topic, own in (patterns or {}).items():
        for i, p in enumerate(own):
            rows["patterns"].append({**{k: p.get(k) for k in ("name", "kind", "count", "domain", "description")}, "topic": topic, "idx": i, "source_facts": floats(p.get("source_facts"), 1), "hallucinated": p.get("hallucinated_ref_count")})
    for scope in ("cross_domain", "critical"):
        for i, x in enumerate((insights or {}).get(scope) or []):
            rows["insights"].append({**{k: x.get(k) for k in ("name", "domains", "description", "mechanism", "implication", "proposed_actions")}, "scope": scope, "idx": i, "source_patterns": floats(x.get("source_patterns"), 2), "hallucinated": x.get("hallucinated_ref_count")})
    numbers = ("regret_reduction", "leverage", "consequence", "generativity", "decisiveness", "time_to_feedback", "constraint_fit", "confidence", "score")
    for i, a in enumerate((actions or {}).get("actions") or []):
        texts = {k: a.get(k) for k in ("recommendation", "kind", "objective", "why", "immediate_action", "habit", "success_metric", "horizon", "review_date")}
        rows["actions"].append({"idx": i, **texts, **{k: None if a.get(k) is None else float(a[k]) for k in numbers}, "source_insights": floats(a.get("source_insights"), 2), "hallucinated": a.get("hallucinated_ref_count")})
    for e in (entities or {}).get("entities") or []:
        rows["entities"].append({**{k: e.get(k) for k in ("canonical_id", "canonical_name", "entity_type", "role", "description", "aliases")}, "refs": [tuple(r) for r in e.get("evidence_fact_refs") or []]})
    for r in (entities or {}).get("relations") or []:
        rows["relations"].append({"from_id": r.get("from_id", r.get("from")), "to_id": r.get("to_id", r.get("to")), "relation": r.get("relation"), "confidence": float(r.get("confidence", 1))})
    rows["stats"] = [{"position": i, "name": k, "value": v} for i, (k, v) in enumerate((stats or {}).items())]
    rows["inputs"] = [{"file_id": p.stem, "text": p.read_text()} for p in sorted((folder / "preprocessed").glob("*.md"))] if (folder / "preprocessed").exists() else []
    made = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    return vault.Run(**made, subject=((entities or {}).get("subject") or {}).get("canonical_id"), name=name, level=level)


def run_name(folder: Path) -> str:
    first = (folder / "golden" / "index.md").read_text().split("[[", 1)[1]
    return first.split("/5-actions", 1)[0] if "/5-actions" in first else ""


@pytest.mark.parametrize("size", ["small", "medium", "large"])
def test_golden_pages(spark, tmp_path, size):
    folder = Path(GOLDEN) / size
    if not GOLDEN or not folder.exists():
        pytest.skip("GOLDEN_RUNS names no runs")
    run = loaded(spark, folder / "inputs", run_name(folder))
    pages.write_pages(vault.page_lines(run), str(tmp_path / "out"))
    want = {str(p.relative_to(folder / "golden")): p.read_text() for p in (folder / "golden").rglob("*.md")}
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.md")}
    assert set(got) == set(want)
    for path, content in want.items():
        assert got[path] == content, path


def small_run(spark, level="raw"):
    cited = {"text": "one two", "file_path": "f", "file_offset": 0, "file_length": 7, "approximate": True}
    rows = {
        "facts": [{"topic": "work", "topic_no": 0, "idx": i, "type": "event" if i else None, "summary": f"S<b>{i}", "confidence": None, "entities": [], "topics": [], "tags": ["x"], "evidence": [cited, {"text": 'say "no" \\ here', "file_path": ""}]} for i in range(2)],
        "patterns": [{"topic": "work", "idx": 0, "name": "P", "kind": "Some Kind", "count": 2, "description": "", "source_facts": [(0, 0.5), (7, 0.9), (1, 0.9)], "hallucinated": 2}],
        "insights": [{"scope": "critical", "idx": 0, "name": "I", "domains": [], "description": "d", "source_patterns": [("work", 0, 0.65), ("none", 1, 0.2)], "hallucinated": 0, "proposed_actions": []}],
        "actions": [{"idx": 0, "recommendation": "R", "why": "as [1] and [2] and x[1] say", "source_insights": [("critical", 0, 0.9), ("cross_domain", 4, 0.1)], "hallucinated": 0, "regret_reduction": 1.0}],
        "entities": [{"canonical_id": "e", "canonical_name": "E", "entity_type": "person", "aliases": [], "refs": [("work", 0)] * 32, "description": " "}], "relations": [{"from_id": "e", "to_id": "e", "relation": "r", "confidence": None}, {"from_id": "x", "to_id": "e", "relation": "a", "confidence": 1.0}],
        "stats": [{"position": 0, "name": "facts", "value": 2}], "inputs": [{"file_id": "f", "text": "one two. more <tag>\nnext"}, {"file_id": "g", "text": ""}],
    }
    return vault.Run(**{k: spark.createDataFrame([{**dict.fromkeys([c for c in spark.createDataFrame([], SCHEMAS[k]).columns]), **r} for r in v], SCHEMAS[k]) for k, v in rows.items()}, subject="e", level=level)


def contents(run) -> dict[str, str]:
    rows = vault.page_lines(run).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.path, tuple(r.at))):
        out.setdefault(r.path, []).append(r.text)
    return {k: "\n".join(v) for k, v in out.items()}


def test_levels(spark):
    seen = {level: contents(small_run(spark, level)) for level in vault.LEVELS}
    raw = seen["raw"]
    assert set(raw) == {"index.md", "4-insights.md", "5-actions.md", "3-patterns/work.md", "2-entities/e.md", "1-facts/work.md", "0-inputs/f.md", "0-inputs/g.md"}
    assert set(seen["actions"]) == {"index.md", "4-insights.md", "5-actions.md"} and set(seen["entities"]) == {"index.md", "4-insights.md", "5-actions.md", "3-patterns/work.md", "2-entities/e.md"}
    assert "*↳ 2 patterns below the privacy cut (not exported)*" in seen["insights"]["4-insights.md"] and "*↳ 3 facts below" in seen["patterns"]["3-patterns/work.md"]
    assert "*↳ 2 source excerpts below" in seen["facts"]["1-facts/work.md"] and "*↳ 1 source excerpt below" in seen["facts"]["3-patterns/work.md"] and "one two" not in "".join(seen["facts"].values())
    assert "*↳ 32 facts below" in seen["entities"]["2-entities/e.md"] and "- *(+2 more)*" in raw["2-entities/e.md"] and "*(no description)*" in raw["2-entities/e.md"]
    page = raw["3-patterns/work.md"]
    assert "## [some-kind-1] P\n*Some Kind · count 2 · domain work* ^some-kind-1" in page and "*⚠ 2 hallucinated refs*" in page
    assert page.index("`1-facts/work#^fact-8` · edge 0.90 · *broken*") < page.index("Work Event 1") < page.index("Work Fact 1")
    assert '**50% match**  [[1-facts/work#^fact-1|Work Fact 1]]: *"S`<b>`0"*' in page and '  - **50% match**  ≈ [[0-inputs/f#^offset-0|f @ 0:7]]: *"one two"*' in page
    assert "why" not in raw["5-actions.md"] and "**Why:** as [[4-insights#^critical-1|1]] and [2] and x[1] say" in raw["5-actions.md"] and "score 0.25" in raw["5-actions.md"]
    assert "`4-insights#^cross-domain-5` · edge 0.10 · *broken*" in raw["5-actions.md"] and "    - **29% match**" not in raw["4-insights.md"]
    assert raw["0-inputs/f.md"].endswith("# f\none two. [[1-facts/work#^fact-1|[work/fact-1]]][[1-facts/work#^event-1|[work/event-1]]] more `<tag>` ^offset-0\n\nnext") and raw["0-inputs/g.md"].endswith("cited_facts: 0\n---\n\n# g\n")


def plainly(body: str, spans: list[tuple[int, int, str]]) -> str:
    """Inserts one after another from the end of the text."""
    spans = sorted(spans, key=lambda s: s[1])
    inserts: dict[int, str] = {}
    marks, ends = {}, {}
    for b, e, m in spans:
        at = e
        while at < len(body) and body[at] in ".!?,;:\"')]}":
            at += 1
        marks.setdefault(at, []).append(m)
        ends.setdefault(body.find("\n", e) if "\n" in body[e:] else len(body), []).append(b)
    seen = set()
    for pos in sorted(ends, reverse=True):
        for b in ends[pos]:
            if b not in seen:
                seen.add(b)
                inserts[pos] = inserts.get(pos, "") + f" ^offset-{b}"
                break
    wrapped = set()
    for pos in ends:
        start = body.rfind("\n", 0, pos) + 1
        for at, there in ((start, start >= 2 and body[start - 2] != "\n"), (pos + 1, pos + 1 < len(body) and body[pos + 1] != "\n")):
            if there and at not in wrapped:
                wrapped.add(at)
                inserts[at] = "\n" + inserts.get(at, "")
    for at, own in marks.items():
        inserts[at] = " " + "".join(own) + inserts.get(at, "")
    for at in sorted(inserts, reverse=True):
        body = body[:at] + inserts[at] + body[at:]
    return body


@pytest.mark.parametrize("seed", range(40))
def test_splices(seed):
    rng = random.Random(seed)
    body = "".join(rng.choice("ab .,\n\n") for _ in range(rng.randrange(60)))
    spans = [(b := rng.randrange(len(body) + 1), min(len(body), b + rng.randrange(9)), f"<{k}>") for k in range(rng.randrange(6))]
    assert vault.spliced(body, spans) == plainly(body, spans)


def test_pages_are_written_whole(spark, tmp_path):
    rows = [(f"d/{k % 3}.md", k, f"line {k}") for k in range(300)] + [("one.md", 0, ""), ("one.md", 1, "é\nx")]
    lines = spark.createDataFrame(rows, "path string, at int, text string").repartition(7)
    for _ in range(2):  # a second time replaces
        pages.write_pages(lines, str(tmp_path / "out"))
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {"one.md": "\né\nx", **{f"d/{m}.md": "\n".join(f"line {k}" for k in range(m, 300, 3)) for m in range(3)}}
    fails = lines.withColumn("text", F.when(F.col("at") == 299, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        pages.write_pages(fails, str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
    with pytest.raises(ValueError):
        pages.write_pages(lines.withColumn("path", F.lit("../x")), str(tmp_path / "out"))
