"""A job from documents to actions: stopped, started again, and equal to one that ran through."""

from __future__ import annotations

import random

import pytest
from oracle import rows_of, sql_rows

from docgraph.operators import job, split
from docgraph.plans import registry
from docgraph.plans.synthesis import stage_provider

ROWS = [(i, f"Document {i} says the same thing in {'many ' * (i % 4)}words.") for i in range(9)] + [(9, None), (10, "  "), (11, "Document 1 says the same thing in many words.")]


def told(tables):
    return {n: sorted(map(str, tables[n].collect())) for n in ("facts", "patterns", "actions")}


def test_job_goes_on_where_it_stopped(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    whole = told(job.run_staged(job.pipeline(), {"documents": docs}, stage_provider, str(tmp_path / "a")))
    asked = tmp_path / "asked"
    asked.mkdir()

    def failing(calls):
        if calls["prompt"].str.startswith("PATTERNS").any() and not (asked / "again").exists():
            raise RuntimeError("stopped")
        if calls["prompt"].str.startswith("EXTRACT").any():
            (asked / f"extract-{abs(hash(tuple(calls['prompt'])))}").touch()
        return stage_provider(calls)

    where = str(tmp_path / "b")
    with pytest.raises(Exception):
        job.run_staged(job.pipeline(), {"documents": docs}, failing, where)
    assert list(job.published(spark, where, job.pipeline())) == ["extract"]
    seen = sorted(p.name for p in asked.iterdir())
    for p in asked.iterdir():
        p.unlink()
    (asked / "again").touch()
    assert told(job.run_staged(job.pipeline(), {"documents": docs}, failing, where)) == whole and seen
    assert [p.name for p in asked.iterdir()] == ["again"]  # extraction was not asked again
    assert told(job.run_staged(job.pipeline(), {"documents": docs}, None, where)) == whole  # all is there
    facts = whole["facts"]
    assert len(facts) == 9 and all("start_char=5" in f or "start_char=None" not in f for f in facts)
    assert "hallucinated=1" in whole["actions"][0] or "hallucinated=2" in whole["actions"][0]


def test_jobs_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert told(job.run_staged(job.pipeline(), {"documents": none}, stage_provider, str(tmp_path / "a"))) == {"facts": [], "patterns": [], "actions": []}
    bad = job.run_staged(job.pipeline(), {"documents": spark.createDataFrame(ROWS, "doc_id long, text string")}, lambda c: [{"payload": "{ no json"} for _ in c["prompt"]], str(tmp_path / "b"))
    assert bad["facts"].count() == 0 and bad["actions"].count() == 0


def test_job_asks_long_documents_in_parts(spark, tmp_path):
    """Documents around and above the budget of a call, cut at headings, blank lines, sentences, lines or fixed steps: each part makes its fact, by the query and by its SQL."""
    import duckdb

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij\u00e9\u65e5", k=rng.randrange(6, 12)))
    text = lambda n, *ends: "".join(word() + rng.choice(ends) for _ in range(n // 6))[:n]
    kinds = [("_",), (" ",), (" ", " ", "\n"), (" ", " ", ". ", "\u3000", "\n", "!\x0b"), (" ", ". ", "\n", "\n \n", "?\n"), (" ", ".\u0085", "\n# ", "\n## head\n", "\n### ", "\n#\n")]
    texts = [text(n, *ends) for n in (10, 48_000, 48_001, 48_002, 48_003, 100_000, 200_000) for ends in kinds] + [None, "", " \n", text(47_000, "_") + "\n\n" + " " * 60_000 + text(50_000, "_")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = [(i, t[a:z].strip()) for i, t in enumerate(texts) if t for a, z in split.greedy_bounds(t, 16_000) if t[a:z].strip()]
    want = {f"t{k}": (sum(len(p) % 3 == k for _, p in parts), sum(i for i, p in parts if len(p) % 3 == k)) for k in range(3)}
    got = rows_of(registry.QUERIES["mdl_staged_job"](spark, str(tmp_path)))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names, said = sql_rows(duck, registry.ORACLE_SQL["mdl_staged_job"])
    row = [names.index(c) for c in ("stage", "name", "n", "total")]
    assert {r[row[1]]: (r[row[2]], r[row[3]]) for r in got if r[row[0]] == "facts"} == want
    assert got == said and len(parts) > 1.5 * len(texts)
