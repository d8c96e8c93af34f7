"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracle import connect, rows_of, sql_rows

from docgraph.plans import registry

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df)
    if name not in registry.ORACLE_SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    names, want = sql_rows(duck, registry.ORACLE_SQL[name])
    assert sorted(df.columns) == names
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == pytest.approx(b, rel=1e-6)) for a, b in zip(x, y, strict=True))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_greedy_split_covers_each_text(spark, docs):
    parts: dict = {}
    for r in registry.QUERIES["spl_greedy_split"](spark, SF).collect():
        parts.setdefault(r.doc_id, []).append(r)
    assert set(parts) == {i for i, d in docs.items() if d.text.strip()}
    for i, rows in parts.items():
        rows.sort(key=lambda r: r.part)
        assert [r.part for r in rows] == list(range(rows[0].n_parts)) and all(a.origin_char + a.n <= b.origin_char for a, b in zip(rows, rows[1:], strict=False))
        kept = sum(len("".join(docs[i].text[r.origin_char : r.origin_char + r.n].split())) for r in rows)
        assert kept == len("".join(docs[i].text.split()))


def test_halves_are_near_the_middle(spark, docs):
    for r in registry.QUERIES["mdl_halves"](spark, SF).collect():
        n = len(docs[r.doc_id].text)
        assert r.first_half == 0 if n < 200 else abs(r.first_half - n // 2) <= max(40, n // 10) + 2


def test_slices_are_the_fewest_that_fit(spark, docs):
    sizes: dict = {}
    for d in docs.values():
        sizes.setdefault(d.source, []).append((d.doc_id, max(1, len(d.text) // 3) if d.text else 0))
    got: dict = {}
    for r in registry.QUERIES["ent_heavy_slices"](spark, SF).collect():
        got.setdefault(r.source, {})[r.doc_id] = (r.slice, r.slices)
    for source, rows in sizes.items():
        rows.sort()

        def worst(k, rows=rows):
            step = -(-len(rows) // min(k, len(rows)))
            return max(sum(t for _, t in rows[a : a + step]) for a in range(0, len(rows), step))

        want = next((2**i for i in range(8) if worst(2**i) <= 5000), 128)
        step = -(-len(rows) // min(want, len(rows)))
        assert got[source] == {i: (at // step, want) for at, (i, _) in enumerate(rows)}


def test_spans_and_payloads(spark, docs):
    for r in registry.QUERIES["fact_spans"](spark, SF).collect():
        text = docs[r.doc_id].text
        quote = text[10:70]
        at = text.find(quote) if quote.strip() else -1
        assert (r.start_char, r.end_char) == ((at, at + len(quote)) if at >= 0 else (None, None)) or text[r.start_char : r.end_char].split() == quote.split()
    assert {r.status for r in registry.QUERIES["fact_salvaged_json"](spark, SF).collect()} <= {"ok", "salvaged", "parse_error"}
    ladder = registry.QUERIES["mdl_retry_ladder"](spark, SF).collect()
    assert {r.root_id for r in ladder} == {str(i) for i in docs} and {r.status for r in ladder} <= {"OK", "CAP_HIT"}


def test_sample_fits(spark, docs):
    chosen: dict = {}
    for r in registry.QUERIES["syn_sample_to_fit"](spark, SF).collect():
        chosen.setdefault(r.topic, []).append(r.idx)
    for topic, ids in chosen.items():
        own = sorted(i for i, d in docs.items() if d.source == topic)
        assert max(ids) == own[-1] and len(set(ids)) == len(ids) and (len(ids) <= 2 or sum(len(docs[i].text) for i in ids) // 3 <= 20_000)
