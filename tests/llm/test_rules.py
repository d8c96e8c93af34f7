"""Collocations, the rule ledger and the filter audit against brute force, with the edge cases of their docstrings."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from oracle import connect, rows_of, sql_rows
from pyspark.sql import functions as F

import corpus_pipeline
from docgraph.llm import collocations, interaction, language_id, mixing, quality, queries, sharding, tokens

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, failed string, n_words string, node string, part string"
LONG = "One two three four five, " * 9000 + "\n".join(f"w{i % 997} X{i % 13}!" for i in range(30_000))
TEXTS = [
    None, "", "   \n\t", "one", "one", "A b A b a b. a b; a b", LONG, "Ünï çødé 漢字 😀 text… with Big words\nline two\nline two\n• bullet\n-x\n\nend...",
    "a b c d e f a b c d e g", "x" * 2000, "a\x01b \x01 c\x00d " * 40, "# $ % & * | < > #word", "AAA BBB CCC", "12345 678 9", "a b\x0bc d\x0ce f\rg h", "the the the the",
]
EDGES = [(i if i != 3 else None, t, ["en", None, "de", "und"][i % 4], [None, "", "s", "s\x00", "t"][i % 5], None, "f", "n", "o", "p") for i, t in enumerate(TEXTS)]
EDGES += [EDGES[5], EDGES[5], (4, "another text of id 4", "en", "s", 1, None, None, None, None), (None, "one", "en", "t", 0, None, None, None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df)
    names, want = sql_rows(duck, queries.ORACLE_SQL[name])
    assert sorted(df.columns) == names and got == want and got


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# collocations


def mined(rows, least, most=5):
    """(lang, phrase): (a, l, r, n, score), by counting everything."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is not None else "und"] += len(w)
            for k in range(1, most + 1):
                f[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        held = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        for p, a in held.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in held.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (a, left, right, n[lang], score)
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_candidates(edges, least):
    small = edges.filter("text IS NULL OR length(text) < 5000")
    want = mined([(r[1], r[2]) for r in EDGES if r[1] is None or len(r[1]) < 5000], least)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.candidates(small, least).collect()}
    assert got == want and want


def test_ranges_merge(spark, monkeypatch):
    """Many shards, small blocks and many prefix ranges give what one trie gives."""
    monkeypatch.setattr(collocations, "RUNS", 2)
    monkeypatch.setattr(collocations, "bounds", lambda blocks: [b"en\tfive", b"en\tone two", b"en\tone two three four", b"en\ttwo", b"und\t", b"und\tx", "und\t\U0001f600".encode()])
    rows = [(LONG[: 200 * i], "en" if i % 3 else None) for i in range(60)]
    want = mined(rows, 100)
    parts = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in collocations.candidates(parts, 100).collect()}
    assert got == want and any(len(p.split()) == 5 for _, p in want)


def test_bounds(spark, monkeypatch):
    blocks = spark.createDataFrame([(f"en\t{i:03d}", 100, b"") for i in range(200)], "first string, nodes long, block binary")
    assert collocations.bounds(blocks) == [] and collocations.bounds(blocks.limit(0)) == []
    monkeypatch.setattr(collocations, "RANGE", 1000)
    cuts = collocations.bounds(blocks)
    assert cuts == [f"en\t{i:03d}".encode() for i in range(10, 200, 10)]
    monkeypatch.setattr(collocations, "SAMPLE_BLOCKS", 40)
    some = collocations.bounds(blocks)
    assert some == sorted(set(some)) and 5 < len(some) <= 19


def test_trie_in_order():
    trie = collocations.Trie(3)
    batch = pa.RecordBatch.from_arrays([pa.array(["a b a b c", None, "B, a"]), pa.array(["x", "x", None])], ["text", "lang"])
    w = collocations.Words(batch)
    trie.add(w, w.hash == w.hash, w.next)
    got = dict(zip(*[c.to_pylist() for c in trie.rows().columns], strict=True))
    assert got == {"x\t": 5, "x\ta": 2, "x\tb": 2, "x\tc": 1, "x\ta b": 2, "x\tb a": 1, "x\tb c": 1, "x\ta b a": 1, "x\tb a b": 1, "x\ta b c": 1, "und\t": 2, "und\ta": 1, "und\tb": 1}
    assert list(got) == sorted(got, key=str.encode) and trie.rows().num_rows == 0


def test_ranks(edges):
    rows = collocations.mine(edges, top=5, least=2).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.lang].append(r)
    want = mined([(r[1], r[2]) for r in EDGES], 2)
    for lang, own in by.items():
        own.sort(key=lambda r: r["rank"])
        best = sorted(((-v[4], -v[0], k[1].encode()) for k, v in want.items() if k[0] == lang))[:5]
        assert [(-r.score, -r.a, r.phrase.encode()) for r in own] == best and [r["rank"] for r in own] == list(range(1, len(own) + 1))


def test_large_numbers(spark):
    """Products beyond 64 bits are exact."""
    df = spark.sql("SELECT CAST(1000 AS DECIMAL(4,0)) * CAST(3000000007L AS DECIMAL(19,0)) * CAST(900000000000007L AS DECIMAL(15,0)) AS x, CAST(3000000011L AS DECIMAL(19,0)) * CAST(4000000013L AS DECIMAL(18,0)) AS y")
    assert df.selectExpr("x div y AS q").head().q == 1000 * 3000000007 * 900000000000007 // (3000000011 * 4000000013)


def test_no_collocations(nothing, spark):
    assert collocations.mine(nothing).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string")).count() == 0


# rule ledger


def measures(text):
    t = text or ""
    w = words(t)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {r for r, c in Counter(runs).items() if c > 1}
    lines = [x for x in t.split("\n") if words(x)]
    return dict(
        n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", t)), n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=len({i + k for i, r in enumerate(runs) if r in many for k in range(5)}), n_chars=len(t), n_lines=len(lines), n_upper=len(re.findall("[A-Z]", t)),
        n_digits=len(re.findall("[0-9]", t)), n_letter_words=sum(bool(re.search("[A-Za-z\x80-\U0010ffff]", x)) for x in w), n_bullet_lines=sum(words(x)[0][0] in "-*•" for x in lines),
        n_open_lines=sum(words(x)[-1].endswith(("...", "…")) for x in lines), longest_word=max(map(len, w), default=0), n_stutters=sum(a == b for a, b in zip(w, w[1:], strict=False)),
    )


def failed(m):
    return sum(1 << r.bit for r in quality.RULES if eval(r.fails.replace(" AND ", " and "), {}, m))


def test_ledger(edges):
    got = Counter((r.doc_id, tuple(r[m] for m in quality.MEASURES), r.failed) for r in quality.ledger(edges).collect())
    want = Counter()
    for r in EDGES:
        m = measures(r[1])
        want[r[0], tuple(m[x] for x in quality.MEASURES), failed(m)] += 1
    assert got == want


@pytest.mark.parametrize("policy", quality.POLICIES.values(), ids=str)
def test_policies(edges, nothing, policy):
    kept = quality.filtered(edges, policy)
    bits = [failed(measures(r[1])) for r in EDGES]
    assert Counter(map(tuple, kept.collect())) == Counter(r for r, b in zip(EDGES, bits, strict=True) if not b & policy.mask) and kept.columns == edges.columns
    rows = {r.rule: r for r in quality.ablation(quality.ledger(edges), policy).collect()}
    by = {r.name: 1 << r.bit for r in quality.RULES}
    assert set(rows) == set(policy.rules)
    for name, r in rows.items():
        own = [b & policy.mask for b in bits]
        assert (r.rows, r.kept, r.fails, r.sole) == (len(own), own.count(0), sum(bool(b & by[name]) for b in own), own.count(by[name]))
        assert (r.kept_without, r.kept_alone) == (sum(not b & ~by[name] for b in own), sum(not b & by[name] for b in own)) and r.policy == policy.label
    assert quality.ledger(nothing).count() == quality.filtered(nothing, policy).count() == quality.ablation(quality.ledger(nothing), policy).count() == 0


def test_bits_are_for_good():
    assert len({r.bit for r in quality.RULES}) == len(quality.RULES) and all(set(quality.BASE) <= set(p.rules) for p in quality.POLICIES.values())


# filter audit


def audited(rows, labels):
    """The report by going through every order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    marked = []
    for i, t, source in rows:
        w, text = words(t), t or ""
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and first[text] < i,
        }
        own = [x for x in labels if x[0] == i and i is not None]
        marked.append((source or "", {f for f, x in fails.items() if x}, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out, total = {}, Counter()
    for part in {m[0] for m in marked}:
        for order in permutations("ABCDE"):
            left = [m for m in marked if m[0] == part]
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                own = [m[1] for m in marked if m[0] == part and f in m[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(own) - len(gone), own.count({f}), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                total[part, f] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, edges, nothing):
    labels = [(1, 1, 0), (1, 1, 0), (1, 0, None), (4, 0, 1), (5, 1, 1), (6, None, None), (None, 1, 1), (99, 1, 1)]
    known = spark.createDataFrame([(*x, "z", 7) for x in labels], "doc_id long, quality int, toxic int, part string, failed int")
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in interaction.NUMBERS) for r in interaction.audit(interaction.marks(edges, known)).collect()}
    assert got == audited([(r[0], r[1], r[3]) for r in EDGES], labels) and {k[0] for k in got} == {"", "s", "s\x00", "t"}
    assert interaction.audit(interaction.marks(nothing, known)).count() == 0
    alone = interaction.audit(interaction.marks(edges, known.limit(0)))
    assert alone.agg(F.sum("good_lost") + F.sum("toxic_lost")).head()[0] == 0 and alone.count() == 600 * 4


def test_audit_of_many_parts_and_tasks(spark):
    rows = [(i, "w " * (i % 300) + "#" * (i % 2), f"p{i % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(13)
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "CAST(toxic AS INT) AS toxic")
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in interaction.NUMBERS) for r in interaction.audit(interaction.marks(docs, labels)).collect()}
    assert got == audited(rows, [(i, i % 2, int(i % 3 == 0)) for i in range(0, 400, 2)])


def test_first_failures():
    table = interaction.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    assert table[0b10000, interaction.ORDERS.index((4, 0, 1, 2, 3))] == 0 and table[0b10000, interaction.ORDERS.index((0, 1, 2, 3, 4))] == 4


# older operators: what had no test against brute force


def test_convolution_by_hand():
    """The tables of byte pairs give what the filters give at each place."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (9, language_id.WINDOW)).astype(np.uint8)
    rows[4:, 200:] = 0
    rows[0] = 0
    model = language_id.train(rows, np.arange(9) % 3, ["a", "b", "c"])
    pooled = model.pooled(rows)
    for r, row in enumerate(rows):
        want = []
        for width, filters in zip(language_id.WIDTHS, model.filters, strict=True):
            at = [sum(filters[k, row[p + k]] for k in range(width)) for p in range(language_id.WINDOW - width + 1)]
            want.append(np.max(at, axis=0))
        assert np.allclose(pooled[r], np.maximum(np.concatenate(want) + model.bias, 0), atol=1e-4)
        z = np.exp(pooled[r] @ model.out + model.out_bias)
        assert np.allclose(model.probabilities(rows)[r], z / z.sum(), atol=1e-4)


def test_sharding_keeps_clashing_columns(spark, edges, nothing):
    names = ("_bucket", "_rn", "_at", "_before", "_cell", "_n", "__bucket")
    clash = spark.createDataFrame([(*r, *names) for r in EDGES], ", ".join([SCHEMA, *(f"{c} string" for c in names)]))
    got = sharding.assign(sharding.sized(clash), 4)
    assert sorted(got.columns) == sorted([*clash.columns, "size", "text_crc32", "shard", "slot"])
    rows = got.collect()
    assert len(rows) == len(EDGES) and all(r[c] == c for r in rows for c in names)
    plain = sharding.assign(sharding.sized(edges), 4).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in rows) == Counter((r.doc_id, r.text, r.shard) for r in plain)
    assert sharding.assign(sharding.sized(nothing.withColumn("_bucket", F.lit(1))), 4).count() == 0


def ids_of(text):
    return tokens.encoder(tokens.vocabulary_path()).library.encode(text or "", add_special_tokens=False).ids + [2]


def five_word_sets(text):
    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_pipeline_run(spark, tmp_path):
    """run() against the stages by hand: languages by the model's own scores, groups by comparing all pairs, copies by the plan, pieces by joining them again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_001, "12345 678 !!", "en", "s", 1), (10_002, None, "en", None, None), (10_003, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)) if set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"} else docs
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.fit(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    kept = sorted(i for i, (lang, score) in found.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE)
    assert not {10_001, 10_002, 10_003} & set(kept)
    sets, gone = {i: five_word_sets(rows[i].text) for i in kept}, set()
    up = {i: i for i in kept}
    for n, i in enumerate(kept):
        for j in kept[:n]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if c == b else c for k, c in up.items()}
    gone = {i for i in kept if up[i] != i}
    left = docs.filter(F.col("doc_id").isin([i for i in kept if i not in gone]))
    copies = {r.doc_id: r.copies for r in mixing.planned(left).collect()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {i for i, n in copies.items() if n}
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert total == Counter({i: n * len(ids_of(rows[i].text)) for i, n in copies.items() if n})
    crc = {}
    for r in pieces:
        own = ids_of(rows[r.doc_id].text)[r.start : r.start + r.length]
        assert crc.setdefault((r.doc_id, r.start, r.length), r.ids_crc32) == r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids_of(rows[r.doc_id].text))
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 4096


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "", None, "s", 0), (1, "", None, "s", 0)]], ids=["empty", "nulls", "blank"])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).count()
