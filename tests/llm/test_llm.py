"""The training-data operators against brute force, exact round trips and held-out labels, with the edge cases of their docstrings."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from docgraph.llm import common, components, fingerprints, html_extraction, language_id, licenses, media, mixing, ngram_join, packing, queries, sharding, token_files, tokens, words

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997} x{i % 13}" for i in range(30_000))
EDGES = [
    (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "   \n\t", None, "a", 5), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
    (6, LONG, "en", "a", len(LONG)), (7, "Ünï çødé 漢字 😀 text with more than five words", "de", "b", 0), (None, "no id at all here", "fr", "a", 0),
    (8, "a\x01b \x01 <|endoftext|> don't 12", "en", "ä", 0), (9, "123 456 !!", "en", "a", 0),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def found_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingles(text: str, n: int) -> set:
    w = found_words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


# words


def test_word_hashes_are_those_of_words(docs):
    texts = [t for _, t in docs[:60]] + [t for _, t, *_ in EDGES] + ["a b", "b a", "x" * (words.SLICE + 70_000) + " y"]
    hashes, offs = words.word_hashes(*words.text_bytes(pa.array(texts)))
    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        own = found_words(t)
        assert len(own) == offs[i + 1] - offs[i]
        for w, h in zip(own, hashes[offs[i] : offs[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1, 4, 5])
def test_shingle_sets(docs, n):
    texts = [t for _, t in docs[:80]] + [t for _, t, *_ in EDGES] + ["the and and the x", "and the the and x"]
    hashes, offs = words.shingle_hashes(*words.word_hashes(*words.text_bytes(pa.array(texts))), n)
    seen: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        own = set(hashes[offs[i] : offs[i + 1]].tolist())
        assert len(own) == len(shingles(t, n))
        w = found_words(t)
        if len(w) >= n:
            for k, h in enumerate(hashes[offs[i] : offs[i + 1]].tolist()):
                assert seen.setdefault(tuple(w[k : k + n]), h) == h
    assert len(set(seen.values())) == len(seen)


# 1


def test_language_id_held_out(spark):
    rows = queries.op1_language_id(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark, edges, nothing):
    model = language_id.fit(edges)
    clash = language_id.identify(edges.withColumns({"score": F.lit("clash"), "_letter": F.lit("kept")}), model)
    rows = clash.collect()
    assert {r._letter for r in rows} == {"kept"} and clash.columns == [*edges.columns, "_letter", "lang_pred", "score"]
    assert len(rows) == len(EDGES) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert language_id.fit(nothing) is None and language_id.identify(nothing, None).count() == 0
    assert {r.lang_pred for r in language_id.identify(edges, None).collect()} == {"und"}


# 2


def brute_capacity(sizes: list[int], shards: int) -> int:
    def needed(cap: int) -> int:
        used, held = 1, 0
        for s in sizes:
            used, held = (used + 1, s) if held + s > cap else (used, held + s)
        return used

    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)


@pytest.mark.parametrize(("sizes", "shards"), [([3, 1, 4, 1, 5, 9, 2, 6], 3), ([10], 4), ([1] * 20, 16), ([100, 1, 1, 1], 2)])
def test_capacity(spark, sizes, shards):
    col = F.array(*[F.lit(s).cast("long") for s in sizes])
    assert spark.range(1).select(sharding.capacity(col, shards).alias("c")).head().c == brute_capacity(sizes, shards)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_cuts_within_capacity(spark, shards):
    rng = np.random.default_rng(shards)
    for big in (0, 5000):
        sizes = rng.integers(1, 60, 300).tolist()
        sizes[40] += big
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], f"{sharding.BUCKET} int, size long")
        got = sharding.cuts(rows, shards).head()
        parts = np.split(np.array(sizes), got["at"])
        loads = [int(p.sum()) for p in parts]
        assert got.cap == brute_capacity(sizes, shards) and len(parts) <= shards and max(loads) <= got.cap and min(map(len, parts)) > 0
        if not big:
            assert min(loads) > 0.8 * sum(sizes) / shards
    dominant = sharding.assign(sharding.sized(spark.createDataFrame([(i, "same " * 50) for i in range(500)] + [(1000 + i, f"t{i}") for i in range(500)], "doc_id long, text string")), 16)
    of = defaultdict(set)
    for r in dominant.collect():
        of[r.text].add(r.shard)
    assert all(len(x) == 1 for x in of.values())


def test_sharding(spark, edges, nothing, docs):
    rows = queries.op2_sharding(spark, SF).collect()
    by_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    texts = dict(docs)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        by_text[texts[r.doc_id]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert len(rows) == len(docs) and all(len(s) == 1 for s in by_text.values()) and set(slots) <= set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grouped = defaultdict(int)
    for r in sharding.sized(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        grouped[r._bucket] += r["size"]
    assert max(load.values()) == brute_capacity([grouped[k] for k in sorted(grouped)], 16)
    got = sharding.assign(sharding.sized(edges), 16).collect()
    assert len(got) == len(EDGES) and sharding.assign(sharding.sized(nothing), 16).count() == 0


# 3


def test_mixing_targets(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        sizes = {s: int(n) for s, n in zip("abcdefg", rng.integers(0, 500, 7), strict=True)}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()] + [(None, 40)], "source string, size long")
        names = [*sorted(sizes), None]
        size = {**sizes, None: 40}
        weight = {n: mixing.WEIGHTS[i % 3] for i, n in enumerate(names)}
        total, full = 1.5 * sum(size.values()), set()
        while True:
            rest = total - sum(2 * size[n] for n in full)
            share = {n: rest * weight[n] / sum(weight[m] for m in names if m not in full) for n in names if n not in full}
            over = {n for n, t in share.items() if t > 2 * size[n]}
            if not over:
                break
            full |= over
        for r in mixing.targets(df).collect():
            assert r.target == pytest.approx(2 * size[r.source] if r.source in full else share[r.source])


def test_mixing(spark, edges, nothing):
    rows = mixing.planned(edges).collect()
    assert len(rows) == len(EDGES) and sorted(map(str, rows)) == sorted(map(str, mixing.planned(edges).collect()))
    words_of = Counter((i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _, s, _ in EDGES)
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == words_of and all(0 <= r.copies <= 2 for r in rows)
    mixed = Counter(r.doc_id for r in mixing.mix(edges).collect())
    assert mixed == Counter(r.doc_id for r in rows for _ in range(r.copies))
    clash = edges.withColumns({c: F.lit(c) for c in ("size", "target", "rate", "copies", "source_size", "_draw", "_n", "_row", "_source", "a.b")})
    got = mixing.mix(clash)
    assert got.columns == clash.columns and all(r["size"] == "size" and r["_draw"] == "_draw" and r["a.b"] == "a.b" for r in got.collect())
    assert mixing.mix(nothing).count() == 0 and mixing.mix(edges).columns == edges.columns and mixing.planned(nothing).count() == 0


def test_mixing_query_comes_near_its_targets(spark):
    rows = queries.op3_mixing(spark, f"{DATA}/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        d = docs[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        size[d.source] += r["size"]
        taken[d.source] += r.taken
        target[d.source] = r.target
    assert len(rows) == len(docs) and sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - t) <= 0.02 * t + 400 and t <= 2 * size[s] + 1e-6 for s, t in target.items())


# 4

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div id="cookie-notice">cookies</div>
<div class="sidebar"><p>side</p></div><article><header><h1>Head %d &amp; more</h1></header><p>First&nbsp;text   with <b>bold</b> <span class="ad">AD</span>words<br><p>Second %d<ul><li>one<li>two</ul>
<form><p>ask</p></form><script>var t="</p>";</script></article><section id="comments"><article class="comment"><p>reader</p></article></section><footer>&copy; x</footer></body></html>"""


def test_html_wrappers():
    wrapper = html_extraction.infer([PAGE % (i, i) for i in range(4)])
    want = "Head 9 & more\nFirst text with bold words\nSecond 9\none\ntwo"
    assert html_extraction.extract(PAGE % (9, 9), wrapper) == want and html_extraction.extract(PAGE % (9, 9), []) == want
    assert html_extraction.extract(None, wrapper) == "" and html_extraction.extract("", wrapper) == "" and html_extraction.extract("<p", wrapper) != "<p>"
    lists = ["<body><article>" + "<h2>a</h2><p>b</p>" * n + ("<table><tr><td>c</td></tr></table>" if n % 2 else "") + "</article></body>" for n in (1, 2, 3)]
    kids = html_extraction.infer(lists)[3][0][3][0][3]
    assert [k[0] for k in kids] == ["h2", "p", "table"] and kids[0][2] & 2 and kids[2][2] & 1


ARTICLE = """<body><article><h1>Head {0}</h1><div class="zq">Read our app.</div><p>Long first text of article {0}, {0}.<p>Second text, {0}.
<ul class="zk"><li><a href=x>Other head {0}</a><li><a href=x>One more head {0}</a></ul>{1}<blockquote>Quoted {0}</blockquote></article></body>"""


def test_html_wrapper_decides_inside_an_article():
    pages = [ARTICLE.format(i, "<div class=zs>Get our letter.</div>" if i % 2 else "") for i in range(8)]
    wrapper = html_extraction.infer(pages)
    want = "Head {0}\nLong first text of article {0}, {0}.\nSecond text, {0}.\nQuoted {0}"
    assert [html_extraction.extract(p, wrapper) for p in pages] == [want.format(i) for i in range(8)]
    plain = html_extraction.extract(pages[1], [])
    assert all(x in plain for x in ("Read our app.", "Get our letter.", "One more head 1"))
    other = pages[1].replace("Read our app.", "A text of this page.")
    assert "A text of this page." in html_extraction.extract(other, wrapper)  # a slot goes only with the template's text
    copies = [pages[1].replace("Second text", f"Edited {i}") for i in range(8)]
    assert html_extraction.extract(copies[0], html_extraction.infer(copies)).startswith("Head 1\nRead our app.\nLong first")


def test_html_wrapper_of_all_pages(spark):
    page = "<body><div class=t><h1>{0}</h1></div><p>First {0}<p>Second {0}<div class=n>{1}</div></body>"
    made = [page.format("copied", "Own note")] * 60 + [page.format("copied", f"Own note {i}") for i in range(3)] + [page.format(f"head {i}", "Site text") for i in range(3)]
    made += [page.format(f"rare {i}", "Own note").replace("<p>", "<div class=r>Rare layout</div><p>", 1) for i in range(3)]
    rows = [(i, "http://a.b/x", p) for i, p in enumerate(made)] + [(100, "http://a.b/y", None), (101, "http://none.b/y", None)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = lambda head, note: f"{head}\nFirst {head}\nSecond {head}\n{note}"
    assert {got[i] for i in range(60)} == {want("copied", "Own note")} and [got[60 + i] for i in range(3)] == [want("copied", f"Own note {i}") for i in range(3)]
    assert [got[63 + i] for i in range(3)] == [want(f"head {i}", "Site text") for i in range(3)]
    assert [got[66 + i] for i in range(3)] == [want(f"rare {i}", "Own note") for i in range(3)] and got[100] == got[101] == ""
    long = ["<body>" + "".join(f"<div class={'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}>Item {k} {'' if k == 990 else i}</div>" for k in range(i, 1000)) + "</body>" for i in range(4)]
    assert "Item 990 \n" not in html_extraction.extract(long[1], html_extraction.infer(long)).replace("Item 990\n", "Item 990 \n")


LIKE = [
    "<body><ul class=q><li>Home page<li>World news<li>Sport today</ul><div class=z><h1>Head {0}</h1><p>First long text of article {0}.<p>Second text {0} is here.</div></body>",
    "<body><div class=z><h1>Head {0}</h1><p>First long text of article {0}.<p>Second text {0} is here.</div><div class=c3><p>All rights are ours.<p>Write to the editors.</div></body>",
    "<body><article><h1>Head {0}</h1><p>First long text of article {0}.<p>Second text {0} is here.<div class=c3><p>All rights are ours.<p>Write to the editors.</div></article></body>",
    "<body><article><h1>Head {0}</h1><p>First long text of article {0}.<p>Second text {0} is here.<p>Read our app.</article></body>",
]


@pytest.mark.parametrize("page", LIKE)
@pytest.mark.parametrize("parts", [1, 5])
def test_html_template_among_like_siblings(page, parts):
    """Lists, footers and notes of neutral names, whose members are folded into one group, go; what differs stays."""
    pages = [page.format(f"{i} " + "x" * (i % 3)) for i in range(12)]
    nodes = [None] * parts
    for i, p in enumerate(pages):
        nodes[i % parts] = html_extraction.with_page(nodes[i % parts], p)
    nodes = [html_extraction.unpacked(html_extraction.packed(n)) for n in nodes]
    top = nodes[0]
    for other in nodes[1:]:
        top = html_extraction.joined(top, other)
    wrapper = html_extraction.nested(html_extraction.plain_rows(top))
    want = "Head {0}\nFirst long text of article {0}.\nSecond text {0} is here."
    assert [html_extraction.extract(p, wrapper).replace(" \n", "\n").replace(" .", ".") for p in pages] == [want.format(f"{i} {'x' * (i % 3)}").replace(" \n", "\n").replace(" .", ".").replace("  ", " ") for i in range(12)]
    other = page.format("other").replace("Home page", "Own list of this page").replace("Write to the editors", "Own note of this page").replace("Read our app", "Own end of this page")
    assert "of this page" in html_extraction.extract(other, wrapper)
    copies = [pages[0]] * 12
    assert html_extraction.extract(copies[0], html_extraction.infer(copies)) == html_extraction.extract(copies[0], [])  # copies do not make a template


def test_html_long_groups_and_many_hosts(spark, monkeypatch):
    """A group of more texts than are remembered keeps what pages do not share; wrappers that no task may hold go beside the pages."""
    page = "<body><article><h1>Head {0}</h1>" + "".join(f"<p>Paragraph {{0}} {k} of its own." for k in range(150)) + "<p>Read our app.</article></body>"
    pages = [page.format(i) for i in range(8)]
    got = html_extraction.extract(pages[3], html_extraction.infer(pages)).split("\n")
    assert [x for x in got if x != "Read our app."] == ["Head 3"] + [f"Paragraph 3 {k} of its own." for k in range(150)]
    rows = [(i, f"http://h{i % 7}.org/{i}", LIKE[i % 7 % 4].format(i)) for i in range(140)] + [(900, None, LIKE[0].format(1)), (901, "http://h1.org/x", None), (None, "http://h1.org/y", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    held = sorted(map(str, html_extraction.extract_pages(df).collect()))
    monkeypatch.setattr(html_extraction, "HELD_BYTES", -1)
    monkeypatch.setattr(html_extraction, "CELL_PAGES", 6)
    assert sorted(map(str, html_extraction.extract_pages(df).collect())) == held and len(held) == 143
    assert html_extraction.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    '<body><div role="navigation"><p>No</p></div><div role="main"><p>Yes {0}</p></div></body>',
    "<body><article><p hidden>No</p><p>Yes {0}</p></article></body>",
    "<body><article><p>Yes {0}</p><p hidden>No</p><p style='display: none'>No</p></article></body>",
    '<body><article><div class="a b c sidebar">No</div><div class="a b c text">Yes {0}</div></article></body>',
    '<body><article><div class="a b c text">Yes {0}</div><div class="a b c sidebar">No</div></article></body>',
    '<body><article><p aria-label="share">No</p><p>Yes {0}</p></article></body>',
])
def test_html_own_role_counts(page):
    wrapper = html_extraction.infer([page.format(i) for i in range(4)])
    assert [html_extraction.extract(page.format(i), wrapper) for i in range(4)] == [f"Yes {i}" for i in range(4)]


def test_html_pages(spark):
    rows = spark.createDataFrame([(1, "http://a.b/x", PAGE % (1, 1)), (1, "http://a.b/x", PAGE % (1, 1)), (2, None, None), (3, "http://c.d", "")], "page_id long, url string, html string")
    got = html_extraction.extract_pages(rows).collect()
    assert len(got) == 4 and sum(r.text.startswith("Head 1 & more\n") for r in got) == 2 and html_extraction.extract_pages(rows.limit(0)).count() == 0


def test_html_of_any_depth_and_width():
    deep = "<body><article>" + "<div>" * 5000 + "deep {0}" + "</div>" * 5000 + "<p>end {0}</p></article></body>"
    wide = "<body><article>" + "".join(f"<div class={'qrstuvwxyz'[k % 10]}{'qrstuvwxyz'[k // 10 % 10]}>Part {k} {{0}}</div>" for k in range(1500)) + "</article></body>"
    for page in (deep, wide):
        wrapper = html_extraction.infer([page.format(i) for i in range(4)])
        want = "deep 3\nend 3" if page is deep else "\n".join(f"Part {k} 3" for k in range(1500))
        assert html_extraction.extract(page.format(3), wrapper) == want
    node = html_extraction.with_page(None, deep)
    assert html_extraction.packed(html_extraction.unpacked(html_extraction.packed(node))) == html_extraction.packed(node)


def test_html_alignment(monkeypatch):
    rng = np.random.default_rng(4)
    for table in (1 << 28, 0):
        monkeypatch.setattr(html_extraction, "TABLE", table)
        for _ in range(60):
            a, b = (list("abcd"[k] for k in rng.integers(0, 4, rng.integers(0, 9))) for _ in "xy")
            pairs = html_extraction.common(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(x < y and v < w for (x, v), (y, w) in zip(pairs, pairs[1:], strict=False))
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            assert len(pairs) <= best[-1][-1] and (not table or len(pairs) == best[-1][-1])


class Article(HTMLParser):
    """Blocks of the <article> of the given pages, by another parser: no wrappers, and only the names that these pages use."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.out, self.within = [], "", 0, 0

    def handle_starttag(self, tag, attrs):
        named = dict(attrs).get("class") or dict(attrs).get("id") or ""
        if self.out or tag in ("nav", "footer", "aside", "form", "script", "style") or re.search(r"\b(ad|comments?|cookie|share|related|newsletter|sidebar|promo)\b", named):
            self.out += tag not in ("br", "img", "input", "p", "li")
        elif tag == "article":
            self.within += 1
        if tag not in html_extraction.INLINE:
            self.cut()

    def handle_endtag(self, tag):
        if tag not in html_extraction.INLINE:
            self.cut()
        if self.out:
            self.out -= tag not in ("p", "li")
        elif tag == "article":
            self.within -= 1

    def handle_data(self, data):
        self.text += data if self.within and not self.out else ""

    def cut(self):
        self.blocks += [" ".join(self.text.split())] if self.text.strip() else []
        self.text = ""


def test_html_query(spark):
    rows = {r.page_id: r for r in queries.op4_html_extraction(spark, f"{DATA}/sf0.01").collect()}
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        parser = Article()
        parser.feed(p.html)
        parser.cut()
        assert rows[p.page_id].text == "\n".join(parser.blocks) and rows[p.page_id].n_chars == len(rows[p.page_id].text) and rows[p.page_id].url == p.url


# 5


def test_fingerprint_likeness(spark, docs):
    rows = {r.doc_id: r for r in queries.op5_fingerprints(spark, SF).collect()}
    order = sorted(docs, reverse=True)
    errors = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        changed = t[: len(t) - h] + after[:h]
        a, b, c = shingles(t, 5), shingles(changed, 5), shingles(after, 5)
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        errors += [abs(r.near_edited - len(a & b) / max(1, len(a | b))), abs(r.near_next - len(a & c) / max(1, len(a | c)))]
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    same = defaultdict(set)
    for i, t in docs:
        same[t].add(rows[i].fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_next_documents(spark):
    made = [(i * 7 % 101, f"text {i} " * (i % 5)) for i in range(101)] + [(None, "a"), (None, "b")]
    order = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for buckets in ("1", "4", "200"):  # also with less than a row a bucket
        spark.conf.set("spark.sql.shuffle.partitions", buckets)
        try:
            got = {(r.doc_id, r.text): r.next_text for r in fingerprints.with_next(spark.createDataFrame(made, "doc_id long, text string")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(made) and all(got[r] == order[k + 1][1] for k, r in enumerate(order[:100]))
        assert {got[None, "a"], got[None, "b"], got[order[100]]} == {"a", "b", order[0][1]}


def test_fingerprint_edges(spark, edges, nothing):
    rows = fingerprints.compare(fingerprints.edited(fingerprints.with_next(edges))).collect()
    assert len(rows) == len(EDGES) and {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert fingerprints.compare(fingerprints.edited(fingerprints.with_next(nothing))).count() == 0
    mixed = {r.doc_id: r for r in fingerprints.compare(fingerprints.edited(fingerprints.with_next(edges).repartition(7, "text"))).collect()}
    assert all((mixed[r.doc_id].near_next, mixed[r.doc_id].edited) == (r.near_next, r.edited) for r in rows if r.doc_id != 5)  # in any order of rows
    one = fingerprints.compare(fingerprints.edited(fingerprints.with_next(edges.filter("doc_id = 4")))).head()
    assert one.near_next == 1.0 and one.edited == "onn"[:2] + "o"


# 6 and 8: token ids


@pytest.mark.parametrize("n", [0, 1, 5, 4096, 9000, 70_000])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) * 7, 49_407).astype(np.uint32)
    ids[: n // 2] = np.resize(ids[:50] if n else ids, n // 2)
    if n > 9000:
        ids[n // 2 :] = rng.integers(0, 1 << 32, n - n // 2, dtype=np.uint32)  # a large alphabet
    data = token_files.write([7, None, -(1 << 63)], np.array([n // 3, n - n // 3, 0]), ids)
    docs, counts, back = token_files.read(data)
    assert docs == [7, None, -(1 << 63)] and counts.sum() == n and np.array_equal(back, ids)
    if 100 < n < 10_000:
        assert len(data) < 3 * n


def test_token_file_damage_is_found():
    ids = np.random.default_rng(3).integers(0, 300, 1500).astype(np.uint32)
    data = token_files.write([7, 9], np.array([2, 1498]), ids)
    found = 0
    for at in range(0, len(data), 5):
        broken = bytearray(data)
        broken[at] ^= 255
        try:
            assert np.array_equal(token_files.read(bytes(broken))[2], ids)  # the last bits of a block say nothing
        except token_files.Damaged:
            found += 1
    assert found >= 0.98 * len(range(0, len(data), 5))
    for n in (0, 3, 33, 40, 700, len(data) - 1):
        with pytest.raises(token_files.Damaged):
            token_files.read(data[:n])


def test_encoder_equals_library(docs):
    e = tokens.Encoder(tokens.vocabulary_path())
    texts = [t for _, t in docs[:100]] + [t for _, t, *_ in EDGES] + ["İ ΑΣ ſ ǆ À. É, x.. y,. z'", "tab\tsep\r\nnbsp x"]
    ids, offs = e.encode(texts)
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == e.library.encode(t or "", add_special_tokens=False).ids
    e.seen[: len(e.known)] += 1
    e._trim()
    again, _ = e.encode(texts)
    assert np.array_equal(ids, again)


def test_letters_are_encoded_once():
    e = tokens.Encoder(tokens.vocabulary_path(), letters=3)
    e.letters, e.older, asked, model = {}, {}, [], e.tokenize
    e.tokenize = lambda text: asked.append(text) or model(text)
    texts = ["Zqor zqor, ZQOR!! zqor.", "zqor; \u00fcrgel \u00dcrgel, qbx qcx qdx qex zqor?"]
    ids, offs = e.encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(offs, offs[1:])] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) == 6 and max(len(e.letters), len(e.older)) <= 3


def expected_ids(text: str | None) -> list[int]:
    return tokens.encoder(tokens.vocabulary_path()).library.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, edges, nothing, docs):
    at = 0
    rows = {r.doc_id: r for r in queries.op6_token_files(spark, SF).collect()}
    for i, t in sorted(docs):
        ids = expected_ids(t)
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    got = token_files.read_files(common.stored(token_files.write_files(edges, file_ids=1000), "t")).collect()
    want = Counter((i, tuple(expected_ids(t))) for i, t, *_ in EDGES)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert token_files.read_files(common.stored(token_files.write_files(nothing), "t")).count() == 0


@pytest.mark.parametrize("lengths", [[], [1], [4096], [5000, 3, 3, 3], [3000] * 7, [10] * 1000, [4095, 1, 2048, 2047, 1]])
def test_window_sequences(lengths):
    out = list(packing.window_sequences(lengths))
    ids = sorted((d, s + k) for seq in out for d, s, n in seq for k in range(n))
    assert ids == [(d, k) for d, n in enumerate(lengths) for k in range(n)]
    sizes = [sum(n for _, _, n in seq) for seq in out]
    assert all(s == 4096 or s & (s - 1) == 0 for s in sizes) and sum(s < 4096 for s in sizes) <= 12


def test_fill_is_closest():
    rng = np.random.default_rng(5)
    for _ in range(30):
        cap = int(rng.integers(5, 40))
        counts = np.zeros(64, np.int64)
        for n in rng.integers(1, 30, 6):
            counts[n] += rng.integers(1, 4)
        reach = {0}
        for n in np.flatnonzero(counts):
            for _ in range(counts[n]):
                reach |= {r + int(n) for r in reach}
        chosen = packing.fill(counts, cap)
        assert all(k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == max(r for r in reach if r <= cap)


def test_packing(spark, edges, nothing, docs):
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in queries.op8_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert len(pieces) == len(docs)
    for i, t in docs:
        ids, at = expected_ids(t), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        assert sorted(r.offset for r in s) == list(np.cumsum([0] + [r.length for r in sorted(s, key=lambda r: r.offset)])[:-1])
    got = packing.pack(edges).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: sum(len(expected_ids(t)) for j, t, *_ in EDGES if j == i) for i, *_ in EDGES}
    assert packing.pack(nothing).count() == 0


# 7


def brute_components(rows: list[tuple]) -> dict:
    sets = {i: shingles(t, 4) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    inverse = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverse[x].append(i)
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in inverse[x] if j < i).items():
            if 100 * k >= 85 * (len(s) + len(sets[j]) - k):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [4, 512])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FANOUT", min(32, block // 2))
    monkeypatch.setattr(ngram_join, "LEAST_SEEN", 6)
    rng = np.random.default_rng(block)
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "x"), (3, "X"), (4, "a b c"), (5, "A b C")]
    for family in range(6):
        base = [f"w{v}" for v in rng.integers(0, 400, 90 + 40 * family)]
        for _ in range(12):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, 6))):
                text[at] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(text)))
    for _ in range(30):
        rows.append((len(rows), " ".join(passage + [f"u{v}" for v in rng.integers(0, 10_000, 50)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute_components(rows)


def test_ngram_join_edges(spark, edges, nothing):
    rows = ngram_join.join(edges).collect()
    assert len(rows) == len(EDGES) and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4} and {r.n_shingles for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert ngram_join.join(nothing).count() == 0


def test_count_tree_finds_all():
    rng = np.random.default_rng(1)
    points = rng.poisson(4, (300, 16)).astype(np.int64)
    points[:40] = np.maximum(0, points[0] + rng.integers(-1, 2, (40, 16)))
    tree = ngram_join.CountTree(points)
    sizes = points.sum(1)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(1)
        assert set(tree.search(points[i]).tolist()) == set(np.flatnonzero(185 * bound >= 85 * (sizes + sizes[i])).tolist())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (80, 85)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[90] == got[85] == 80


# 9


def test_media(spark, edges, nothing, docs):
    rows = {r.doc_id: r for r in queries.op9_media(spark, SF).collect()}
    for i, t in docs:
        p = t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        x = list(p)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:], strict=False))
        assert r.feature == f"sum={sum(x)};sq={sum(v * v for v in x)};zc={crossings};min={min(x)};max={max(x)};step={sum(abs(a - b) for a, b in zip(x, x[1:], strict=False))}"
        assert r.media_sha256 == hashlib.sha256(media.wav(p)).hexdigest() and r.media_bytes == len(p) + media.HEADER
    got = media.restore(*media.store(edges)).collect()
    assert Counter((r.doc_id, media.samples(bytes(r.media)).rstrip(b"\0")) for r in got) == Counter((i, (t or "").encode()) for i, t, *_ in EDGES)
    assert media.restore(*media.store(nothing)).count() == 0


def test_media_shared_by_many(spark):
    rows = [(i, LONG[:3000] + (f" tail {i}" if i % 3 else "")) for i in range(600)]
    got = media.restore(*media.store(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert Counter((r.doc_id, media.samples(bytes(r.media)).rstrip(b"\0").decode()) for r in got) == Counter(rows)


def test_media_unique_chunks_stay(spark, monkeypatch):
    monkeypatch.setattr(media, "LEAST_BITS", 1 << 15)  # else few texts leave nearly all bits unset
    shared = [(i, f"shared {i % 2000} " + LONG[:40]) for i in range(4000)]
    unique = [(i, f"unique {i} " + LONG[:40]) for i in range(4000, 8000)]
    files, pieces = media.store(spark.createDataFrame(shared + unique, "doc_id long, text string"))
    assert pieces.count() == 2000  # one bitmap alone took one in sixteen of the unique ones for shared
    assert {r.doc_id for r in files.selectExpr("doc_id", "recipe[0].here AS here").collect() if r.here} == {i for i, _ in unique}


def test_chunks_follow_content(spark):
    rng = np.random.default_rng(2)
    body = rng.bytes(60_000)
    a, b = media.chunks(b"x" * 700 + body), media.chunks(body)
    assert b"".join(p for _, p in a) == b"x" * 700 + body and all(media.LEAST <= len(p) <= media.MOST for _, p in a[:-1])
    assert len({d for d, _ in a} & {d for d, _ in b}) > 0.8 * len(b)
    digest = hashlib.sha256(b"q").digest()
    text = LONG[:5000]
    bitmap = media.shared_bitmap(spark.createDataFrame([(text,), (text,), ("single",)], "text string"))
    bits = {media._bit(d, 8 * len(bitmap)) for d, _ in media.chunks(media.wav(media.payload_of(text.encode())))}
    assert all(bitmap[x >> 3] >> (x & 7) & 1 for x in bits) and sum(map(int.bit_count, bitmap)) == len(bits) and len(digest) == 32


# 10


def test_every_known_licence_is_found(spark):
    known = licenses.known_texts()
    rows = [(i, t) for i, (_, t) in enumerate(known)] + [(i + 5000, f"Some words.\n  * {t.upper()}!\nMore words.") for i, (_, t) in enumerate(known) if "\n" not in t]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of_text = defaultdict(set)
    canonical = spark.createDataFrame(known, "id string, t string").select("id", licenses.canonical(F.col("t")).alias("c")).collect()
    for r in canonical:
        of_text[r.c].add(r.id)
    for i, r in enumerate(canonical):
        assert got[i].license_id == min(of_text[r.c])
        assert i + 5000 not in got or min(of_text[r.c]) in got[i + 5000].notices
    assert {k for k, _ in known} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "BSD-3-Clause", "MIT"}


def test_canonical_texts(spark):
    same = [("Licence  LICENCE, (licence)", "license license license"), ("Version 2.0 of ten per cent", "v2.0 of ten percent"), ("sub-license", "sublicense"), ("whilst", "while")]
    other = [("super century", "supercentury"), ("version 10", "v10"), ("colicence", "colicense"), ("ab", "a b")]
    c = lambda t: spark.range(1).select(licenses.canonical(F.lit(t)).alias("c")).head().c
    assert all(c(a) == c(b) for a, b in same) and all(c(a) != c(b) for a, b in other)
    own = licenses.scan(spark.createDataFrame([(1, "Our own terms, whilst valid."), (2, "x\nOur own terms while valid")], "doc_id long, text string"), [("Own", "our own terms; while valid")])
    assert {r.doc_id: (r.license_id, r.notices) for r in own.collect()} == {1: ("Own", ["Own"]), 2: (None, ["Own"])}


def test_licenses(spark, edges, nothing):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit.replace("<year> <holder>", "2020 Jo\nAll rights reserved.")), (2, mit.split("\n", 2)[2].upper().replace("LICENSE", "LICENCE")), (3, mit + " extra"), (4, "x\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license_id == got[2].license_id == "MIT" and got[3].license_id is None and got[4].notices == ["CC-BY-NC-4.0", "MIT"]
    assert licenses.scan(edges).count() == len(EDGES) and licenses.scan(nothing).count() == 0
    found = queries.op10_license_scan(spark, SF).filter("notices <> ''").collect()
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    line = re.compile(r"^(Released under the MIT License|Licensed under the Apache License, Version 2.0|Licensed under CC BY-NC 4.0|This work is licensed under the GNU General Public License, version 3)\.$", re.M)
    assert {r.doc_id for r in found} == {i for i, t in texts.items() if line.search(t)}


# pipeline


def test_pipeline(spark, edges):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    once = common.stored(corpus_pipeline.near_duplicates(spark, kept, SF), "t")
    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == sorted(i for i, (_, c) in brute_components(rows).items() if i == c)
    mixed = common.stored(corpus_pipeline.mixed(spark, once, SF), "t")
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.packed(spark, mixed, SF)
    assert packed.agg(F.sum("length")).head()[0] == sum(len(expected_ids(r.text)) for r in mixed.select("text").collect())
    for f in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.mixed):
        assert f(spark, edges, SF).columns == edges.columns
    out = corpus_pipeline.near_duplicates(spark, edges, SF).collect()
    assert Counter(r.doc_id for r in out)[5] == 0 and Counter(r.doc_id for r in out)[4] == 1


def brute_kept(rows: list[tuple], width: int, percent: int) -> list[int]:
    sets, up = {i: shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if c == b else c for k, c in up.items()}
    return sorted(i for i, c in up.items() if i == c)


def test_pipeline_near_copies_of_five_words_at_four_fifths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for family in range(24):
        base = [f"w{family}-{v}" for v in range(200)]
        rows.append((len(rows), " ".join(base)))
        if family % 2:  # one passage appended: likeness 0.75 to 0.9
            rows.append((len(rows), " ".join(base + [f"a{family}-{v}" for v in range(22 + 2 * family)])))
        else:  # scattered edits
            edited = list(base)
            for at in rng.choice(200, 2 + family // 8, replace=False):
                edited[at] = f"e{family}-{at}"
            rows.append((len(rows), " ".join(edited)))
    wide, narrow = brute_kept(rows, 5, 80), brute_kept(rows, 4, 85)
    assert set(wide) < set(narrow)
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == wide
    assert sorted(r.doc_id for r in ngram_join.join(df).collect() if r.doc_id == r.component_id) == narrow


def test_survivors_of_shared_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (7, a + " x"), (8, "c d"), (None, b), (None, c), (None, c), (None, c + " y"), (6, ""), (6, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _place int")
    got = ngram_join.survivors(df).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(5, a), (5, b), (8, "c d"), (None, c), (None, c + " y"), (6, ""), (6, "")])
    assert all(rows[r._place] == (r.doc_id, r.text) for r in got) and ngram_join.survivors(df.limit(0)).count() == 0


def test_hot_keys_are_dealt(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("cid"))
    keyed = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    hot = ngram_join.hot_keys(rows, "k")
    assert [r.k for r in hot.collect()] == [7] and hot.head()._salts > 10
    got = ngram_join.dealt_join(rows, keyed, "k", "cid", hot).collect()
    assert len(got) == 4000 and all(r.v == 2 * r.k for r in got)


def test_counts_of_very_long_texts():
    step = (1 << 64) // ngram_join.GROUPS
    s = np.concatenate([np.arange(70_000, dtype=np.uint64), np.arange(1, ngram_join.GROUPS, dtype=np.uint64) * np.uint64(step)])
    for part in (s, s[60_000:]):
        counts = ngram_join._vector(ngram_join.counted(part, 7).tobytes())
        assert len(counts) == ngram_join.GROUPS and counts.sum() == len(part) and counts[0] == len(part) - 127


def test_ngram_pairs_are_made_once(spark, monkeypatch):
    """Texts that meet in many shingles are a row a pair, not a row for each shingle; none is lost where heads are cut short."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join("x" * (k % (17 + d) == d) + w for k, w in enumerate(base)) if d % 3 else " ".join(base[: 280 + d]) for d in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    likeness = (50, 100)
    classes = ngram_join.sets_table(df, np.zeros(0, np.uint64), 4, likeness).withColumn("cid", F.col("doc_id"))
    posts = classes.select("cid", F.posexplode("first").alias("pos", "tok"))
    meet = posts.join(posts.groupBy("tok").agg(F.count("*").alias("k")).filter("k > 1"), "tok").withColumn("comp", F.col("cid"))
    made, plain = [], ngram_join.arrow_map

    def counting(df, run, schema, **more):
        if "score" not in schema:
            return plain(df, run, schema, **more)
        made.append(spark.sparkContext.accumulator(0))

        def counted(batches, n=made[-1]):
            for b in run(batches):
                n.add(b.num_rows)
                yield b

        return plain(df, counted, schema, **more)

    monkeypatch.setattr(ngram_join, "arrow_map", counting)
    found = []
    for heads in (ngram_join.HEADS, 1):
        monkeypatch.setattr(ngram_join, "HEADS", heads)
        found.append(sorted(tuple(r) for r in ngram_join.searched(meet, classes, ngram_join.heads_of(meet), likeness, best=False).collect()))
    assert len(found[0]) > 100 and found[0] == found[1]
    assert made[0].value == len(found[0]) < made[1].value
