"""Vector search against brute force, and main-text extraction on held-out and odd pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorweave.llm import htmlcrf, vptree


@pytest.mark.parametrize("floats", [1 << 19, 400])
def test_nearest(spark, monkeypatch, floats):
    monkeypatch.setattr(vptree, "SHARD_FLOATS", floats)
    monkeypatch.setattr(vptree, "BLOCK", 7)
    monkeypatch.setattr(vptree, "LEAF", 8)
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (300, 4)).astype(np.float32)  # many ties and equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x) if v.any()]
    odd = [(1000, None), (1001, []), (1020, [0.0] * 4), (1040, [1.0, None, 0.0, 0.0]), (1060, [float("nan")] * 4), (1080, [float("inf"), 0.0, 0.0, 0.0]), (1100, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "score": F.lit(None).cast("string"), "id": F.lit(3)})
    got = {}
    for r in vptree.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for q in ids[ids % 20 == 0]:
        s = m @ m[ids == q][0]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted(got[q]) == [(k + 1, ids[j], s[j]) for k, j in enumerate(order)]
    assert 1020 not in got and 1100 not in got
    assert vptree.nearest(df.filter("false")).count() == 0
    assert vptree.nearest(df.filter("vec_id < 5")).filter("query_id = 0").count() == len([r for r in rows if 0 < r[0] < 5])


def test_factor_trades_recall_for_visits():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(20, 8)).repeat(100, 0) + 0.05 * rng.normal(size=(2000, 8)))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(2000)
    exact, loose = vptree.Tree(vptree.build(ids, x)), vptree.Tree(vptree.build(ids, x))
    a = exact.search(ids[:50], x[:50], 10)
    b = loose.search(ids[:50], x[:50], 10, factor=1.5)
    assert loose.visited <= exact.visited < 50 * len(exact.nodes)
    want = {(q, i) for q, i in zip(a[0], a[1])}
    assert len(want & {(q, i) for q, i in zip(b[0], b[1])}) >= 0.9 * len(want)
    y = x.astype(float)
    brute = {(q, i) for q in range(50) for i in np.lexsort((ids, -np.where(ids == q, -9, y @ y[q])))[:10]}
    assert len(want & brute) == len(brute)


def pages(n):
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()[:n]


def test_held_out_pages_with_other_marks():
    own = pages(250)
    field = htmlcrf.train(own[:120])
    rng, others = random.Random(9), [b.text for p in own[200:] for b in htmlcrf.blocks(p)]
    right = total = 0
    for p in own[120:200]:
        found = htmlcrf.blocks(htmlcrf.labelled(p, others, rng, True, "mark-9"), "mark-9")
        for b, y in zip(found, field.decode(found)):
            right += b.label == y
            total += 1
    assert right >= 0.97 * total


def test_blocks():
    page = "<p>a &amp; b<br>c <b>d</b>e<p>next<script>var x='<p>no</p>'</script><style>p{}</style><!-- <p>no --><ul><li>one<li>two</ul>tail &lt;x&gt; <a href='q>r'>link</a>"
    assert [b.text for b in htmlcrf.blocks(page)] == ["a & b c de", "next", "one", "two", "tail <x> link"]
    assert htmlcrf.blocks("") == [] and [b.text for b in htmlcrf.blocks("bare < text")] == ["bare < text"]
    assert len(htmlcrf.blocks("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


def test_viterbi_is_the_best_sequence():
    import itertools

    field = htmlcrf.train(pages(40))
    found = htmlcrf.blocks(pages(41)[40])[:8]
    feats = field.features.of(found)

    def score(y):
        s = sum((field.one if b else field.zero)[f] for own, b in zip(feats, y) for f in own)
        return s + sum(field.pairs[a][b] for a, b in zip(y, y[1:]))

    assert score(field.decode(found)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=len(found)))))


def test_extract_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (3, "u", "no tags"), (3, "u", "no tags"), (4, "u", "<nav>menu</nav><article><h1>T</h1><p>" + "word " * 50_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("z")})
    got = htmlcrf.extract(df, htmlcrf.learn(df)).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert got[0].text == got[1].text == ""
    empty = df.filter("false")
    assert htmlcrf.extract(empty, htmlcrf.learn(empty)).count() == 0


STORY = ["Rain over the hills", "The rain came down for three days and the river rose above its banks.", "Farmers moved their sheep to higher ground."]
HEAD, FIRST, SECOND = STORY
BODY = f"<h1>{HEAD}</h1><p>{FIRST}</p><p>{SECOND}</p>"
SAID = "<p>I saw it myself, it was very bad near our house.</p><p>Nonsense, said nobody who lives there.</p>"
LAYOUTS = {
    "comments in the article": (f'<nav><a href="/">Home</a></nav><article>{BODY}<section id="discussion"><h3>What readers say</h3>{SAID}</section></article>', STORY),
    "comments beside a story without a mark": (f'<div class="story">{BODY}</div><div class="comments">{SAID}</div>', STORY),
    "a layout of tables": (f'<table><tr><td><a href="/">Home</a> | <a href="/n">News</a></td></tr><tr><td>{BODY}</td></tr><tr><td>&copy; 2020 The Valley Times</td></tr></table>', STORY),
    "one paragraph": (f"<p>{FIRST}</p>", [FIRST]),
    "no wrapper": (f'<div id="header"><a href="/">Home</a></div>{BODY}<div id="footer">&copy; The Valley Times</div>', STORY),
    "attributes named like labels": (f'<article>{BODY}<table><tr><th>Thing</th><td data-label="Price">Seven coins for the whole lot of it.</td><td data-label="">The rest of them cost a little more.</td></tr></table><p data-label="0">{SECOND}</p></article>', [*STORY, "Thing", "Seven coins for the whole lot of it.", "The rest of them cost a little more.", SECOND]),
}


@pytest.fixture(scope="module")
def field():
    return htmlcrf.train(pages(250))


@pytest.mark.parametrize("name", LAYOUTS)
def test_text_of_layouts(field, name):
    body, want = LAYOUTS[name]
    assert field.text(f"<html><head><title>x</title></head><body>{body}</body></html>").split("\n") == want
    assert field.text(f"<html><body>{body}</body></html>").split("\n") == want


@pytest.mark.parametrize("kind", ["nested", "unclosed", "quotes", "inline", "headings", "lists"])
def test_parsing_takes_linear_time(kind):
    import time

    make = {
        "nested": lambda n: "<div>" * n + "text", "unclosed": lambda n: "<a b " * n, "quotes": lambda n: '<a b="> ' * n + "<p c='>x", "inline": lambda n: "<i>" * n + "<b>" * n + "</i>" * n,
        "headings": lambda n: "<p><div>" + "<x>" * n + "<h1>t" * n, "lists": lambda n: "<ul>" + "<li>a<ul>" * n,
    }[kind]
    took = []
    for n in (5_000, 40_000):
        page, began = make(n), time.process_time()
        htmlcrf.blocks(page)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)  # eight times the page; its square would be 64
