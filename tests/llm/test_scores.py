"""The quality classifier, language-model scores and main-text extraction."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioframe.llm import html_extract, lm_score, quality, queries


def test_quality_query(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op7_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[d].score, y) for d, y in labels.items() if d in got and got[d].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.94


def test_quality_cases(spark):
    rows = [(i, ("good words here " if i % 2 else "BAD!! ") * (3 + i % 7), "x") for i in range(200)] + [(500, None, "x"), (501, "", "x"), (None, "good words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and out[-1].doc_id is None and not out[-1].held_out
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 200)
    left = quality.drop_poor(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {i for i in range(200) if i % 2}
    assert quality.score(docs.where("false"), model).collect() == []
    unknown = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, unknown).collect()} == {0.5}


def test_quality_learns_nothing_from_held_out_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where(quality.held_out(labels["doc_id"]))
    other = labels.where(~quality.held_out(labels["doc_id"])).unionByName(flipped)
    assert quality.fit(docs, labels) == quality.fit(docs, other)


def test_quality_learns_from_whole_texts(spark):
    rng = np.random.default_rng(1)
    same = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"], 900))
    rows = [(i, same + " " + " ".join(rng.choice(["calm", "prose", "reads"] if i % 2 else ["BUY!!", "cheap$", "click>"], 400))) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(same) > 4000 and b"prose" in model.good and b"cheap$" in model.bad
    assert all(r.predicted == r.doc_id % 2 for r in quality.score(docs, model).collect())


def _lm(texts, target, size, mass):
    words = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    counts = Counter(w for x in words for w in x)
    assert len(counts) <= size
    vocabulary = set(counts)
    steps = [[("<>", w[0])] + list(itertools.pairwise(w)) + [(w[-1], "<>")] if w else [] for w in words]
    out = []
    models = []
    for member in (target, [True] * len(texts)):
        one = Counter(b for x, m in zip(steps, member, strict=True) if m for _, b in x)
        two = Counter(s for x, m in zip(steps, member, strict=True) if m for s in x)
        models.append((one, two, sum(one.values())))
    total = max(1, models[0][2])
    for x in steps:
        row = []
        for one, two, n in models:
            s = total / max(1, n)
            bits = 0
            for a, b in x:
                alone = (one[b] * s + 1) / (total + len(vocabulary) + 2)
                bits -= math.log2((two[a, b] * s + mass * alone) / (one[a] * s + mass))
            row.append(bits / max(1, len(x)))
        out.append((max(0, len(x) - 1), *row))
    return out


def test_lm_against_counting(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["The", "cat", "é9", "sat", "ON", "mat"], int(n))) + "." for n in rng.integers(1, 30, 40)] + [None, "", "!!", "cat " * 5000]
    monkeypatch.setattr(lm_score, "HELD", 4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "cat sat", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 2)] + [(1, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    models = lm_score.fit(docs, labels, vocabulary_size=100)
    got = sorted((r for r in lm_score.score(docs, models).collect() if r.doc_id is not None), key=lambda r: r.doc_id)
    expect = _lm([*texts, "cat sat"], [i < 20 and i % 2 == 0 for i in range(len(texts) + 1)], 100, 50.0)
    for r, (n, target, background) in zip(got, expect, strict=False):
        assert r.n_words == n
        assert r.target_loss == pytest.approx(target, abs=1e-5) and r.background_loss == pytest.approx(background, abs=1e-5)
        assert r.score == pytest.approx(background - target, abs=2e-5)
    assert lm_score.score(docs.where("false"), models).collect() == []
    nothing = lm_score.fit(docs.where("false"), labels)
    assert all(math.isfinite(r.score) for r in lm_score.score(docs, nothing).collect())


def test_lm_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.score for r in queries.op4_lm_score(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000
    assert np.mean([got[d] for d, y in labels.items() if y == 1]) > np.mean([got[d] for d, y in labels.items() if y == 0])


def test_lm_counts_every_word_and_pair(spark):
    """More words than 2^15 and more pairs than 2^20 have their own counts; all target documents count."""
    n = 40_000
    texts = [" ".join(f"w{(i * 31 + k * k * (i + 1)) % n}" for k in range(40)) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25_000)], "doc_id long, quality int, toxic int")
    models = lm_score.fit(docs, labels)
    steps = Counter(s for t in texts for s in itertools.pairwise(["", *t.split(), ""]))
    assert models.words == len({w for t in texts for w in t.split()}) > 32_768
    assert models.pairs.count() == len(steps) > 1 << 20
    assert (models.background, models.target) == (sum(steps.values()), 25_000 * 41)


def test_lm_scores_texts_it_has_not_counted(spark):
    docs = spark.createDataFrame([(i, "a b c a d" if i % 2 else "c b x") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    models = lm_score.fit(docs, labels)
    one, two = Counter(), Counter()
    for i in range(20):
        w = ["", *("a b c a d" if i % 2 else "c b x").split(), ""]
        one.update(w[1:])
        two.update(itertools.pairwise(w))
    s, total, width = 6 / sum(one.values()), 6, 5 + 2
    bits = lambda a, b: -math.log2((two[a, b] * s + 50 * (one[b] * s + 1) / (total + width)) / (one[a] * s + 50))
    new = spark.createDataFrame([(1, "a c zz b"), (1, None)], "doc_id long, text string")
    got = sorted(lm_score.score(new, models).collect(), key=lambda r: r.n_words)
    assert tuple(got[0]) == (1, 0, 0.0, 0.0, 0.0)
    assert got[1].background_loss == pytest.approx(sum(itertools.starmap(bits, itertools.pairwise(["", "a", "c", "zz", "b", ""]))) / 5, abs=1e-6)
    with pytest.raises(ValueError):
        lm_score.fit(docs, labels, vocabulary_size=3)


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        evidence = [round(float(x), 2) for x in rng.normal(0, 2, n)]
        edges = [(a, b, round(float(rng.uniform(0, 2)), 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        price = lambda x: sum(e if e > 0 and not v else -e if e < 0 and v else 0 for e, v in zip(evidence, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731, B023
        got = html_extract.minimum_cut(evidence, edges)
        assert price(got) == pytest.approx(min(map(price, itertools.product([False, True], repeat=n))), abs=1e-6)


def _price(found, model, picked):
    e, w = html_extract.costs(found, model), html_extract.edges(found, model.smooth)
    return sum(x if x > 0 and not v else -x if x < 0 and v else 0 for x, v in zip(e, picked, strict=True)) + sum(c for a, b, c in w if picked[a] != picked[b])


def test_whole_pages_are_cut_at_least_cost():
    """Every labelling of a page's blocks, against the cut's; pages of nameless elements, so that blocks are weak."""
    rng = np.random.default_rng(4)
    model, moved = html_extract.Model(), 0
    for _ in range(40):
        parts = [rng.choice(["Ok", "One two", "A line of some words, with no end", "This is a whole sentence of the text, and it ends here.", "<a href=x>Home and away</a>"]) for _ in range(int(rng.integers(1, 10)))]
        page = "".join(f"<div>{x}</div>" if rng.random() < 0.6 else f"<div><div>{x}</div></div>" for x in parts)
        found = html_extract.blocks(page)
        got = html_extract.labels(found, model)
        best = min(_price(found, model, x) for x in itertools.product([False, True], repeat=len(found)))
        assert _price(found, model, got) == pytest.approx(best, abs=0.01)
        moved += sum((e > 0) != v for e, v in zip(html_extract.costs(found, model), got, strict=True))
    assert moved > 10


@pytest.mark.parametrize(("token", "expect"), [("sidebar", 1), ("left-sidebar", 1), ("cookieNotice", 1), ("post_footer", 0.85), ("legal-analysis", html_extract.HINT), ("share-buttons", 1), ("ad-leaderboard", html_extract.HINT), ("has-sidebar", 0), ("alert-free", 0), ("story", 0), ("shareholder", 0)])
def test_names_say_more_or_less(token, expect):
    assert html_extract.strength(token, frozenset(html_extract.AWAY_WORDS)) == expect


@pytest.mark.parametrize("model", [None, "fitted"])
def test_names_of_ancestors_are_no_veto(spark, model):
    text = "This sentence is part of the article and it is long enough to look like one."
    if model:
        model = html_extract.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
        assert model.weights != html_extract.PRIOR
    cases = {
        f"<div class='layout has-sidebar'><article><p>{text}</p><p>Ok</p></article></div>": f"{text}\nOk",
        f"<div class='post legal-analysis'><p>{text}</p><p>{text}</p></div>": f"{text}\n{text}",
        f"<article><p>{text}</p><div class=ad-leaderboard><p>Buy it now.</p></div><p>{text}</p></article>": f"{text}\n{text}",
        f"<main><div class='row alert-free'><p>{text}</p></div></main>": text,
        f"<form id=aspnetForm><div class=nav><a href=x>Home</a></div><div class=content><p>{text}</p></div></form>": text,
        f"<div class='widget Blog'><article><h2>T</h2><p>{text}</p></article></div><div class=sidebar><article><p>{text}</p></article></div>": f"T\n{text}",
        f"<article><p>{text}</p><div class=notice><p>{text}</p></div><form><p>{text}</p></form><div class=share-buttons>Tell all</div></article><div class=comments><p>{text}</p></div>": text,
    }
    for page, expect in cases.items():
        assert html_extract.main_text(page, model) == expect


def test_fit_without_pages_that_tell():
    assert html_extract.fit_pages([]) == html_extract.fit_pages([None, "", "<p>x"]) == html_extract.Model()


def test_deep_and_unmatched_markup_is_linear():
    import time

    n = 100_000
    for page in ("<center></i2></q9>" * n + "<p>deep</p>", "<div><p>a</q>" * (n // 10), "<center>" * n + "x" + "</b2>" * n, "<article>" + "<div>" * n + "<p>deep</p></article>", "<ul>" + "<li>" * n, "<table>" + "<tr><td>" * (n // 2)):
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 20


LONG = "This sentence is part of the article and it is long enough to look like one. "
PAGES = [
    (None, ""),
    ("", ""),
    ("just text", None),
    (f"<html><body><header><h1>Site</h1><ul><li><a href=/>Home</a></ul></header><main><h1>Head &amp; line</h1><p>{LONG}<p>Short.<ul><li>One<li>Two</ul></main><aside>More</aside><footer>&copy; x</footer></body></html>", f"Head & line\n{LONG.strip()}\nShort.\nOne\nTwo"),
    (f"<div class='cookie-notice'><p>{LONG}</p></div><article><header><h1>T</h1></header><p>a<b>b</b>  c<br>d&nbsp;e</p><form><label>Mail</label><input><button>Go</button></form><div class=ad>{LONG}</div><pre>x &lt; y</pre></article><section id=comments><article class=comment><p>{LONG}</p></article></section>", "T\nab c d e\nx < y"),
    (f"<div id=content><p>{LONG}</p><p>{LONG}</p><script>var a='</p>';</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div><nav><a href=x>{LONG}</a></nav>", "\n".join([LONG.strip()] * 3)),
    ("<article><p>cut off &amp fine</p><p>and th", "cut off & fine\nand th"),
    ("<article><p>cut tag</p><p>x</p></artic", "cut tag\nx"),
    ('<article><p title="a > b">quoted</p><p class="x>y</p><p>z</p></article>', None),
    ("<article><!-- never closed <p>x</p></article>", ""),
    ("<article><p>a < b and 3<4</p><script>unclosed", "a < b and 3<4"),
    ("<article>" + "<div>" * 3000 + "<p>deep</p></article>", "deep"),
    (f"<article><p hidden>{LONG}</p><p>shown</p><div style='display: none'><p>{LONG}</p></div><p>again</p></article>", "shown\nagain"),
]


def test_extraction_cases(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x", "y")], "page_id long, url string, html string, n_chars string")
    rows = html_extract.extract(pages).collect()
    assert len(rows) == len(PAGES) + 1
    for r in rows:
        if r.page_id is not None and PAGES[r.page_id][1] is not None:
            assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert html_extract.extract(pages.where("false")).collect() == []


def test_extraction_query(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op6_html_extraction(spark, sf_dir).collect():
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", " " if x == "<br>" else "", x)).split()) for x in re.split("</?(?:p|h1)>", article.replace("<br>", " ")))
        assert r.text == "\n".join(x for x in lines if x)
