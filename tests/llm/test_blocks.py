import html as entities
import re
import time

import numpy as np
import pytest

from tallymart.llm import blocks as b
from tallymart.llm.common import table


@pytest.fixture(scope="module")
def model(spark, sf):
    return b.train(table(spark, sf, "pages"))


def texts(html):
    return [x.text for x in b.blocks(html)]


def test_blocks_of_clean_and_broken_pages():
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("plain &amp; simple") == ["plain & simple"]
    assert texts("<p>a<br>b<p>c <b>d</b>\n e</div>f<script>var t='</p>'</script>g<!-- x --><style>p{}</style>h") == ["a b", "c d e", "fgh"]
    assert texts("<ul><li>one<li><a href='x>y'>two</a></ul><p title=\"1>2\">three") == ["one", "two", "three"]
    assert texts("a < b <3 c<d") == ["a < b <3 c"]
    assert texts("x<!-- never ends") == ["x"] and texts("x<script>never") == ["x"]
    assert texts("&lt;p&gt;&#233;&nbsp;&eacute;") == ["<p>é é"]
    linked = b.blocks("<li><a href=/x>all of it</a></li><p>none</p>")
    assert [x.linked for x in linked] == [9, 0]


def test_paths():
    paths = [x.path for x in b.blocks("<body><nav class='Top menu'><li>a</nav><article id=main-text><p>b<div>c</div></article>d")]
    assert paths == [("body", "nav", ".top", ".menu", "li"), ("body", "article", ".main", ".text", "p"), ("body", "article", ".main", ".text", "div"), ("body",)]


def test_long_pages_take_linear_time():
    t = time.time()
    for page in ["<" * 200_000, "<p a=\"" * 30_000, "<p x='" * 30_000 + "'", "<div>" * 20_000 + "x", "<!--" * 50_000, "<script>" * 50_000, "a&" * 100_000, "<p>" * 50_000]:
        b.blocks(page)
    assert time.time() - t < 20


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in b.new_model().items()}
    x = r.normal(size=(5, 3, b.WIDTH))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float)
    y, known = (r.random((5, 3)) > 0.5) * 1.0, mask * (r.random((5, 3)) > 0.2)
    _, g = b.step(p, x, mask, y, known)
    for k in p:
        for _ in range(4):
            at = tuple(r.integers(0, s) for s in p[k].shape)
            kept = p[k][at]
            p[k][at] = kept + 1e-3
            up, _ = b.step(p, x, mask, y, known)
            p[k][at] = kept - 1e-3
            down, _ = b.step(p, x, mask, y, known)
            p[k][at] = kept
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4 + 0.05 * abs(g[k][at]), k


def test_padding_changes_nothing(model):
    r = np.random.default_rng(1)
    pages = [r.normal(size=(n, b.WIDTH)).astype(np.float32) for n in (1, 7, 3, 0, 40)]
    together = b.chances(pages, model)
    for p, y in zip(pages, together):
        assert np.allclose(b.chances([p], model)[0], y, atol=1e-5) and len(y) == len(p)


def expected(html):
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", article))
    return "\n".join(x for x in parts if x)


def test_query(spark, sf):
    given = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = b.op10_html_extraction(spark, sf).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert r.text == expected(given[r.page_id].html) and r.n_chars == len(r.text) and r.url == given[r.page_id].url


def test_other_layouts(model, spark, sf):
    """Held-out pages, redrawn in layouts that the sample may not have shown."""
    cut = [b.blocks(r.html) for r in table(spark, "/root/testdata/sf0.01", "pages").collect()]
    r = np.random.default_rng(3)
    pages = [b.other_layout(page, [x for p in cut[:20] for x in p], r) for page in cut]
    right = [(y > 0.5) == (b.layout_label(x.path) == 1) for page, ys in zip(pages, b.chances([b.vectors(p) for p in pages], model)) for x, y in zip(page, ys) if b.layout_label(x.path) >= 0]
    assert np.mean(right) > 0.99


def test_a_written_page(model):
    text = ["The river rose for three days and then it fell again.", "People came back to their houses, one after the other, and looked at what was left."]
    page = f"<html><body><div class='menu'><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></div><div class='cookie notice'>We use cookies.</div><div class='content'><p>{text[0]}</p><p>{text[1]}</p></div><form>Your mail <input></form><section class=comments><p>Nice one!</p></section><footer>Imprint</footer></body>"
    cut = b.blocks(page)
    kept = [x.text for x, y in zip(cut, b.chances([b.vectors(cut)], model)[0]) if y > 0.5]
    assert kept == text


def test_nulls_repeats_and_empty(spark):
    page = "<nav><a>x</a></nav><article><p>One two three.</p><p>Four.</p></article>"
    pages = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, page, None), (3, page, None), (None, page, "v")], "page_id long, html string, text string")
    rows = b.extract(pages).collect()
    assert [r.main_text for r in rows[:2]] == ["", ""] and len(rows) == 5 and len({r.main_text for r in rows[2:]}) == 1
    assert b.extract(pages.limit(0)).count() == 0
