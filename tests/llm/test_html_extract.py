"""Operator 1: exact marginals, held-out layouts, and texts of odd pages."""

import itertools

import numpy as np
import pytest

from stallboard.llm import html_extract as X

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model():
    return X.train([X.parse(h) for h in X.labelled_layouts(300)])


def test_marginals_equal_enumeration(model):
    page = X.parse("<body><div class=ad><p>aa bb</p></div><article><p>cc dd</p><b>e</b></article></body>")
    trees = X.forest([page])
    got, _ = X.marginals(model, trees)
    local = np.where(trees.observed, -40, trees.features @ model.unary)
    total, content = 0.0, np.zeros(len(local))
    for y in itertools.product((0, 1), repeat=len(local)):
        score = sum(local[i] for i in range(len(y)) if y[i])
        score += sum(model.pair[trees.kind[i], y[trees.parent[i]], y[i]] for i in range(len(y)) if trees.parent[i] >= 0)
        total += np.exp(score)
        content += np.exp(score) * np.array(y)
    assert np.allclose(content / total, got)


def test_gradient_is_that_of_the_likelihood():
    pages = [X.parse(h) for h in X.labelled_layouts(6, seed=4)]
    first, later = X.train(pages, steps=1), X.train(pages, steps=60)
    trees = X.forest(pages)
    y = trees.label.clip(0)

    def fit(model):
        p, _ = X.marginals(model, trees)
        return np.where(y == 1, p, 1 - p)[~trees.observed].mean()
    assert fit(later) > fit(first) and fit(later) > 0.95


def test_unseen_layouts(model):
    pages = [X.parse(h) for h in X.labelled_layouts(200, seed=99)]
    trees = X.forest(pages)
    right = ((X.marginals(model, trees)[0] > 0.5) == trees.label.clip(0)) | trees.observed
    assert np.mean([right[a:b].all() for a, b in zip(trees.first, trees.first[1:])]) > 0.95


def test_article_without_the_rest(model):
    html = ('<body><header><a href=/>Logo text here</a></header><div class="cookie-notice"><p>We use cookies, please accept them all. '
            'It is good.</p></div><main><article><header><h1>Title</h1></header><p>First &eacute; para&nbsp;x.</p><aside><p>Side bar text '
            'that is long enough to be like a paragraph, yes.</p></aside><p>Second <b>bold</b>text.</p><div class="ad">Buy now!</div>'
            '<ul><li>One \n item<li>Two item</ul><form><p>Subscribe here please</p></form></article><footer>c</footer>')
    assert X.extract([X.parse(html)], model) == ["Title\nFirst é para x.\nSecond boldtext.\nOne item\nTwo item"]


def test_odd_pages(model):
    odd = [None, "", "<", "&amp", "</div></p>", '<script>var a="</p>"', "<!-- open", "<p", "\x00<b>", "<div>" * 3000, "<p>x" * 500]
    assert len(X.extract([X.parse(h) for h in odd], model)) == len(odd)


def test_table_rows(spark, sf_dir):
    """Every page of the small table: the text of its one article."""
    import html as H
    import re
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html, "clash", "clash") for r in pages.collect()]
    rows += [(None, None, None, None, None), (rows[0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = X.main_texts(df, X.fit(df)).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for page_id, _, html, _, _ in rows[:-2]:
        inner = html[html.index("<article"):].split("</article>")[0]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:article|h1|p)[^>]*>", inner))
        assert texts[page_id] == "\n".join(b for b in blocks if b)
    assert texts[None] == "" and all(r.n_chars == len(r.text) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert X.main_texts(df, X.fit(df)).collect() == []
