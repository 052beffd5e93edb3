"""Extraction: inference against enumeration, accuracy on labelled pages held out, odd pages."""

import itertools

import pytest

from siltwork.llm import html_extract as X
from siltwork.llm.html_training import labelled_pages


@pytest.fixture(scope="module")
def model(spark):
    return X.fit_default(spark, 800)


def test_marginals_match_enumeration(model):
    tree = X.parse("<div class=ad><p>x y</p></div><article><h1>t</h1><p>some <b>text</b></p></article>")
    n = len(tree.tags)
    feats, total, ones = X.features(tree), 0.0, [[0.0] * 3 for _ in range(n)]
    import math

    for states in itertools.product(X.STATES, repeat=n):
        w = 1.0
        for i, s in enumerate(states):
            w *= math.exp(sum(model.unary[f][s] for f in feats[i] if f in model.unary))
            if i:
                w *= model.pairs[tree.tags[i] not in X.BLOCK][states[tree.parents[i]]][s]
        total += w
        for i, s in enumerate(states):
            ones[i][s] += w
    for found, want in zip(model.marginals(tree), ones):
        assert found == pytest.approx([w / total for w in want], rel=1e-6, abs=1e-12)


def test_held_out_accuracy(model):
    right = wrong = 0
    for page in labelled_pages(150, seed=99):
        tree = X.parse(page)
        truth, belief = X.states(tree), model.marginals(tree)
        for element, text, _ in tree.texts:
            if text.strip():
                agree = (truth[element] == X.CONTENT) == (belief[element][X.CONTENT] > 0.5)
                right, wrong = right + agree, wrong + (not agree)
    assert right / (right + wrong) > 0.98


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">no</a></li></ul></nav><!-- no --><div class="ad">no no no</div><article><h1>A &amp; B</h1><p><b>Fish&nbsp;and
 <i>chi</i>ps &lt;3.<br><p>More   text &am x.</p><script>no()</script></article><section class="comments"><p>no, said a reader of the page.</p></section>
<footer>&copy; no</footer></body></html>"""


def test_pages(spark, model):
    long = "<article><p>" + "word " * 50_000 + "</p></article>"
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<<<>>> &amp <p"), (5, "<div>" * 3000 + "x"), (6, long), (6, long), (None, PAGE)]
    got = X.extract(spark.createDataFrame([(i, h, "t", "k") for i, h in rows], "page_id long, html string, text string, page string"), model).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[None] == "A & B Fish and chips <3. More text &am x."
    assert texts[2] == texts[3] == ""
    assert texts[6] == ("word " * 50_000).strip()
    assert X.extract(spark.createDataFrame([], "page_id long, html string"), model).collect() == []


def test_blocks_lines_and_broken_markup():
    """What breaks a word and what does not, unclosed and self-closed elements, and deep pages."""

    def blocks(page):
        out = []
        for _, text, fresh in X.parse(page).texts:
            if fresh or not out:
                out.append(text)
            else:
                out[-1] += text
        return [b for b in (" ".join(b.split()) for b in out) if b]

    assert blocks("foo<img>bar Hel<svg></svg>lo a<my-tag>b</my-tag>c x<script>1</script>y") == ["foobar Hello abc xy"]
    assert blocks("<p>a<p>b<br>c<td>d") == ["a", "b", "c", "d"]
    assert blocks("<p>1 <math><mi>x</mi><mspace/></math> 2</p>tail") == ["1 x 2", "tail"]
    assert blocks("a<svg viewBox=x /> b<noscript>c <p>d") == ["a bc", "d"]
    assert blocks("a<object>b</object><canvas>c") == ["abc"]
    deep = X.parse("<div>" * 50_000 + "</b>" * 50_000 + "end")
    assert len(deep.tags) == 50_001 and deep.texts[-1][1] == "end"
    assert X.parse("<select>" * 20_000 + "x").texts[-1][1] == "x"
