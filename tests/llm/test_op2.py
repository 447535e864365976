"""CRF extraction: held-out accuracy, Viterbi and gradient against brute force, pages of known text."""

import itertools

import numpy as np
import pytest

from pairwright.llm import htmlcrf as h


@pytest.fixture(scope="module")
def field():
    return h.default_field()


def test_held_out_accuracy(field):
    trees, right, total = h.Trees(), 0, 0
    for page in h.labelled_pages(150, seed=4321):
        _, y = h.labelled_blocks(page, trees)
        got = [main for _, main in field.decode([page.replace(h.MAIN, "").replace(h.REST, "")])[0]]
        if len(got) == len(y):
            right, total = right + sum(a == bool(b) for a, b in zip(got, y, strict=True)), total + len(y)
    assert total > 2000
    assert right / total > 0.98


def best(score, same, move, start, end):
    def value(y):
        s = start[y[0]] + end[y[-1]] + sum(x for x, k in zip(score, y, strict=True) if k)
        return s + sum(move[same[t], y[t - 1], y[t]] for t in range(1, len(y)))

    return max(itertools.product((0, 1), repeat=len(score)), key=value), value


def test_viterbi_and_gradient():
    rng = np.random.default_rng(3)
    lens = np.array([1, 5, 3, 7, 5])
    n = int(lens.sum())
    score, same = rng.normal(size=n), rng.integers(0, 2, n)
    move, start, end = rng.normal(size=(2, 2, 2)), rng.normal(size=2), rng.normal(size=2)
    got = h.viterbi(score, same, lens, move, start, end)
    at = 0
    truth = rng.integers(0, 2, n)
    like = 0.0
    for k in lens:
        own = slice(at, at + k)
        y, value = best(score[own], same[own], move, start, end)
        assert tuple(got[own]) == y
        like += value(truth[own]) - np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=int(k))))
        at += k
    out = h._gradient(score, same, lens, truth, move, start, end)
    assert np.isclose(out[0], like)
    step = np.zeros(n)
    step[4] = 1e-6
    up = h._gradient(score + step, same, lens, truth, move, start, end)[0]
    assert np.isclose((up - out[0]) / 1e-6, out[1][4], atol=1e-4)
    moved = move.copy()
    moved[1, 0, 1] += 1e-6
    assert np.isclose((h._gradient(score, same, lens, truth, moved, start, end)[0] - out[0]) / 1e-6, out[2][1, 0, 1], atol=1e-4)


PROSE = "The old mill stood by the river, and nobody had opened its doors for thirty years. On a grey morning in May, that changed."
PAGES = [
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a> <a href=/a>News</a></nav><article><h1>The mill</h1><p>{PROSE}</p><p>Be.</p></article><footer>&copy; 2020 Someone</footer></body></html>",
    f"<div id='header'><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div class='post-content'><h1>The mill</h1><p>{PROSE}<p>Be.</div><div class=sidebar><h3>Popular</h3><ul><li><a href=1>One thing</a></ul></div><div id=comments><p>I liked this text very much, and I read it twice.</p></div><div class='footer'>All rights reserved</div>",
    f"<div class='cookie-banner'>We use cookies, and you may say no.</div><main><h1>The mill</h1><div class=ad>Buy our soap, it is the best.</div><p>{PROSE}</p><script>var x='</p>'</script><p>B<b>e</b>.</p><form><label>Search</label><input></form></main><aside>Read more of this</aside>",
]


def test_known_pages(field):
    for text in field.main_texts(PAGES):
        assert text == f"The mill {PROSE} Be."


def test_blocks():
    trees = h.Trees()
    texts = lambda page: [b[0] for b in h.blocks(page, trees)]
    assert texts("<p>a &amp; b&nbsp;&#233;\n c<br>d<p><i>e</i>f") == ["a & b é c d", "ef"]
    assert texts("<ul><li>a<li>b</ul>c<td>d<td>e") == ["a", "b", "c", "d", "e"]
    assert texts("<p>a</p><script>if (a<b) '</p>'</script>b<style>x") == ["a", "b"]
    assert texts("a<!-- x <p> -->b</div></p>c<p cla") == ["ab", "c"]
    assert texts("2 < 3 <p>x > y") == ["2 < 3", "x > y"]
    assert texts("") == texts("<>".replace("<>", "<br>")) == []
    assert len(texts("<div>" * 20_000 + "x" + "<p>y" * 20_000)) == 20_001
    assert texts("<p>" + "z " * 300_000)[0].count("z") == 300_000


def test_rows(spark, field):
    rows = [(1, None, "a"), (2, "", "b"), (3, PAGES[0], "c"), (3, PAGES[0], "c"), (None, PAGES[1], None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = h.extract(df, field)
    assert out.columns == ["page_id", "html", "text", "__text", "__n_blocks"]
    got = sorted((r["page_id"] or 0, r["__text"], r["text"]) for r in out.collect())
    full = f"The mill {PROSE} Be."
    assert got == [(0, full, None), (1, "", "a"), (2, "", "b"), (3, full, "c"), (3, full, "c")]
    assert h.extract(df.limit(0), field).count() == 0
