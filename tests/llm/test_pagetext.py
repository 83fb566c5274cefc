"""Page text: markup, the network against plain loops, gradients, held-out layouts, whole pages, awkward rows."""

import html
import random
import re

import numpy as np
import pytest
from llm_fixtures import SF_MID

from rollbook.llm import pagetext as P
from rollbook.llm import queries_structure as Q
from rollbook.llm.markup import PATH_WORDS, Block, blocks


def texts(page):
    return [b.text for b in blocks(page)]


def test_markup():
    assert texts("<p>Hello <b>bo</b>ld <a href='x>y'>li\n nk</a> &amp; &copy x<br>next") == ["Hello bold li nk & © x", "next"]
    assert texts("a<!-- <p>no --> b<script>var t='</p><p>x';</script>c<style>p{}</STYLE >d<title>t</title>") == ["a b", "c", "d"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("1 < 2 &lt;p&gt; &#x41;&#66;&nbsp; &bogus; &am") == ["1 < 2 <p> AB &bogus; &am"]
    assert texts("x</p>y</div>z<p a=\"un closed>w") == ["x", "yz", "w"]
    assert [(b.path, b.text) for b in blocks("<body><p>a<div class='Post_Body x2'>b</div></section>c")] == [
        (("body", "p"), "a"), (("body", "div", ".post", ".body", ".x"), "b"), (("body",), "c")]
    assert [b.linked for b in blocks("<li><a href=#>abc</a> d")] == [3]
    assert texts("") == [] and texts("<") == ["<"] and texts("<!-- open") == [] and texts("<script>open") == [] and texts(None or "") == []


@pytest.mark.parametrize("page", ['<a "' * 50_000, "<" * 100_000, "<!--" * 50_000, "</x>" * 50_000, "<div>" * 5_000 + "</y>" * 50_000, "<h1>" * 5_000 + "<p>" * 5_000,
                                  "<a href=\"" * 50_000, "<script>" * 50_000])
def test_broken_markup_costs_little(page):
    assert len(blocks(page)) <= 1


def test_deep_pages_keep_all_text():
    got = blocks("".join(f"<div>t{k}" for k in range(500)))
    assert [b.text for b in got] == [f"t{k}" for k in range(500)] and max(len(b.path) for b in got) == PATH_WORDS


@pytest.fixture(scope="module")
def sample():
    import pyarrow.parquet as pq

    return [r["html"] for r in pq.read_table(f"{SF_MID}/pages.parquet").to_pylist()]


@pytest.fixture(scope="module")
def net(sample):
    return P.train(P.training_set(sample[:60]))


def sequences(rng, sizes):
    tags = ["div", "p", ".ad", "article", "nav", "li"]
    return [[Block(tuple(rng.choice(tags) for _ in range(rng.randint(0, 4))), " ".join(rng.choice(["one", "Two.", "three"]) for _ in range(rng.randint(1, 6))),
                   rng.randint(0, 3), rng.randint(0, 1)) for _ in range(n)] for n in sizes]


def plain_scores(net, seq):
    """The network block by block, in loops."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    f = P.features([seq])
    xs = []
    for k in range(len(seq)):
        ids, words = P.path_buckets(seq[k].path), f.words[f.word_at[k]:f.word_at[k + 1]]
        xs.append(np.concatenate([np.mean([net.path[i] for i in ids], axis=0), np.mean([net.word[i] for i in words], axis=0), f.shapes[k]]))
    sides = []
    for d in range(2):
        h, c, out = np.zeros(P.HIDDEN), np.zeros(P.HIDDEN), []
        for x in xs[::-1] if d else xs:
            z = x @ net.into[d] + net.bias[d] + h @ net.round[d]
            i, forget, o, g = (z[j * P.HIDDEN:(j + 1) * P.HIDDEN] for j in range(4))
            c = sig(forget) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out.append(h)
        sides.append(out[::-1] if d else out)
    return [float(sig(np.concatenate([a, b]) @ net.out + net.out_bias[0])) for a, b in zip(*sides)]


def test_scores_against_plain_loops():
    net, seqs = P.new_labeller(1), sequences(random.Random(2), [1, 7, 0, 3, 40, 7])
    got, at = net.scores(P.features(seqs)), 0
    for s in seqs:
        assert np.allclose(got[at:at + len(s)], plain_scores(net, s), atol=1e-5) if s else True
        at += len(s)


def test_long_sequences_in_strips(monkeypatch):
    net, seqs = P.new_labeller(1), sequences(random.Random(2), [90, 3])
    whole = net.scores(P.features(seqs))
    monkeypatch.setattr(P, "CELLS", 7)
    assert np.allclose(net.scores(P.features(seqs)), whole, atol=1e-6)


def test_gradients():
    net, seqs = P.new_labeller(2), sequences(random.Random(5), [4, 2, 6])
    for p in net.params():
        p.setflags(write=True)
    wide = P.Labeller(net.path.astype(float), net.word.astype(float), *[[a.astype(float) for a in w] for w in (net.into, net.round, net.bias)], net.out.astype(float), net.out_bias.astype(float))
    f, y = P.features(seqs), np.array([b.label for s in seqs for b in s], float)
    _, grads = P.gradients(wide, f, y)
    rng = np.random.default_rng(0)
    for p, g in zip(wide.params(), grads):
        hot = np.argwhere(np.abs(g) > 1e-7)
        for at in hot[rng.permutation(len(hot))[:4]]:
            at, eps = tuple(at), 1e-3
            kept = p[at]
            p[at] = kept + eps
            up = P.gradients(wide, f, y)[0]
            p[at] = kept - eps
            down = P.gradients(wide, f, y)[0]
            p[at] = kept
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-3 * max(1, abs(g[at])) + 2e-4


def test_held_out_layouts(net, sample):
    """Layouts and texts that were not learned from."""
    held = P.training_set(sample[60:160], seed=77)
    want = np.array([b.label for s in held for b in s])
    right = (net.scores(P.features(held)) > 0.5) == want
    assert right.mean() > 0.975


def test_planted_layouts(net):
    rng = random.Random(6)
    sentence = lambda: " ".join(rng.choice("river stone cloud paper window garden light music".split()) for _ in range(rng.randint(8, 40))) + "."
    body = [sentence() for _ in range(9)]
    paragraphs = "".join(f"<p>{t}</p>" for t in body)
    junk = '<div class="cookie-notice"><p>We use cookies on this site.</p></div>'
    page = (f'<html><body>{junk}<header><div>Site name</div><nav><ul><li><a href="#">Home</a><li><a href="#">News</a></ul></nav></header><div class="post-content">'
            f'<h1>River stone</h1>{paragraphs}</div><aside class="sidebar"><h3>Related</h3><ul><li><a href="#">Other story</a></ul></aside>'
            f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{sentence()}</p></div></section><footer><p>© 2024 All rights reserved.</p></footer>')
    assert P.main_texts(net, [page]) == [" ".join(["River stone", *body])]


def article(page):
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub("</?(p|h1|br)>", " ", re.sub("</?b>", "", inside))).split())


def test_query_returns_whole_articles(spark, sample):
    got = Q.op13_page_text(spark, SF_MID)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    page = {r["page_id"]: r for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()}
    assert sorted(r["page_id"] for r in rows) == sorted(page)
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == page[r["page_id"]]["url"] for r in rows)
    assert sum(r["text"] != article(page[r["page_id"]]["html"]) for r in rows) == 0


def test_awkward_rows(spark, net):
    long = "<article>" + "<p>Some plain words of a long page, again and again.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x", 1), (1, None, None, "x", 1), (None, "u", "", "x", 2), (2, "u", "<p>", "x", 3), (3, "u", long, "x", 4), (4, "u", "<script>alert(1)</script>", "", 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["n_chars"]): r for r in P.extract(df, net).collect()}
    assert len(got) == 5 and got[1, 0]["text"] == got[None, 0]["text"] == got[2, 0]["text"] == got[4, 0]["text"] == ""
    assert [r["n_chars"] for k, r in got.items() if k[0] == 3] == [20_000 * 50 - 1]
    none = spark.createDataFrame([], df.schema)
    assert P.extract(none, P.fit(none)).collect() == []
