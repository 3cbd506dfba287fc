"""Main text: the reader of markup on hand cases, trees and decoding against plain versions, whole pages."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm import html_extraction as hx
from memlake.llm.common import table
from memlake.llm.dom import parse
from tests.conftest import SF

SCHEMA = "page_id bigint, url string, html string, text int, n_chars string, v int, n string"


@pytest.fixture(scope="module")
def trees(spark):
    return hx.train(table(spark, SF, "pages"))


def everything(html):
    page = parse(html)
    return hx.text_of(page, np.ones(len(page.tag), bool))


@pytest.mark.parametrize("html,want", [
    ("", ""), ("plain  words\n here", "plain words here"), ("<p>a<p>b", "a b"), ("<p>a<b>b</b>c<br>d</p>", "abc d"), ("<p><b>One.<br><p>Two</p>", "One. Two"),
    ("<ul><li>x<li>y</ul>z", "x y z"), ("<script>var t='</p>';</script>after", "after"), ("<style>p{}</style><p>k</p>", "k"), ("a<!-- <p>no</p> -->b", "ab"),
    ("<p>&lt;tag&gt; &amp;amp; &copy &#233;&#x41;</p>", "<tag> &amp; © éA"), ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"), ("<p title='a>b'>x</p>", "x"),
    ("<div>one<p>two</div>three", "one two three"), ("</p></div>x", "x"), ("<textarea><p>no</textarea>yes", "yes"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<p>a</b>b</p>", "ab"), ("<script>never closed <p>x", ""), ("<!-- open", ""), ("<p>half <b class=x>in</b>line</p>", "half inline"), ("<noscript>n</noscript><select><option>o</select>t", "t"),
    ("<P>UP</P><DIV>d</DIV>", "UP d"), ("<li>a<ul><li>b</ul>c", "a b c"), ("x" * 200_000, "x" * 200_000), ("<div>" * 3_000 + "deep", "deep")])
def test_reader(html, want):
    assert everything(html) == want


def test_subtrees_are_contiguous():
    page = parse("<body><div>t<span class=k>u</span>v<p>w</div><ul><li>1<li class=ad>2</ul></body>")
    for k in range(len(page.tag)):
        under = {j for j in range(len(page.tag)) if k in itertools.takewhile(lambda i: i >= 0, chain_up(page, j))}
        assert under == set(range(k, page.end[k]))


def chain_up(page, k):
    while k >= 0:
        yield k
        k = page.parent[k]


def test_decoding_is_the_best_consistent_set():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 10))
        page = parse("")
        for k in range(1, n):
            page.add("div", (), int(rng.integers(0, k)))
        evidence, own = rng.normal(size=n), rng.integers(0, 90, n)
        gain = evidence * (0.1 + own / 40)
        fits = lambda s: s[0] and all(not s[k] or s[page.parent[k]] for k in range(1, n))
        best = max(sum(gain[1:][np.array(s[1:], bool)]) for s in itertools.product([False, True], repeat=n) if fits(s))
        keep = hx.decode(page, evidence, own)
        assert fits(keep.tolist()) and np.isclose(gain[1:][keep[1:]].sum(), best)


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(5)
    x = rng.integers(0, hx.BINS, (400, 6)).astype(np.uint8)
    y = ((x[:, 0] > 7) ^ (x[:, 3] > 4)).astype(float)
    t = hx.fit(x, y, np.ones(400))
    for row, score in zip(x[:50], t.score(x[:50])):
        plain = t.start
        for feature, cut, value in zip(t.feature, t.cut, t.value):
            at = 0
            while at < 2 ** hx.DEPTH - 1:
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            plain += value[at - (2 ** hx.DEPTH - 1)]
        assert np.isclose(plain, score)
    assert ((t.score(x) > 0) == (y > 0)).mean() > 0.97
    assert len(hx.fit(x, np.ones(400), np.ones(400)).value) == 0


LONG = "This is a long paragraph of the story, with several sentences. It goes on for a while, as texts do, and then it ends. "


def test_layouts_not_seen_in_training(trees):
    """Pages of plain divisions with attribute tokens, and of other elements, none of them in the given tables."""
    page = f"""<html><body class="has-sidebar"><div id="masthead"><a href=/>Home</a> <a href=/b>News</a></div>
      <div class="cookie-notice">We use cookies to make this site work, and to learn how it is used. Accept them all?</div>
      <div class="wrap"><div class="post-content"><h1>A title</h1><p>{LONG}{LONG}</p><p>{LONG}</p><blockquote>{LONG}</blockquote></div>
      <div class="sidebar"><h3>Popular</h3><ul><li><a href=/1>One thing</a><li><a href=/2>Another thing</a></ul></div></div>
      <form action=/s><label>Your name</label><input name=n></form>
      <div id="comments"><p>{LONG}</p><p>I liked this one very much, thank you.</p></div><div class="site-footer">&copy; Us</div></body></html>"""
    want = " ".join(f"A title {LONG}{LONG} {LONG} {LONG}".split())
    assert hx.main_text(page, trees) == want
    page = f"<body><header><h2>Site</h2></header><nav><a href=/>x</a></nav><main><h1>T</h1><p>{LONG}</p><aside>More of it</aside><p>{LONG}</p></main><footer>f</footer></body>"
    assert hx.main_text(page, trees) == " ".join(f"T {LONG} {LONG}".split())


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<article><p>a&nbsp;b</p></article>"), (3, "u", "<nav>only</nav>"), (3, "u", "<nav>only</nav>"), (4, "v", "<article>" + "<p>w x</p>" * 30_000 + "</article>")]
    df = spark.createDataFrame([(*r, 1, "z", 5, "n") for r in rows], SCHEMA).repartition(3)
    got = sorted([tuple(r) for r in hx.extract(df).collect()], key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, None, "a b", 3), (3, "u", "", 0), (3, "u", "", 0), (4, "v", " ".join(["w x"] * 30_000), 4 * 30_000 - 1)], key=str)
    assert hx.extract(df.where(F.lit(False))).count() == 0
    plain = spark.createDataFrame([(1, "u", "<p>no purpose named</p>", 1, "z", 5, "n")], SCHEMA)
    assert hx.extract(plain).first().text == "no purpose named"
