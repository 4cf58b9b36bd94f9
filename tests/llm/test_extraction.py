import itertools
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from bourseflow.llm.common import by_hash, sampled
from bourseflow.llm.extraction import Settings, blocks_of, extracted, learn, main_text, minimum_cut, ties_of

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body class="page">
<header class="site"><h2>Brand</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy now</div><div id="sidebar"><p>Read more here</p></div>
<article><header><h1>The &amp; title</h1></header><p><b>First   line<br>goes&nbsp;on.<p>Second <i>one</i>&lt;3&gt;.</p><p>Short.</p><aside>Related: x</aside>
<form><label>Mail</label><button>Go</button></form><ul><li>point</li></ul></article><!-- <p>no</p> -->
<section class="comments"><p>A reader says something long about this article.</p></section><footer>&copy; me</footer></body></html>"""
WANT = "The & title\n\nFirst line goes on.\n\nSecond one<3>.\n\nShort.\n\npoint"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article_without_the_rest(spark):
    assert main_text(PAGE, {}) == WANT
    cut = PAGE[:PAGE.index("Second <i>one") + 9]                   # the page ends inside a tag
    assert main_text(cut, {}) == "The & title\n\nFirst line goes on.\n\nSecond"
    rows = [(i, f"u{i}", PAGE.replace("Short", f"Short {i}")) for i in range(20)] + [(100, "x", PAGE)]
    got = {r.page_id: r for r in extracted(pages_of(spark, rows)).collect()}
    assert got[100].text == WANT and got[100].n_chars == len(WANT) and got[3].text == WANT.replace("Short", "Short 3")


def test_without_telling_places(spark):
    weights = learn(pages_of(spark, [(i, "u", PAGE) for i in range(30)]))
    page = ("<div><a href=x>One</a></div><div><a href=x>Two</a></div><div><p>A long paragraph of plain text that goes on for many words and ends here.</p>"
            "<p>Another long paragraph with many plain words that also ends with a mark.</p><p>Yes.</p></div><div><a href=x>Three</a></div>")
    text = main_text(page, weights)
    assert "A long paragraph" in text and "Another" in text and "Yes." in text and "One" not in text and "Three" not in text


def test_cut_is_the_cheapest_of_all():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 8)
        odds = [rng.choice([-3.0, -1.0, 0.5, 1.0, 2.5]) for _ in range(n)]
        edges = [(i, j, rng.choice([0.25, 1.0, 2.0])) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(o for o, s in zip(odds, side) if o > 0 and not s) - sum(o for o, s in zip(odds, side) if o < 0 and s) \
                + sum(w for i, j, w in edges if side[i] != side[j])
        assert abs(cost(minimum_cut(odds, edges)) - min(cost(x) for x in itertools.product([False, True], repeat=n))) < 1e-6


def test_awkward_pages(spark):
    many = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only"), (4, "u", "<"), (5, "u", "<p"), (6, "u", "<a href='x>y</a><p>z"), (7, "u", many),
            (None, "u", PAGE), (None, "u", PAGE), (8, "u", "</div></p><article><p>a</article></article>&am"), (9, "u", "<article><p>" + "x" * 300_000)]
    docs = pages_of(spark, rows).selectExpr("*", "1 as text", "2 as n_chars")
    got = extracted(docs).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 11 and by[1] == by[2] == by[4] == by[5] == "" and by[None] == WANT
    assert by[7] == "\n\n".join(["word"] * 20_000) and by[8] == "a" and len(by[9]) == 300_000
    assert all(r.n_chars == len(r.text) for r in got)
    assert extracted(docs.limit(0)).count() == 0 and blocks_of("<p>&#x41;&eacute;</p>")[0].text == "Aé"


LONG = "The council met on Tuesday and spoke for three hours about the new bridge over the river, which nobody had asked for."
LEARNT = """<html><body><nav><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Sport</a></ul></nav><div class="ad">Buy now</div>
<article><h1>The bridge is here</h1><p>LONG</p><p>LONG LONG</p><p>LONG</p></article><footer>(c) me</footer></body></html>""".replace("LONG", LONG)


def test_the_cut_overrules_misleading_places(spark):
    weights = learn(pages_of(spark, [(i, "u", LEARNT) for i in range(30)]))
    assert main_text(LEARNT, weights) == "\n\n".join(["The bridge is here", LONG, f"{LONG} {LONG}", LONG])
    links = "".join(f"<li><a href=/{k}>Part {k}</a>" for k in range(3))
    inside = f'<html><body><article><p>{LONG}</p><div class="promo"><p>Again. {LONG}</p></div><p>{LONG}</p></article><footer>(c) me</footer></body></html>'
    assert main_text(inside, weights) == f"{LONG}\n\nAgain. {LONG}\n\n{LONG}"
    list_between = f'<html><body><nav><ul>{links}</ul></nav><div class="content"><ul>{links}</ul></div><footer><a href=x>Top</a></footer><main><p>{LONG}</p></main></body></html>'
    assert main_text(list_between, weights) == LONG
    alone = f'<html><body><nav><ul>{links}</ul></nav><div class="more-story">' + f"<p>{LONG}</p>" * 4 + "</div><footer>(c) me</footer></body></html>"
    assert main_text(alone, weights) == "\n\n".join([LONG] * 4)
    comments = LEARNT.replace("<footer>", f'<div class="comments"><p>{LONG}</p><p>{LONG}</p></div><footer>')
    assert main_text(comments, weights) == main_text(LEARNT, weights)
    hidden = f'<html><body><article><p>{LONG}</p><p hidden>{LONG}</p><div class="promo"><p style="display: none">{LONG}</p></div><p>{LONG}</p></article></body></html>'
    assert main_text(hidden, weights) == f"{LONG}\n\n{LONG}"
    assert main_text("<body><nav><p>Home</p></nav><div class='ad'>Buy now</div></body>", weights) == ""


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_raw_elements_do_not_cut_a_block():
    assert texts("<p>Alpha <script>x('</p>')</script>beta <svg><text>no</text></svg>gamma.</p>") == ["Alpha beta gamma."]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be a number.</p>") == ["Let x=1 be a number."]
    assert texts("<article><p>x<template><p>y</p></template></p><p>z<noscript><p>n</p></noscript>w</p></article>") == ["x", "zw"]
    assert texts("<p>Press <button>Go</button> now.</p><p>a<select><option>1<option>2</select>b</p>") == ["Press now.", "ab"]
    assert texts("<p>a<svg>b<svg>c</svg>d</svg>e</p>") == ["ae"] and texts("<p>open <svg> end</p>") == ["open end"]
    assert texts("<head><meta x><title>t</title></head><body>b</body>") == ["b"] and texts("a</svg>b<p/>c") == ["ab", "c"]


def test_random_trees_against_their_own_blocks():
    """Well-formed trees of block, inline and skipped elements: the blocks are the runs of text between edges of block elements."""
    rng = random.Random(7)
    for _ in range(300):
        parts, want, run = [], [], []

        def edge():
            whole = " ".join("".join(run).split())
            if whole:
                want.append(whole)
            run.clear()

        def grow(depth, skipped):
            for _ in range(rng.randrange(1, 4)):
                kind = rng.randrange(5 if depth < 6 else 2)
                if kind <= 1:
                    word = rng.choice(["a ", "b", " c", "\n", "d&amp;e"])
                    parts.append(word)
                    if not skipped:
                        run.append(word.replace("&amp;", "&"))
                    continue
                tag = rng.choice([["div", "section", "blockquote"], ["b", "i", "math", "span"], ["svg", "template", "noscript", "select"]][kind - 2])
                if kind == 2 and not skipped:
                    edge()
                parts.append(f"<{tag}>")
                grow(depth + 1, skipped or kind == 4)
                parts.append(f"</{tag}>")
                if kind == 2 and not skipped:
                    edge()
        grow(0, False)
        edge()
        assert texts("".join(parts)) == want, "".join(parts)


def test_100_000_levels():
    for page in ("<div>" * 100_000 + "<p>deep", "<div>x" * 100_000, "<blockquote>" * 100_000 + "<p>y</p>" * 1000, "<svg>" * 100_000 + "</b>" * 1000 + "z",
                 "<div>" * 50_000 + "</p>" * 50_000 + "q", "<script" * 50_000 + "<title>" * 50_000):
        began = time.time()
        blocks = blocks_of(page)
        ties_of(blocks, Settings())
        assert time.time() - began < 10
    tracemalloc.start()
    blocks_of("<div>x" * 100_000)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_sample_holds_at_any_size(spark):
    """The share of 1e11 rows is not rounded to nothing; copies of one page do not fill the sample; nothing chosen is an error."""
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 'same', concat('page ', id)) as html")
    assert 800 < sampled(rows, 0.1, "html").count() < 1700 and sampled(rows, 0.1, "html").where("html = 'same'").count() <= 1
    assert rows.where(by_hash(2_000 / 1e11, F.col("html"))).count() == 0 and rows.where(by_hash(1.0, F.col("html"))).count() == 20_000
    many = spark.range(3_000_000).where(by_hash(1e-6, F.col("id"))).count()
    assert 0 < many < 15
    with pytest.raises(ValueError):
        sampled(rows.limit(5), 1e-15, "html")
