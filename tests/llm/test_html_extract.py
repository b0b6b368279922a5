import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyline.llm import html_extract
from tallyline.llm.shared import table


def texts(page):
    return [b.text for b in html_extract.leaf_blocks(page)]


def test_blocks_of_broken_and_odd_pages():
    assert texts(None) == texts("") == texts(" \n") == texts("<p></p><div> </div>") == []
    assert texts("<p>a<p>b <b>c<br>d</b>e</p>f") == ["a", "b c de", "f"]
    assert texts("<ul><li>one<li>two</ul>three") == ["one", "two", "three"]
    assert texts("x<script>var t='</p>';</script>y<!-- <p>no --><style>p{}</style>z") == ["x y z"]
    assert texts("<p>1 < 2 &amp;&lt;b&gt; &#233;&nbsp;&copy; &unknown; &amp") == ["1 < 2 &<b> é © &unknown; &"]
    assert texts("<div title='a>b' class=x>in</div><p unclosed \"quote>more") == ["in", "more"]
    assert texts("<p>cut <b") == ["cut"]
    assert texts("<script>never ends <p>x") == []
    assert texts("</p></div>a</nav>b") == ["a", "b"]
    assert texts("<![CDATA[x]]><?php y ?><!DOCTYPE z>w") == ["w"]


def test_ancestors_names_and_links():
    (a, b) = html_extract.leaf_blocks('<body><div class="Side-Bar" id=menu><a href="#">go</a> on</div><article><p>text</p></article>')
    assert a.tags == ("body", "div") and a.names == ("side", "bar", "menu") and a.linked == 2
    assert b.tags == ("body", "article", "p") and b.linked == 0


def test_very_long_and_deep_pages():
    assert len(texts("<p>" + "word " * 200_000)[0]) == 999_999
    assert len(texts("<div>" * 3000 + "x")) == 1
    assert texts("<" * 3000 + "a") is not None
    assert texts('<a href="' * 2000) is not None


def brute_decode(field, named):
    from itertools import product

    def value(labels):
        total = sum(field.weights.get(f, (0.0, 0.0))[y] for names, y in zip(named, labels) for f in names)
        return total + sum(field.chain[a][b] for a, b in zip(labels, labels[1:]))

    return value, max(product((0, 1), repeat=len(named)), key=value)


def test_viterbi_finds_the_best_labels():
    rng = random.Random(1)
    for _ in range(60):
        own = html_extract.Field({f: (rng.gauss(0, 1), rng.gauss(0, 1)) for f in "abcd"}, [[rng.gauss(0, 1) for _ in "xy"] for _ in "xy"])
        named = [rng.sample("abcde", rng.randint(0, 4)) for _ in range(rng.randint(1, 8))]
        value, best = brute_decode(own, named)
        assert value([int(x) for x in own.decode(named)]) == pytest.approx(value(best))
    assert own.decode([]) == []


@pytest.fixture(scope="module")
def field():
    return html_extract.fit(html_extract.labelled([]))


def test_held_out_layouts(field):
    rng = random.Random(1234)
    right = total = 0
    for _ in range(300):
        words = [" ".join(rng.choices(["lorem", "ipsum", "dolor,", "sit", "amet."], k=rng.randint(8, 60))) for _ in range(20)]
        shorts = [" ".join(rng.choices(["More", "News", "Today", "2024"], k=rng.randint(1, 4))) for _ in range(10)]
        blocks = html_extract.leaf_blocks(html_extract.made_up_page(rng, words, shorts))
        found = field.decode([html_extract.features(b) for b in blocks])
        right += sum(x == b.gold for x, b in zip(found, blocks))
        total += len(blocks)
    assert right / total > 0.97


PROSE = [f"The long way number {k} leads through the hills, and after a day of walking it reaches the sea." for k in range(6)]
PARAGRAPHS = [f"<p>{x}</p>" for x in PROSE]


@pytest.fixture(scope="module")
def fitted(spark):
    """The field of a table whose pages hold everything between the article's tags to be main text."""
    pages = table(spark, "/root/testdata/sf0.01", "pages").limit(300).collect()
    return html_extract.fit(html_extract.labelled([r["html"] for r in pages]))


@pytest.mark.parametrize("inner", [
    '<aside>Related: <a href="#">The bridge</a></aside>', '<aside class="sidebar"><p>Related: more about the hills.</p></aside>',
    '<div class="advert"><p>Buy two pairs of boots, and get a third pair free today.</p></div>', '<div class="ad">Buy boots now</div>',
    '<form><label>Your name</label><input><button>Send</button></form>',
    '<div class="comments"><p>I walked there too, and it was a fine day.</p></div>',
    '<section class="comments"><div class="comment"><p>I walked there too, and it was a fine day.</p></div></section>',
    '<div class="related"><article><p>Another way leads to the lake, and few know it.</p></article></div>',
    '<div class="newsletter subscribe"><p>Get our letter each week.</p></div>', '<nav><a href="#">Next</a></nav>',
    '<div class="share social"><a href="#">Share</a></div>',
])
def test_what_is_no_main_text_inside_an_article(fitted, inner):
    for page in (
        f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><article><h1>Ways</h1>{''.join(PARAGRAPHS[:3])}{inner}{''.join(PARAGRAPHS[3:])}</article></body></html>",
        f"<body><article>{''.join(PARAGRAPHS)}{inner}</article><footer>© us</footer></body>",
    ):
        assert [x for x in html_extract.main_text(page, fitted).split("\n") if x != "Ways"] == PROSE


def test_teasers_and_comments_that_are_articles(fitted):
    for after in (
        '<div class="related"><article><p>Another way leads to the lake, and few know it.</p></article></div>',
        '<section class="comments"><article><p>I walked there too, and it was a fine day.</p></article></section>',
        '<aside><article><p>Another way leads to the lake, and few know it.</p></article></aside>',
    ):
        assert html_extract.main_text(f"<body><article>{''.join(PARAGRAPHS)}</article>{after}</body>", fitted).split("\n") == PROSE


def test_title_without_a_head(fitted):
    page = f"<html><title>Bridge news</title><h1>Ways</h1><article>{''.join(PARAGRAPHS)}</article>"
    found = html_extract.main_text(page, fitted).split("\n")
    assert "Bridge news" not in found and [x for x in found if x != "Ways"] == PROSE


@pytest.mark.parametrize("unit", ["<div>a", "<div class=c{}>a", "<p>a</nav>", "<section id=s{}><b>a</b>", "</div>a<ul><li>"])
def test_fifty_thousand_unclosed_tags(field, unit):
    page = "".join(unit.replace("{}", format(k, "b").translate({48: "x", 49: "y"})) for k in range(50_000))
    start = time.process_time()
    html_extract.main_text(page, field)
    assert time.process_time() - start < 5
    assert len(html_extract.leaf_blocks(page)) == 50_000


def test_labels_are_those_of_the_features(field):
    rng = random.Random(5)
    for _ in range(30):
        blocks = html_extract.leaf_blocks(html_extract.made_up_page(rng, list(html_extract._PROSE), list(html_extract._SHORT)))
        assert field.labels(blocks) == field.decode([html_extract.features(b) for b in blocks])


def test_weights_without_labels():
    assert html_extract.fit([]).decode([["bias"]]) == [False]


def article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", body))).split("\0")
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_pages_of_the_table(spark, make):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages).collect()}
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert got == want


def test_nulls_repeats_and_clashing_columns(spark, make):
    page = "<body><nav><a href=x>Home</a></nav><article><p>First of all, this is the text.</p><p>Then there is more of it.</p></article><footer>© us</footer>"
    rows = [(1, page), (1, page), (2, None), (3, ""), (None, page)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("mine")).withColumn("h", F.lit(1))
    got = sorted(((r["page_id"], r["text"]) for r in html_extract.extracted(pages).collect()), key=str)
    text = "First of all, this is the text.\nThen there is more of it."
    assert got == sorted([(1, text), (1, text), (2, ""), (3, ""), (None, text)], key=str)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_head_without_its_end_tag():
    prose = "".join(f"<p>The long way number {k} leads through the hills, and after a day it reaches the sea.</p>" for k in range(5))
    inside = '<title>T <b>t</b></title><meta charset="utf-8"><link rel=x href=y><script>s()</script><style>p{}</style><noscript>n</noscript>'
    field = html_extract.fit(html_extract.labelled([]))
    want = html_extract.main_text(f"<html><head>{inside}</head><body><article>{prose}</article></body></html>", field)
    assert want.count("\n") == 4 and "T" not in want.split()
    for page in (
        f"<html><head>{inside}<article>{prose}</article>", f"<head>\n{inside}\n<article>{prose}</article></html>",
        f"<html><head>{inside}<b></b><article>{prose}</article>", f"<html><head>{inside}<body><article>{prose}</article>",
    ):
        assert html_extract.main_text(page, field) == want
    blocks = html_extract.leaf_blocks(f"<head>{inside} plain words <div>more</div>")
    assert [b.text for b in blocks if "head" not in b.tags] == ["plain words", "more"]
