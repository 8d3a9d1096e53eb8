"""Main text: the cut against all labellings, the reader against known pages, and the ready query's rows."""

import html
import itertools
import random
import re

import pytest

from oreline.llm import pages
from oreline.llm.mincut import Network
from oreline.llm.pages import DEFAULT, Page, extract_pages, fit_pages, label_page, looks, main_text, steps_between

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header class="site-header"><a href="/">My site</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do. Is that fine with you?</div><!-- a > b -->
<article><header><h1>A   title</h1></header><p title="a > b">First &amp; <b>bo</b>ld,&nbsp;as it is. <i>Never closed<p>Sec&#111;nd one\n  goes on.<br>And on.
<div class="ad">Buy this, it is good. Really, you will like it, and so on.</div><ul><li>point one<li>point two</ul>
<form><label>Mail</label><input name=m><button>Send</button></form><table><tr><td>cell one<td>cell two</table><p hidden>secret</p><p>Short.</p></article>
<aside><p>A long text beside the article, with commas, stops. And more of it.</p></aside>
<section id="comments"><article class="comment"><p>I liked this text a lot, thanks. It is what I looked for.</p></article></section>
<div role="contentinfo">About us. We write texts, and you read them.</div><footer>&copy; 2020 &middot; all rights</footer></body></html>"""
TEXT = "A title\nFirst & bold, as it is. Never closed\nSecond one goes on. And on.\npoint one\npoint two\ncell one\ncell two\nShort."


def test_known_page():
    assert main_text(PAGE, DEFAULT) == TEXT


@pytest.mark.parametrize("source", ["", " ", "plain text, nothing else. It has two sentences.", "<p>a <b c", "<", "<p>x</p></div></p></article>", "<script>never closed <p>x", "<!-- never closed <p>x", "<a href='it's'>x</a>", "<p title=\"never closed>x", "</", "<li>" * 50, "<p>&am; &notit; &#0; &#x110000; &amp"])
def test_broken_markup(source):
    main_text(source, DEFAULT)


def test_only_text_counts_as_a_block():
    assert main_text("plain text, nothing else. It has two sentences, and more words than a title.", DEFAULT) == "plain text, nothing else. It has two sentences, and more words than a title."
    assert main_text("<p>It is a text that is long enough, and has signs. I mean it. x <y and z", DEFAULT) == "It is a text that is long enough, and has signs. I mean it. x"


def test_page_without_marks():
    """Looks and neighbours decide alone."""
    long = "This is a sentence of the text, which goes on for a while. And this is another one, as texts have more than one."
    source = "<body><div>" + "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(8)) + f"</div><div><h2>Title here</h2><p>{long}</p><p>Short bit.</p><p>{long}</p></div><div><a href=/x>More</a> | <a href=/y>Less</a></div></body>"
    assert main_text(source, DEFAULT) == f"Title here\n{long}\nShort bit.\n{long}"


def cost(gains, edges, side):
    return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gains, side)) + sum(c for a, b, c in edges if side[a] != side[b])


def test_cut_is_least():
    draw = random.Random(2)
    for _ in range(300):
        n = draw.randrange(1, 9)
        gains = [draw.choice([0, draw.uniform(-3, 3)]) for _ in range(n)]
        edges = [(a, b, draw.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]
        net = Network(n)
        for i, g in enumerate(gains):
            net.lean(i, g)
        for e in edges:
            net.bind(*e)
        found = cost(gains, edges, net.source_side())
        assert found == pytest.approx(min(cost(gains, edges, side) for side in itertools.product([False, True], repeat=n)))


def test_labels_of_a_page_are_its_least_cut():
    """Blocks and the elements that hold them, against all labellings of both."""
    draw = random.Random(4)
    for _ in range(25):
        source = "".join(draw.choice(["<div>", "</div>", "<p>Some words, a sentence of them. Yes.</p>", "<p><a href=/>Link</a></p>", "<p>ok</p>"]) for _ in range(9))
        page = Page(source)
        n = len(page.blocks)
        used = sorted({p for b in page.blocks for p in _up(page.parents, b.parent)})
        if not 1 < n < 7 or len(used) > 8:
            continue
        gains = [max(-pages.LOOKS, min(pages.LOOKS, sum(w * x for w, x in zip(DEFAULT, looks(b))) + DEFAULT[-1])) + b.mark for b in page.blocks] + [0.0] * len(used)
        place = {p: n + i for i, p in enumerate(used)}
        edges = [(i, place[b.parent], pages.SAME) for i, b in enumerate(page.blocks)]
        edges += [(i - 1, i, pages.NEXT / (1 + steps_between(page.parents, page.blocks[i - 1].parent, page.blocks[i].parent))) for i in range(1, n)]
        edges += [(place[p], place[page.parents[p]], pages.SAME / 2) for p in used if page.parents[p] >= 0]
        least = min(cost(gains, edges, side) for side in itertools.product([False, True], repeat=n + len(used)))
        kept = label_page(page, DEFAULT)
        assert min(cost(gains, edges, [*kept, *side]) for side in itertools.product([False, True], repeat=len(used))) == pytest.approx(least)


def _up(parents, p):
    while p >= 0:
        yield p
        p = parents[p]


def article(source):
    """Paragraphs and title of the article element, which the given pages mark."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", part))).strip() for part in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    """Every page's article, word for word, with weights that were fitted to a part of the pages."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = fit_pages(table, pages_read=100)
    assert weights != list(DEFAULT)
    sources = {r.page_id: r.html for r in table.collect()}
    for r in extract_pages(table, weights).collect():
        assert r.text == article(sources[r.page_id]) and r.n_chars == len(r.text)


def test_articles_without_their_marks(spark):
    """With article elements renamed, the looks that were learned from marked pages still find nine tenths of the text."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = tuple(fit_pages(table))
    sure = missed = 0
    for r in table.collect():
        want = article(r.html).split("\n")
        got = main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>"), weights).split("\n")
        sure += sum(len(w) for w in want)
        missed += sum(len(w) for w in want if w not in got)
    assert missed < 0.1 * sure


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    rows = [(1, None, "u", "t", 5), (2, "", "u", "t", 5), (None, PAGE, "u", "t", 5), (3, PAGE, None, "t", 5), (3, PAGE, None, "t", 5)]
    table = spark.createDataFrame(rows, "page_id bigint, html string, url string, text string, n_chars int")
    found = extract_pages(table, fit_pages(table))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found.collect()) == sorted([(1, "", 0), (2, "", 0), (0, TEXT, len(TEXT)), (3, TEXT, len(TEXT)), (3, TEXT, len(TEXT))])
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert fit_pages(none) == list(DEFAULT) and extract_pages(none, list(DEFAULT)).collect() == []


def test_very_long_page():
    """Whole, however long: a hundred thousand blocks, and elements nested a thousand deep."""
    text = "".join(f"<p>Sentence number {i}, as there are many.</p>" + ("<div class=ad>Buy now, it is good.</div>" if i % 3 == 0 else "") for i in range(30_000))
    found = main_text(f"<nav><a href=/>x</a></nav><article>{text}</article><footer>end</footer>", DEFAULT).split("\n")
    assert found == [f"Sentence number {i}, as there are many." for i in range(30_000)]
    deep = "<div>" * 1000 + "<p>A text that lies deep, but is a text. Yes.</p>" + "</div>" * 1000
    assert main_text(f"<article>{deep}</article>", DEFAULT) == "A text that lies deep, but is a text. Yes."
