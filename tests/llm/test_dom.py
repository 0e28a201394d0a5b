import html
import itertools
import re
import time

import numpy as np
import pytest

from graphloom.llm import dom


@pytest.fixture(scope="module")
def model():
    return dom.default_model()


def test_sum_product_equals_enumeration():
    page = dom.parse("<div><p>a<b>c</b></p><ul><li>x</ul></div>")
    forest, rng = dom.Forest.of([page]), np.random.default_rng(3)
    n = len(page.tags)
    unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(len(dom.KINDS), 2, 2))
    p, both = dom.sum_product(forest, unary, pair)
    total, one, edge = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(unary[k, y[k]] for k in range(n)) + sum(pair[forest.kind[k], y[page.parent[k]], y[k]] for k in range(1, n)))
        total += w
        one += w * np.array(y)
        for k in range(1, n):
            edge[k, y[page.parent[k]], y[k]] += w
    assert np.allclose(p[:, 1], one / total) and np.allclose(both[1:], edge[1:] / total)


def test_held_out_pages_of_the_grammar(model):
    pages = dom.labelled_pages(150, seed=77)
    found = model.marginals([p for p, _ in pages])
    assert np.mean([((m >= 0.5) == label).mean() for (_, label), m in zip(pages, found)]) > 0.97


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want[r.page_id] = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?\w+>", "", re.sub(r"<(/?)(p|h1|br)>", " ", body)))).strip()
    got = {r.page_id: (r.text, r.n_chars) for r in dom.extract_main_text(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


@pytest.mark.parametrize("junk", [
    "<nav><a href=/>Home</a> <a href=/a>About us</a></nav>", '<div class="cookie-banner"><p>We use cookies on this site, as all do.</p></div>',
    "<aside><h3>Related</h3><ul><li><a href=/x>Another story</a></ul></aside>", "<script>var x = '<p>never</p>';</script>", "<style>p {color: red}</style>",
    '<form><label>Your mail</label><input name=q><button>Send</button></form>', '<section id="comments"><h3>2 comments</h3><div class="comment"><p>Nice text, thanks for it.</p></div></section>',
    "<footer>&copy; 2024 Someone, all rights reserved.</footer>", '<div class="advert">Buy one, get two.</div>', "<!-- <p>hidden</p> -->",
])
def test_junk_goes_and_article_stays(model, junk):
    for before, after in ((junk, ""), ("", junk)):
        page = (
            f"<html><head><title>t</title></head><body>{before}<article><h1>A title</h1><p>One <b>bold</b>&nbsp;word, then a\n sentence of some length &amp; more.</p>"
            f"<ul><li>first point<li>second point</ul><p>Closing words of the piece, as long as the others.</article>{after}</body></html>"
        )
        assert model.extract([page]) == ["A title One bold word, then a sentence of some length & more. first point second point Closing words of the piece, as long as the others."]


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "deep words in here, many of them" + "</div>" * 3000
    rows = [(1, None, None, 1), (1, "u", "", 2), (2, "u", "plain text without any markup at all, a sentence long.", 3), (3, "u", "<p>unclosed <b>tags <i>everywhere", 4),
            (4, "u", "< not a tag <3 & 5 &lt;b&gt; <", 5), (None, "u", deep, 6), (6, "u", "<![CDATA[x]]><!bogus><?php ?>", 7)]
    got = dom.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert got[0].text == got[1].text == "" and got[2].text.startswith("plain text")
    assert dom.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_inline_tags_do_not_split_words_and_blocks_do(model):
    page = "<article><h1>Heads</h1><p>un<b>broken</b> wo<i>rd</i>s in the text here, as it should be.</p><p>next<br>line of the text, and so on.</p></article>"
    assert model.extract([page]) == ["Heads unbroken words in the text here, as it should be. next line of the text, and so on."]


NAMES = ["has-sidebar", "single single-post no-sidebar comments-open", "no-comments", "sidebar-right", "page-tags", "has-share", "has-banner", "widget-area", "one-side", "two-side-layout", "social-article"]
TEXT = "A heading First paragraph of the piece, with a few words in it. Second paragraph, which says a little more than the first one did."
ARTICLE = "<article><h1>A heading</h1><p>First paragraph of the piece, with a few words in it.</p><p>Second paragraph, which says a little more than the first one did.</p></article>"


@pytest.mark.parametrize("name", NAMES)
def test_names_of_wrappers_do_not_empty_an_article(model, name):
    pages = [f'<html><body class="{name}">{ARTICLE}</body></html>', f'<body><div class="{name}">{ARTICLE}</div></body>', f'<body><div id="{name.split()[0]}"><div class="wrap {name}">{ARTICLE}</div></div></body>',
             f'<body><main class="{name}">{ARTICLE}</main><footer>&copy; Someone</footer></body>']
    assert model.extract(pages) == [TEXT] * 4


def test_a_form_around_the_page(model):
    page = f"<body><form action='/x' id='aspnetForm'><nav><a href='/'>Home</a> <a href='/b'>More</a></nav>{ARTICLE}<footer><p>&copy; 2024 Someone, all rights reserved.</p></footer></form></body>"
    assert model.extract([page]) == [TEXT]


def test_long_comments_and_side_columns_stay_out_inside_wrappers(model):
    comments = "".join(f"<article class='comment'><p>Comment {k}: I do not agree with what was said here, and I say so at some length, as one does.</p></article>" for k in range(6))
    side = "<div class='sidebar'><h4>More</h4><ul><li><a href=/a>Another story</a><li><a href=/b>One more</a></ul></div>"
    for name in ("has-sidebar comments-open", "layout"):
        assert model.extract([f"<body class='{name}'><div class='{name}'>{ARTICLE}{side}<section id='comments'><h3>6 comments</h3>{comments}</section></div></body>"]) == [TEXT]


@pytest.mark.parametrize("page", ["<div>" * 8000 + "deep words" + "</div>" * 8000, '<a "' * 20_000, "<a href='x" * 20_000, '<p title="' * 10_000 + ">", "<li>" * 20_000, "<p>" * 20_000, "<table><tr><td>" * 5000, "<!--" * 20_000, "<body>" * 20_000, "</p>" * 20_000])
def test_hostile_pages_take_no_time(page):
    began = time.process_time()
    dom.parse(page)
    assert time.process_time() - began < 0.5


def test_deep_pages_are_extracted_in_time(model):
    began = time.process_time()
    model.extract(["<div>" * 8000 + "words " * 50 + "</div>" * 8000])
    assert time.process_time() - began < 3


def test_quotes_in_tags():
    assert [t for _, t in dom.parse("<p title=\"a > b\">one</p> <p title='>'>two</p> <p title=\"open>three</p> <a>four</a>").text if t.strip("\0 ")] == ["one", "two", "three", "four"]


NAV = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(7)) + "</ul></nav>"
FOOT = "<footer><p>&copy; 2024 Someone, all rights reserved.</p></footer>"
PARTS = ["First paragraph of the piece, with a few words in it, and more of them.", "Second paragraph, which says a little more than the first one did.", "Third, no longer than those before it, but as good.", "The fourth paragraph ends the piece, as all pieces end."]
COMMENTS = "<section class='comments'><h3>12 comments</h3>" + "".join(f"<div class='comment'><p>Comment {k}: I do not agree with what was said here, and I say so at some length, as one does.</p></div>" for k in range(12)) + "</section>"
BLOCKS = {
    "comments beside a wrapper": ("<div class='content has-sidebar'><h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in PARTS) + "</div>" + COMMENTS, True),
    "comments beside a wrapped article": ("<div class='content has-sidebar'><article><h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in PARTS) + "</article></div>" + COMMENTS, True),
    "rows": ("<article>" + "".join(f"<div class='row with-sidebar'><p>{x}</p></div>" for x in PARTS) + "</article>", False),
    "rows without an article": ("<main>" + "".join(f"<div class='row with-sidebar'><p>{x}</p></div>" for x in PARTS) + "</main>", False),
    "sections": ("<article>" + "".join(f"<div class='social-section'><p>{x}</p></div>" for x in PARTS) + "</article>", False),
    "page builder in an article": ("<article>" + "".join(f"<div class='elementor-widget elementor-widget-text-editor'><div class='elementor-widget-container'><p>{x}</p></div></div>" for x in PARTS) + "</article>", False),
    "page builder in main": ("<main><h1>A title</h1>" + "".join(f"<div class='elementor-widget elementor-widget-text-editor'><p>{x}</p></div>" for x in PARTS) + "</main>", True),
    "a column named after its side": ("<div class='promo'><p>Buy this thing today, it is the best of all things, and cheap.</p><p>Everybody has one by now, and so should you, before they are all gone, which will be soon, as they are that good and that cheap, we say.</p><p>No other thing is like it, trust us, and order now.</p></div>"
                                      "<div class='sidebar-right'><div class='content'>" + "".join(f"<p>{x}</p>" for x in PARTS) + "</div></div>", False),
}


@pytest.mark.parametrize("name", BLOCKS)
def test_articles_under_everyday_names(model, name):
    body, titled = BLOCKS[name]
    want = " ".join((["A title"] if titled else []) + PARTS)
    assert model.extract([f"<html><body>{NAV}{body}{FOOT}</body></html>"]) == [want]
