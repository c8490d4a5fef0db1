"""Main text of pages."""

import time

import pytest

from tallyhouse.llm.htmltext import extract_text, main_text, smoothed

LONG = "A paragraph that is long enough to look like the text of an article, with commas, and more."

CASES = [
    (None, ""),
    ("", ""),
    ("plain words &amp; more", "plain words & more"),
    (f"<article><h1>T</h1><p>{LONG}<p>Short.<p><b>x</b>y<br>z</article>", f"T\n{LONG}\nShort.\nxy z"),
    (f"<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>{LONG}</p></main><footer><p>{LONG}</p></footer>", f"T\n{LONG}"),
    (f"<div class='ad'><p>{LONG}</p></div><div id=sideBar><p>{LONG}</p></div><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><form><p>Sign up</p></form><div class='cookie-notice'>We use</div><section id='comments'><p>{LONG}</p></section></article>", LONG),
    (f"<body><div class=text><p>{LONG}</p><p>Short.</p></div><nav><a href=x>a</a></nav><script>var a='<p>no</p>';</script></body>", f"{LONG}\nShort."),
    ("<article><p>a&nbsp;&lt;b&gt; &eacute;&#x41;\n\n  c</p></article>", "a <b> éA c"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>cut &amp", "cut &"),
    ("<article><!-- <p>no</p> --><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<nav>only</nav><footer>boilerplate</footer>", ""),
    ("<p>one</p></div></article><p>two", "one\ntwo"),
]

# Dropped elements inside and between the paragraphs of an article.
INSIDE = [
    ("<p>A</p><script>var x=1;</script><p>B</p>", "A\nB"),
    ("<p>A</p><style>p {}</style><noscript><p>n</p></noscript><template><p>t</p></template><button>Go</button><p>B</p>", "A\nB"),
    ("<p>A</p>\n<span class=ad>buy</span> <a class='share' href=x>tell</a><p>B</p>", "A\nB"),
    ("<p>one<script>var x=1;</script> two <span class='ad'>buy <b>now</b></span>three</p>", "one two three"),
    ("<p>one<button><div>Go</div></button>two <svg><title>t</title><text>u</text></svg> three</p>", "one two three"),
    ("<p>one <select><option>a<option>b</select> two</p><p>three</p>", "one two\nthree"),
    ("<p>one <noscript><p>no</p></noscript>two <template><p>no<li>no</template>three</p>", "one two three"),
    ("<p>one <textarea>no</textarea><label>no</label><iframe>no</iframe>two</p>", "one two"),
    ("<p>one <span class=ad>buy</p><p>two</p>", "one\ntwo"),
    ("<p>one <a class=share href=x>tell<p>two</p>", "one\ntwo"),
    ("<p>one</p><select><option>a<option>b</select><p>two</p>", "one\ntwo"),
    ("<p>one <button><div>Go</p><p>two</p>", "one\ntwo"),
]


@pytest.mark.parametrize("body, text", INSIDE)
def test_dropped_elements_inside_an_article(body, text):
    assert main_text(f"<article>{body}</article>") == text
    assert main_text(f"<main><h1>T</h1>{body}<p>end</p></main>") == f"T\n{text}\nend"


@pytest.mark.parametrize("html, text", CASES)
def test_cases(html, text):
    assert main_text(html) == text


# Class and id words that real articles use too.
DOUBTED = [
    (f"<div class='entry-header'><h1><a href=x>T</a></h1></div><p>{LONG}</p>", f"T\n{LONG}"),
    (f"<h2 class=section-header>H</h2><p>{LONG}</p><h3 id=related-work><a href='#r'>R</a></h3>", f"H\n{LONG}\nR"),
    (f"<section id=discussion><h2>D</h2><p>{LONG}</p></section>", f"D\n{LONG}"),
    (f"<div class='long-form'><p>{LONG}</p></div><p class=popular>Short.</p>", f"{LONG}\nShort."),
    (f"<div class='overflow-hidden'><p>{LONG}</p><div class=related><p>See <a href=x>another page</a></p></div></div>", LONG),
    (f"<p>{LONG}</p><ul class=toc><li><a href=x>one</a><li><a href=y>two</a></ul>", LONG),
]


@pytest.mark.parametrize("body, text", DOUBTED)
def test_words_that_articles_use_too(body, text):
    assert main_text(f"<article>{body}</article>") == text


def test_doubted_words_outside_an_article():
    assert main_text(f"<div class=site-header><h1>Site</h1></div><div class=text><p>{LONG}</p></div><div class=search-form>Find it</div>") == LONG
    assert main_text(f"<div class=long-form><p>{LONG}</p></div>") == LONG


def test_whole_long_pages():
    body = "".join(f"<p>word{i} {LONG}</p>" for i in range(5000))
    assert main_text(f"<article>{body}</article>").count("\n") == 4999
    assert main_text("<div>" * 3000 + LONG) == LONG


def test_kernel_keeps_a_constant():
    assert smoothed([2.0] * 7) == pytest.approx([2.0] * 7)
    assert smoothed([]) == []


def test_given_pages_are_their_articles(spark, small):
    """A second way for the given template only: what stands between the article's tags."""
    import html
    import re

    for r in extract_text(spark.read.parquet(f"{small}/pages.parquet")).collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "u", "")]
    pages = spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], "page_id long, url string, html string, text string, tags string, _row string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "html", "tags", "_row", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "x", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "piece, kept",
    [
        ('<h2 id="share-prices">Prices</h2>', "Prices"),
        ('<h2 id="the-menu-problem" class="social">Menus</h2>', "Menus"),
        ('<p id="copyright-law">On the law.</p>', "On the law."),
        ('<p class="social-science">On science.</p>', "On science."),
        ('<p class="wide share">Share this</p>', ""),
        ('<div id="comments"><p>First!</p></div>', ""),
        ('<div class="share-bar">Tell others</div>', ""),
        ('<p hidden>Not shown</p>', ""),
    ],
)
def test_names_inside_an_article(piece, kept):
    got = main_text(f"<html><body><article><p>{'Long text. ' * 9}</p>{piece}<p>{'More text. ' * 9}</p></article></body></html>").split("\n")
    assert got[1:-1] == ([kept] if kept else [])


def test_a_page_in_one_form_and_small_forms():
    text = "<p>" + "A sentence of the text. " * 12 + "</p>"
    small = '<form action="/s"><p>Search our pages</p><input name="q"><button>Go</button></form>'
    for page in (f'<body><form id="aspnetForm"><div>{text}{text}</div></form></body>', f"<body>{small}<div>{text}{text}</div></body>", f'<body><form id="f"><article>{text}{text}</article></form></body>'):
        got = main_text(f"<html>{page}</html>")
        assert got.count("\n") == 1 and got.startswith("A sentence") and "Search" not in got


def test_comments_in_articles_of_their_own():
    text = "<p>" + "A sentence of the text. " * 12 + "</p>"
    comment = '<article class="comment" id="comment-7"><p>' + "I do not agree at all. " * 12 + "</p></article>"
    assert "agree" not in main_text(f"<body><article>{text}</article>{comment}</body>")


def test_many_open_elements_take_linear_time():
    html = "<article>" + "<b>" * 20_000 + "<p>x</p></i>" * 3_000
    start = time.process_time()
    assert main_text(html).count("x") == 3_000
    assert time.process_time() - start < 4
