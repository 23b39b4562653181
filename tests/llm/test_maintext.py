import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeframe.llm import maintext
from lodeframe.llm.maintext import core, extract, main_text

LONG = "A paragraph with words enough that it counts as text of the page. "
AROUND = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->%s<footer>&copy; 2020</footer></body></html>'
BESIDE = ['<div class="ad">Buy this now, it is cheap and good.</div>', '<div id="cookie-notice"><p>We use cookies, do you mind that at all?</p></div>', "<aside><p>" + LONG + "</p></aside>", '<section class="comments"><article><p>' + LONG + "</p></article></section>", "<form><label>Mail</label><input name=x><button>Go</button></form>", '<ul class="menu"><li>One</li><li>Two</li></ul>', '<div role="navigation">Up</div>', '<header><h2>Site</h2></header>', "<div hidden>no</div>", '<div style="display: none">no</div>', "<noscript><p>no</p></noscript>", '<div class="share-buttons">Share</div>']


@pytest.mark.parametrize("beside", BESIDE)
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="content with-sidebar">%s</div>'])
def test_what_is_beside_the_article_goes(beside, wrap):
    body = f"<h1>Head</h1><p>{LONG}</p><p>Short.</p>{{}}<p>{LONG} &amp; <a href=x>more</a> <b>bold</b></p><p>End.</p>"
    want = f"Head\n{LONG.strip()}\nShort.\n{LONG}& more bold\nEnd."
    if "header" not in beside:  # inside, it is the article's own head
        assert extract(AROUND % (wrap % body.format(beside))) == want
    if "comments" not in beside or "article" in wrap:
        assert extract(AROUND % (beside + wrap % body.format("") + beside)) == want


def test_details():
    assert extract("<article><p>a&nbsp;\n b&lt;c&gt;&#233;&eacute</p><p> </p><pre>x\n y</pre></article>") == "a b<c>éé\nx y"
    assert extract("<article><p><b>one<br><p>two</p>three") == "one\ntwo\nthree"
    assert extract('<div class="ad">never closed <article><p>text</article>') == "text"
    assert extract("<article><header><h1>Title</h1></header><p>x</p><footer>by me</footer></article>") == "Title\nx"
    assert extract("just text, a < b & c") == "just text, a < b & c"
    assert extract('<p title="a > b">x</p>') == "x"
    for nothing in (None, "", "   ", "<html></html>", "<script>x", "<!-- x", "<nav>x</nav>"):
        assert extract(nothing) == ""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>"])
@pytest.mark.parametrize("open_, close", [("<div class='elementor-widget elementor-widget-text-editor'>", "</div>"), ("<section id='discussion'>", "</section>"), ("<section id='related-work'>", "</section>"), ('<div title="hidden gems">', "</div>"), ("<div data-x='a class=ad'>", "</div>"), ("<div class=wp-ad-free>", "</div>")])
def test_what_names_only_resemble_stays(wrap, open_, close):
    page = AROUND % (wrap % f"{open_}<p>{LONG}</p><p>{LONG}</p>{close}")
    assert extract(page) == f"{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("head", ["<h2 id='search'>Search</h2>", "<h2><span class='mw-headline' id='Discussion'>Search</span></h2>", "<h2 class='comments'>Search</h2>", "<p title='hidden gems'>Search</p>", "<p title='role=alert class=ad'>Search</p>"])
def test_headings_and_quoted_values_stay(head):
    assert extract(AROUND % f"<article><p>{LONG}</p>{head}<p>{LONG}</p></article>") == f"{LONG.strip()}\nSearch\n{LONG.strip()}"


def test_the_outermost_article_is_kept():
    inner = f"<h1>Head</h1><article><p>{LONG}</p><article><p>Quoted.</p></article><p>{LONG}</p></article><p>End.</p>"
    want = f"Head\n{LONG.strip()}\nQuoted.\n{LONG.strip()}\nEnd."
    assert extract(AROUND % f"<main>{inner}</main>") == extract(AROUND % f"<article>{inner}</article>") == want
    assert extract(f"<table><tr><td itemprop=articleBody><p>{LONG}<td>beside</table>") == LONG.strip()


def test_regions():
    assert core([5, 5, 80, 90, 2, 70, 3, 3, 3, 3, 60]) == (2, 6)
    assert core([]) == (0, 0) and core([0, 0]) == (0, 2) and core([4]) == (0, 1)
    assert core([90, 0, 0, 0, 90]) == (0, 1)  # the first of equals


def plain_region(x, window=3, surge=60, edge=25):
    """The region line by line: windows that reach the surge, joined where they follow one another."""
    sums = [sum(x[i : i + window]) for i in range(len(x))]
    if not x or not max(sums):
        return 0, len(x)
    surge, regions, start = min(surge, max(sums)), [], None
    for i in range(len(x) + 1):
        high = i < len(x) and sums[i] >= surge
        if high and start is None:
            start = i
        elif not high and start is not None:
            regions.append((start, min(len(x), i - 1 + window)))
            start = None
    a, b = max(regions, key=lambda r: (sum(x[r[0] : r[1]]), -r[0]))
    keep = [i for i in range(a, b) if x[i] >= min(edge, max(x[a:b]))]
    return keep[0], keep[-1] + 1


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 10, 24, 25, 30, 59, 60, 200]), max_size=25))
def test_regions_equal_a_plain_version(x):
    assert core(x) == plain_region(x)


@pytest.mark.parametrize("block", ["<section id='discussion'><p>%s</p></section>", "<p class='market-share'>%s</p>", "<p><math><mi>%s</mi></math></p>", "<fieldset><p>%s</p></fieldset>"])
def test_elements_of_an_article_stay(block):
    page = AROUND % f"<article><p>{LONG}</p>{block % 'Some words.'}<p>{LONG}</p></article>"
    assert extract(page) == f"{LONG.strip()}\nSome words.\n{LONG.strip()}"


@pytest.mark.parametrize("marks", [True, False])
def test_surge_and_dive_decide(spark, monkeypatch, marks):
    """Without any class or id word, and without article elements too, the region alone gives the text of most pages."""
    monkeypatch.setattr(maintext, "AWAY", set())
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    right = 0
    for p in pages:
        inside = re.search(r"<article>(.*)</article>", p, re.S)[1]
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1|br|b)>", inside)) if x)
        right += extract(p if marks else re.sub("<(/?)article>", r"<\1div>", p)) == want
    assert right >= 0.95 * len(pages)


def test_a_page_of_bare_lines():
    assert extract(f"<body><div>Intro.</div><div>{LONG}<br>Short.<br>{LONG}</div><div>End.</div></body>") == f"Intro.\n{LONG.strip()}\nShort.\n{LONG.strip()}\nEnd."


def test_without_marks_of_an_article_text_between_surge_and_dive_stays():
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(12))
    page = f"<body><ul>{links}</ul><table><tr><td><p>{LONG}</p><p>{LONG}</p><p>x</p></td></tr></table><ul>{links}</ul></body>"
    assert extract(page) == f"{LONG.strip()}\n{LONG.strip()}\nx"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<", ">", "&", "&am", '"', "'", "<!--", "-->", "<a href=x>", "</a>", "<script>", "</script>", "text ", "<br/>", "<p a='", "</", "<li>", "<title>"]), max_size=25).map("".join))
def test_any_markup_ends(page):
    assert isinstance(extract(page), str)


def test_very_long_pages():
    page = AROUND % ("<article>" + f"<p>{LONG}</p>" * 20_000 + "<" * 20_000 + '<p x="' * 2000 + "</article>")
    assert extract(page).count(LONG.strip()) == 20_000


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r for r in main_text(pages).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        want = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1|br|b)>", inside)]
        r = rows[p.page_id]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text) and r.url == p.url


def test_rows(spark):
    kind = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "x", 1), (None, None, "<p>y", None, None), (1, "u", None, "x", 1)]
    got = sorted((tuple(r) for r in main_text(spark.createDataFrame(rows, kind)).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (None, None, "y", 1), (1, "u", "", 0)], key=repr)
    assert main_text(spark.createDataFrame([], kind)).collect() == []
