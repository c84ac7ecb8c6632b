from __future__ import annotations

import html
import re
import time
from pathlib import Path

import pytest

from worktempo.llm import html_text as h
from worktempo.llm import queries

DATA = Path("/root/testdata/sf0.01")
LONG = "This is a sentence of the article that goes on for a while, with commas and all. "


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<script>x</script>", ""), ("plain", "plain"),
    ("<article><p>a &amp; b&nbsp;c &lt;i&gt; &#8364;&am</p></article>", "a & b c <i> €&am"),
    ("<article><p>one<br>two</p><p>  three\n four </p></article>", "one two three four"),
    ("<article>in<b>si</b>de <i>x</i></article>", "inside x"),
    ("<nav>menu</nav><article><h1>T</h1>x</article><footer>f</footer>", "T x"),
    ("<article>a<script>if (1 < 2) '</p>'</script>b<style>p{}</style><!-- c --></article>", "ab"),
    ("<article>a<aside>no</aside><div class='ad'>no<div>no</div></div><form>no</form>b</article>", "a b"),
    ("<article>a</article><section id='comments'><article>reader</article></section>", "a"),
    ("<article>a<div class='cookie-notice'>no</div><div role=navigation>no</div><p hidden>no</p>b</article>", "a b"),
    ("<article><p>unclosed<p>paragraph<ul><li>x<li>y</ul></article>", "unclosed paragraph x y"),
    ("<article>a &lt;b&gt; 1 < 2 <!doctype x></article>", "a <b> 1 < 2"),
    ("<article><p class='ad'>no<p>yes</article>", "yes"),
    ("<main><header><h1>T</h1></header>body</main>", "T body"),
    ("<article>never closed <script>rest", "never closed"),
    ("<html><head><meta charset=x><title>t</title><body><article>head never closed</article>", "head never closed"),
    ("<article>a<svg><text>no</text></svg>b<map>c<script src='x'></script>d</article>", "abcd"),
])
def test_pages(page, text):
    assert h.main_text(page) == text


def test_pages_without_an_article_element():
    page = (f"<div><a href=/>Home</a> <a href=/b>News</a></div><div><p>{LONG * 2}</p><p>Short.</p><p>{LONG * 3}</p></div>"
            f"<ul><li><a href=/c>More</a></li><li><a href=/d>Links</a></li><li><a href=/e>x</a></li><li><a>y</a></li></ul>"
            f"<div class='comments'><p>{LONG * 5}</p></div>")
    assert h.main_text(page) == " ".join([LONG * 2, "Short.", LONG * 3]).replace("  ", " ").strip()


BODY = f"<p>{LONG * 3}</p><p>{LONG * 4}</p>"
BODY_TEXT = " ".join([(LONG * 3).strip(), (LONG * 4).strip()])


@pytest.mark.parametrize("page", [
    f"<div class=post>{BODY}</div><article class=comment><p>{LONG}</p></article><article class=comment>{LONG}</article>",
    f"<div class=post>{BODY}</div><div class=comments><article><p>{LONG}</p></article></div>",
    f"<div class=post>{BODY}</div><ul><li><article class=card><a href=/>Teaser</a></article></ul>",
    *(f"<div class='{c}'>{inner}</div>" for inner in (BODY, f"<article>{BODY}</article>")
      for c in ("layout no-sidebar", "has-sidebar", "with-comments", "social-article", "layout right-sidebar")),
    f"<article class='post has-sidebar social comments-open'>{BODY}</article><div id=comments><article>{BODY * 9}</article></div>",
    f"<div class='layout right-sidebar'><div>{BODY}</div><div class='sidebar-box'><p>{LONG}</p></div></div>",
    f"<div class='sidebar-box'><p>{LONG}</p></div><article><div class='social-article'>{BODY}</div></article>",
])
def test_comments_teasers_and_names_of_wrappers_do_not_take_the_body(page):
    assert h.main_text(page) == BODY_TEXT


@pytest.mark.parametrize("page, text", [
    ("<article><h1><a href=/>Title</a></h1><p>one</p></article>", "Title one"),
    ("<article><p>one</p><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li><li><a>w</a></li></ul></article>", "one x y z w"),
    ("<main><p>one</p><p><a href=/r>Full report</a></p></main>", "one Full report"),
    ("<article><ul><li><a>x</a></li></ul></article><footer>f</footer>", "x"),
    ("<article>one<nav><a>no</a></nav><div class=share><a>no</a></div><p><a>yes</a></p></article><p><a>out</a></p>", "one yes"),
    (f"<div><p>{LONG * 2}</p><p><a href=/r>Full report</a></p><div class=ad><a>no</a></div><p>{LONG * 2}</p></div>",
     f"{LONG * 2}Full report {LONG * 2}".strip()),
])
def test_links_of_the_text_are_kept(page, text):
    assert h.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    ("<article><p title=don't>Text one is here and long.</p><p>It's more text of article</p><p>End of the article.</p></article>",
     "Text one is here and long. It's more text of article End of the article."),
    ("<article><p class=\"a>b\" title='x>y'>one</p><p data-x=\"never closed>two</p></article>", "one two"),
    ("<article><p>one</p><section class=discussion><p>two</p></section><p class=related>three</p><div class=related><a>no</a></div></article>",
     "one two three"),
    (f"<div><p>{LONG * 2}</p><ul><li><a>a</a></li><li><a>b</a></li><li><a>c</a></li><li><a>d</a></li></ul><p>Closing.</p></div>",
     f"{LONG * 2}a b c d Closing."),
    (f"<ul><li><a>x</a></li></ul><h2>Short heading</h2><p>First.</p><p>{LONG * 2}</p><p>{LONG}</p>",
     f"Short heading First. {LONG * 3}".strip()),
    (f"<article><p>{LONG}</p></article><p>{LONG}</p>", LONG.strip()),
    ("one </ two> <? three> </>four", "one four"),
])
def test_quotes_subjects_and_text_outside_articles(page, text):
    assert h.main_text(page) == text


def surges(page):
    lines, named, spans, holding = h.page_lines(page)
    return h.distributed(h.judged(lines, named, holding), [0] * len(lines))


def test_surge_and_dive():
    page = f"<ul><li><a>m</a></li></ul><p>short</p><p>{LONG * 2}</p><p>tail</p>" + "<p><a>x</a></p>" * 4 + f"<p>{LONG * 2}</p>"
    assert surges(page) == [0, 1, 1, 1, 0, 0, 0, 0, 2] or surges(page) == [0, 1, 1, 1, 0, 0, 2, 2, 2]


@pytest.mark.parametrize("piece", ["<svg>", "<p \"<b ", "<div class=sidebar>line", "<b></i>", "<a b=\"x>y ", "<!-- ", "<script>",
                                   "<a b='x\" c>", f"<div class=sidebar-box>{LONG}", "<p><", "</", "<svg></p>"])
def test_twice_the_page_takes_twice_the_time(piece):
    def seconds(n):
        begin = time.process_time()
        h.main_text(piece * n)
        return time.process_time() - begin

    seconds(2000)
    assert min(seconds(40_000) for _ in range(2)) < 3.2 * min(seconds(20_000) for _ in range(2)) + 0.2


def test_many_comments_take_no_square_time():
    page = f"<div class=post>{BODY}</div>" + "<div class=comment-body><p>I agree.</p></div>" * 30_000
    assert h.main_text(page) == BODY_TEXT


def test_long_pages_are_whole():
    page = "<article>" + "".join(f"<p>{LONG}{n}</p>" for n in range(20_000)) + "</article>"
    assert h.main_text(page).endswith("19999") and h.main_text(page).count(LONG.strip()) == 20_000


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_table(spark):
    """These pages hold one article of simple blocks."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}

    def plain(page):
        inside = re.search("<article>(.*)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", inside))
        return " ".join(filter(None, blocks))

    got = {r.page_id: (r.text, r.n_chars) for r in queries.op3_html_text(spark, str(DATA)).collect()}
    assert got == {k: (plain(p), len(plain(p))) for k, p in pages.items()}


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("container", ["<div>", ""])
def test_whole_table_without_article_elements(spark, container):
    """The line blocks alone find the same text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    close = container.replace("<", "</")
    same = sum(h.main_text(p) == h.main_text(p.replace("<article>", container).replace("</article>", close)) for p in pages)
    assert same >= 0.99 * len(pages)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a</p>", None), (2, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, found string")
    got = [(r.page_id, r.text, r.n_chars) for r in h.extract(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (1, "", 0), (None, "a", 1), (2, "", 0)], key=str)
    assert h.extract(pages.where("false")).count() == 0
