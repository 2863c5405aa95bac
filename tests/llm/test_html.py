import html
import re
import time

import pytest
from clarispan.llm.common import table
from clarispan.llm.html_extraction import extracted, main_text, op11_html_extraction

SF = "/root/testdata/sf0.01"
P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."

LAYOUTS = {
    "divisions": (f'<body><div id="nav-menu"><a href=1>x</a></div><div class="page"><h1>Title &amp; more</h1><div class="wrap"><div class="content"><p>{P}</p><p>{P}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>'
                  f'<p>end</p></div><div class="sidebar">{P}{P}</div></div></div><div class="comments"><h2>Comments</h2><p>{P}</p></div><div id=footer>{P}</div>', ["Title & more", P, P, "one", "two", "a", "b", "end"]),
    "notices and comments": (f'<div class="cookie-consent"><p>{P}</p></div><header><h1>Site</h1></header><main><article><header><h1>T</h1><p>By me</p></header><p>{P}<p>{P}<blockquote>q</blockquote><aside>no</aside>'
                             f'<form><p>{P}</p></form></article><section id="comments"><article class="comment"><p>{P}</p></article></section></main>', ["T", "By me", P, P, "q"]),
    "a form around the page": (f"<form id=f><h1>T</h1><div><p>{P}</p><p>{P}</p></div><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div></form>", ["T", P, P]),
    "no elements": ("just text <b>bold</b>&nbsp;x < y & z<br>line", ["just text bold x < y & z line"]),
    "nothing left": ("<html><body><nav>a</nav><article><h1></h1></article><footer>f</footer>", []),
    "markup that is not markup": ('<article><p>a <!-- x </p> --> b<script>var x="</p><p>no";</script>c</p><style>p{}</style><noscript>off</noscript></article>', ["a b", "c"]),
    "siblings": (f'<div id=a><div class=c1><p>{P}</p><p>{P}</p></div><div class=c1><p>{P}</p></div><div class=links><a href=1>{P}</a></div></div>', [P, P, P]),
    "unclosed": ("<article><p><b>A<br><p>B</p><i>c</p> d</article>", ["A", "B", "c", "d"]),
    "sections": (f'<article><h1>T</h1><section><h2>s1</h2><p>{P}</p></section><section><h2>s2</h2><p>{P}</p></section><div class="article-footer"><p>tags</p></div><div class="reader-comments"><p>{P}</p></div></article>', ["T", "s1", P, "s2", P]),
    "cut inside a comment": (f"<article><p>{P}<!-- unclosed <p>x</p>", [P]),
    "references": ("<p>&am &amp &quo; &eacute;&#233;&#xe9; &copy; &lt;p&gt;</p>", ["&am & &quo; ééé © <p>"]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, blocks = LAYOUTS[name]
    assert main_text(page) == "\n\n".join(blocks)


def test_whole_table_against_the_pages_own_articles(spark):
    """Every page of the table has one article element; cut at its block tags by a pattern, it is the text."""
    for r in op11_html_extraction(spark, SF).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_awkward_pages(spark):
    rows = [(1, "u", None, "x", 5), (2, None, "", "x", None), (None, "u", "<p>a</p>", None, 1), (3, "u", "<p>a</p>", "t", 1), (3, "u", "<p>a</p>", "t", 1), (4, "u", "<p>" + "word, " * 200_000, "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long").repartition(2)
    got = sorted(tuple(r) for r in extracted(pages).collect() if r.page_id != 4 and r.page_id)
    assert got == [(1, "u", "", 0), (2, None, "", 0), (3, "u", "a", 1), (3, "u", "a", 1)]
    assert extracted(pages).where("page_id = 4").first().n_chars == 200_000 * 6 - 1
    assert extracted(pages).where("page_id IS NULL").first().text == "a"
    assert extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<" * 200_000, '<a "' * 100_000, "<!--" * 100_000, "<li>" * 50_000 + "y", "<i><p>" + "<b>" * 50_000 + "</i>" * 50_000, "<table><tr><td>" * 20_000, "<p a='" * 50_000 + '"' * 50_000])
def test_odd_markup_takes_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 20
