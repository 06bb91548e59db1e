import html
import re
import time

import pyarrow.parquet as pq
import pytest

from graphloom.llm.html_text import extract_pages, main_lines


def text(page):
    return " ".join(main_lines(page))


LONG = "A sentence of the article that is long enough to surge, with some words more. " * 3


def test_furniture_goes_and_blocks_stay():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head &amp; line</h1></header><p>One  <b>bo</b>ld&nbsp;two.<br>Three<p>{LONG}</p><aside>side</aside><p>Hm.</p>
    <form>Name <input></form><div class="ad-slot">Buy</div><section id="comments"><p>{LONG}nice</p></section></article>
    <div id="sidebar"><p>{LONG}</p></div><footer>&copy; x</footer></body></html>"""
    assert text(page) == f"Head & line One bold two. Three {LONG.strip()} Hm."


def test_without_a_named_element_the_distribution_decides():
    page = f"""<body><div><a href=1>Home</a> <a href=2>About us and all the other things</a></div><div class=menu>m</div>
    <div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class="footer">f</div><div>Call now</div></body>"""
    assert text(page) == f"Title {LONG.strip()} Short. {LONG.strip()}"


def test_wrappers_may_bear_the_words_of_furniture():
    page = f"""<body class="comments-open"><div class="layout has-sidebar"><div class="header-wrap"><article class="post"><p>{LONG}</p></article></div>
    <div class="sidebar"><p>{LONG}side</p></div><section id="comments"><article><p>{LONG * 3}reply</p></article></section>
    <div class="related"><article><p>{LONG}teaser</p></article></div><aside><article>{LONG}</article></aside></div></body>"""
    assert text(page) == LONG.strip()
    bare = f"<body><div class='page with-sidebar'><p>{LONG}</p><p>{LONG}</p><div class='sidebar'><p>side</p></div></div></body>"
    assert text(bare) == f"{LONG.strip()} {LONG.strip()}"


@pytest.mark.parametrize("page,expected", [
    ("", ""), ("plain words only", "plain words only"), ("<p>a<p>b", "a b"), ("<script>x", ""), ("<article></article>", ""),
    ("<article><p>1 &lt; 2 &#233;&eacute;</p></article>", "1 < 2 éé"), ("<main><div>x</div></main><p>y</p>", "x"),
    ('<article><p title="a > b">q</p></article>', "q"), ("<article><p>a<!-- <p>no</p> -->b</p></article>", "ab"), ("< 3 and > 2", "< 3 and > 2"),
    ("<article><p>a</p><article class='comment'>c</article></article>", "a"), ("<nav>never closed <p>x", "never closed x"),
])
def test_small_pages(page, expected):
    assert text(page) == expected


def test_long_pages_take_linear_time():
    began = time.time()
    for page in ("<p>" + "word " * 400_000, "<div>" * 60_000 + "x", "<a href='" * 20_000, "<" * 100_000, "&amp;" * 100_000):
        main_lines(page)
    assert time.time() - began < 30


def test_table(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (2, "u", "", 4), (3, "u", "<p>x y", None), (3, "u", "<p>x y", None)], "page_id long, url string, html string, n_chars int")
    got = [tuple(r) for r in extract_pages(pages).orderBy("page_id").collect()]
    assert got == [(1, None, "", 0), (2, "u", "", 0), (3, "u", "x y", 3), (3, "u", "x y", 3)]
    assert extract_pages(pages.limit(0)).count() == 0


def test_fixture_articles():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div|ul|li|br)\b[^>]*>", article)]
        want = " ".join(x for x in blocks if x)
        assert text(page) == want
        # The distribution finds the same text where no tag names it, and where the advert's class says nothing either.
        plain = re.sub(r"(</?)article>", r"\1div>", page)
        assert text(plain) == want and text(plain.replace('class="ad"', 'class="x"')) == want


def test_short_lines_beside_an_advert_stay():
    page = f"""<body><div id=top>Read the news here</div><div class=post><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div class="ad">Buy</div><p>The end.</p></div><div>Call now</div></body>"""
    assert text(page) == f"Title {LONG.strip()} {LONG.strip()} The end."


def test_words_in_the_class_of_a_paragraph_mark_nothing():
    assert text('<article><h1>T</h1><p class="related-work">Body of the text</p></article>') == "T Body of the text"
    assert text(f'<body><div><h2 id="discussion">Discussion</h2><p class="search-results">{LONG}</p></div></body>') == f"Discussion {LONG.strip()}"


def test_a_short_article_beside_a_long_block():
    page = f"<body><article><h1>Short</h1><p>Two words.</p></article><div class='x1'><p>{LONG * 4}</p></div></body>"
    assert text(page) == "Short Two words."
