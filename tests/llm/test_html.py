import html
import re
import time

import duckdb
import pytest

from sparloom.llm import html_text as h


def test_tree_on_held_out_pages():
    right = total = 0
    for page, keep in h.labelled_table(150, seed=77):
        found = h.blocks(page)
        assert len(found) == len(keep)
        for row, y in zip(h.features(found), keep, strict=True):
            right += h.decide(h.tree(), row) == y
            total += 1
    assert right / total > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad --><div class="ad">buy this now please</div>
<article><h1>A &amp; B&nbsp;c</h1><p><b>First   line
here.<br><p>Second <i>par</i>t &lt;x&gt; &#233;.</p><ul><li>item one</li><li>item two</li></ul><p> </p><div class="comments"><p>I disagree with it all</p></div></article>
<footer>&copy; someone</footer>"""


def test_article_text():
    assert h.main_text(PAGE) == "A & B c\nFirst line here.\nSecond part <x> é.\nitem one\nitem two"
    assert h.main_text(None) == h.main_text("") == h.main_text("<p>") == ""
    assert h.main_text("<article><p>cut off &am").startswith("cut off")
    long = "<article>" + "<p>word word word</p>" * 20000 + "</article>"
    assert h.main_text(long).count("\n") == 19999


BODY = "<h1>The title</h1><p>" + "plain word " * 30 + "</p><p>Short one.</p>"
TEXT = "The title\n" + ("plain word " * 30).strip() + "\nShort one."


@pytest.mark.parametrize(
    "around",
    [
        '<article class="overflow-hidden">%s</article>',
        '<article aria-hidden="false">%s</article>',
        '<div class="layout has-sidebar"><article>%s</article></div>',
        '<article class="post comments-open">%s</article>',
        '<article id="how-to-share-files">%s</article>',
        '<form action="/"><article>%s</article></form>',
        '<div id="page-with-menu-and-ads"><main><div class="row">%s</div></main></div>',
        '<div class="widget"><main>%s</main></div>',
        "<div>%s</div>",
        "<table><tr><td>%s</td></tr></table>",
        '<div class="post-body">%s</div>',
        '<article data-x="a>b">%s</article>',
        "<article title=it's>%s</article>",
    ],
)
def test_hand_made_pages(around):
    """Pages by hand, with what is no article before, in and after it."""
    links = " ".join(f'<a href="/{i}">go to page {i}</a>' for i in range(60))
    page = f"<body><header><p>The site</p></header><nav>{links}</nav>{around % BODY}<footer><p>All rights reserved</p></footer></body>"
    assert h.main_text(page) == TEXT
    bare = f"<body><div>{links}</div><div>{links}</div>{around % BODY}<div>{links}</div></body>"
    assert h.main_text(bare) == TEXT
    more = '<section class="comments"><article><p>I think that this is all wrong and should go</p></article></section><div class="cookie-notice">We use some</div><div hidden>not to be seen at all</div>'
    assert h.main_text(page.replace("<footer>", more + "<footer>")) == TEXT


def _features_used(node):
    return {h.FEATURES[node.feature]} | _features_used(node.low) | _features_used(node.high) if node.feature >= 0 else set()


def test_the_tree_splits_by_neighbours():
    assert {"words", "density", "words before", "words after", "density before", "density after"} <= _features_used(h.tree())


LONG = ("plain word " * 20).strip()
MENU = "<ul>" + "".join(f'<li><a href="/{i}">page {i}</a></li>' for i in range(8)) + "</ul>"
LINKS = "<div>" + " ".join(f'<a href="/{i}">go to page {i}</a>' for i in range(30)) + "</div>"


@pytest.mark.parametrize(
    "page, text",
    [
        # names that hold a telling word by chance
        (f'<body><nav>{LINKS}</nav><div class="search-results-guide"><h2>Head</h2><p>{LONG}</p></div><footer>x</footer></body>', f"Head\n{LONG}"),
        (f'<body>{LINKS}<div id="share-economy"><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div></body>', f"Head\n{LONG}\n{LONG}"),
        # links in a short line of an article
        (f'<body>{MENU}<div><h1>Title of it</h1><p>five words stand here and <a href="/x">three linked words</a></p><p>{LONG}</p></div>{MENU}</body>', f"Title of it\nfive words stand here and three linked words\n{LONG}"),
        # a line between menus
        (f"<body><div><h1>Title</h1><p>{LONG}</p></div>{MENU}<div>Copyright 2024</div>{MENU}</body>", f"Title\n{LONG}"),
        (f"<body>{LINKS}<div>Copyright 2024</div>{LINKS}<div><h1>T</h1><p>{LONG}</p></div></body>", f"T\n{LONG}"),
        # comments that nothing but a heading tells
        (f"<body><div><h1>Title</h1><p>{LONG}</p></div><h3>Comments</h3><div><p>{LONG}</p></div><div><p>{LONG} more</p></div></body>", f"Title\n{LONG}"),
        (f"<body><article><h1>Title</h1><p>{LONG}</p><h3>3 Comments</h3><div><p>{LONG}</p></div></article></body>", f"Title\n{LONG}"),
        (f'<body><div><h2>Title</h2><p>{LONG}</p></div><section class="comments"><article><p>{LONG}</p></article></section></body>', f"Title\n{LONG}"),
        # headings that hold a telling word among others
        (f"<body><div><h1>Title</h1><p>{LONG}</p><h2>Share of the vote</h2><p>{LONG}</p><h2>The end</h2><p>{LONG}</p></div></body>", f"Title\n{LONG}\nShare of the vote\n{LONG}\nThe end\n{LONG}"),
    ],
)
def test_pages_that_need_their_neighbours(page, text):
    assert h.main_text(page) == text


@pytest.mark.parametrize("part", ["<form><article>", "<section><h1>", "<article>", "<main>", "<section><h1>x</h1>", "<div class='a-b'><p>x</p>"])
def test_time_follows_the_nesting(part):
    took = []
    for n in (16_000, 64_000):
        began = time.thread_time()
        h.main_text(part * n)
        took.append(time.thread_time() - began)
    assert took[1] < 10 * max(took[0], 0.2)  # sixteen times it would be, if it grew with the square


def test_given_pages_equal_a_plain_reading():
    """The driver's pages, read by a few substitutions instead of a parser and a tree."""
    con = duckdb.connect()
    for page, *_ in con.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|ul|li)>", article))
        assert h.main_text(page) == "\n".join(x for x in parts if x)


@pytest.mark.parametrize("part", ["<script ", "<script>", "<!-- ", '<a x="', '<a "', "<p title='", "<textarea>", "<div>", "</div><div>", "<![CDATA[", "<? ", "<a href=", "</p ", "<b>x", "&amp", "<", "</"])
def test_time_follows_the_length(part):
    page = "<p>start</p>" + part * ((1 << 20) // len(part))
    for p in (page, page + ">", page + '"></script>-->'):
        began = time.thread_time()
        h.main_text(p)
        assert time.thread_time() - began < 8  # a megabyte; 0.7 s at most where nothing else runs


def test_query_shapes(spark):
    rows = [(1, "u", PAGE, 3), (None, None, None, None), (2, "v", "", 1), (2, "v", "", 1)]
    got = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.n_chars, len(r.text)) for r in got) == sorted([(len(h.main_text(PAGE)),) * 2, (0, 0), (0, 0), (0, 0)])
    assert h.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
