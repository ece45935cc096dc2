import re
from html import unescape

import duckdb
import pytest

from ragmill.llm import extraction
from tests import oracle

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("plain text", "plain text"),
    ("<body><article><p>One &amp; two&nbsp;&#8364; three<p>Four</article></body>", "One & two € three\nFour"),
    ("<body><nav><a href=/>Home</a></nav><article><h1>Head</h1><p>a<br>b  c</p></article><footer>f</footer>", "Head\na b c"),
    (
        '<body><div id="page"><div class="sidebar"><a href=1>x</a></div><div class="text"><p>First long paragraph of this page, really.'
        '</p><ul><li>one<li>two</ul><p>Second long paragraph of this page, really.</p></div><div class="comments"><p>nice, very nice'
        "</p></div></div><form><p>enter</p></form>",
        "First long paragraph of this page, really.\none\ntwo\nSecond long paragraph of this page, really.",
    ),
    ('<article><div class="ad">Buy</div><p>Text</p><script>var a="</p>";</script><style>p{}</style><!-- c --><aside>s</aside></article>', "Text"),
    ("<article><p><b>Bold<br><p>next <i>it</i>alic</article>", "Bold\nnext italic"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
    ("</div></p><article></b>stray</article></article>", "stray"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_main_text(html, text):
    assert extraction.main_text(html) == text


UNCLOSED = [
    ("<html><head><title>t</title><body><article><p>Text</article>", "Text"),
    ("<html><head><title>t</title><meta charset=x><div><p>Text</div></html>", "Text"),
    ("<head><script>var a</script><noscript><img src=x></noscript> Text <b>bold</b>", "Text bold"),
    ("<html><head><title>t</title></head><body><article><p>Text</article>", "Text"),
    ("<body><div><nav><a href=1>Home</a></div><article><p>Text</article>", "Text"),
    ("<body><div><form><p>enter</div><article><p>Text</article>", "Text"),
    ("<body><div><header><ul><li>x</div><article><p>Text</article>", "Text"),
    ('<body><article><section><div class="ad">Buy</section><p>Text</article>', "Text"),
    ('<article><ul><li class="ad">Buy<ul><li>b</li></ul> c<li>Text</ul></article>', "Text"),
    ('<article><p class="ad">Buy<p>Text</article>', "Text"),
    ("<article><ul><li>a<nav><ul><li>x</li><li>y</ul></nav>b</ul></article>", "a b"),
    ('<article><b>a<div class="ad">x</b>y</div></b>c</article>', "a c"),
]


@pytest.mark.parametrize("html,text", UNCLOSED)
def test_unclosed_unwanted_parts(html, text):
    assert extraction.main_text(html) == text


BODY = "".join(f"<p>Paragraph {w} of the article runs on for a good while, as paragraphs do, and says something.</p>" for w in ("one", "two", "three"))
TEXT = "\n".join(f"Paragraph {w} of the article runs on for a good while, as paragraphs do, and says something." for w in ("one", "two", "three"))
NAV = '<nav><a href="/">Home</a><a href="/b">Blog</a></nav>'
READER = "<div class='c'><p>A reader writes a long remark about all of this and goes on and on, longer than the article itself is.</p></div>"
TEMPLATES = [
    f'<body><div class="layout no-sidebar">{NAV}<article>{BODY}</article></div></body>',
    f'<body class="has-menu comments-open"><div class="has-menu"><main>{BODY}</main></div></body>',
    f'<body><div class="side-by-side"><article>{BODY}</article></div></body>',
    f'<body><div class="post comments-open"><article>{BODY}</article></div></body>',
    f'<body><div class="page sidebar-right"><div class="content"><article>{BODY}</article></div><div class="sidebar"><p>About me and my site</p></div></div></body>',
    f'<body><div id="sidebar-layout"><main>{BODY}</main><aside>x</aside></div></body>',
    f'<body><div class="menu"><article>{BODY}</article></div></body>',
    f'<body><div class="widget-area"><div class="navigation-wrapper"><main><div>{BODY}</div></main></div></div></body>',
    f'<body><article>{BODY}</article><section id="reader-discussion">{READER * 6}</section></body>',
    f'<body><article>{BODY}<section class="comments">{READER * 6}</section></article></body>',
    f'<body><article>{BODY}</article><section id="comments">{"".join(f"<article>{READER}</article>" for _ in range(5))}</section></body>',
    f'<body><article>{BODY}</article>{"".join(f"<article class=comment>{READER}</article>" for _ in range(5))}</body>',
    f'<body><article>{BODY}<div class="related"><a href=1>More</a></div><div id="shareBar" class="socialLinks">Share</div></article></body>',
    f'<body><div class="wrapper with-sidebar"><div id="main">{BODY}</div><div id="sidebar"><ul><li><a href=1>Link one</a></ul></div></div></body>',
    f'<body>{NAV}<div class="promotion-page">{BODY}</div><div class="cookie-consent"><p>We use cookies</p></div></body>',
    f'<body><div class="social"><div class="text">{BODY}</div></div><div class="newsletter"><p>Join us</p></div></body>',
    f'<body><div class="single-sidebar" id="content"><div class="entry">{BODY}</div></div><div class="commentlist">{READER}</div></body>',
    f'<body><header class="site"><h1>Site</h1></header><div id="page"><div class="banner">Sale</div><div>{BODY}</div></div><footer>f</footer></body>',
    f'<body><main><div class="alert">Read this first</div>{BODY}<div class="pagination"><a href=2>2</a></div></main></body>',
    f'<body><div id="nav-menu"><ul><li><a href=1>a</a><li><a href=2>b</a></ul></div><article class="post related-enabled">{BODY}</article></body>',
    f'<body><article id="comment-policy">{BODY}</article></body>',
    f'<body><article>{BODY}<footer>By me</footer></article><div class="ad ad-top">Buy</div></body>',
]


@pytest.mark.parametrize("html", TEMPLATES)
def test_names_of_wrappers_and_parts(html):
    assert extraction.main_text(html) == TEXT


def test_articles_keep_their_heading_labels_and_formulas():
    page = f'<body><article><header><h1>Title</h1><p>By someone</p></header>{BODY}<p>So <label>this</label> <math><mi>x</mi></math> holds</p></article></body>'
    assert extraction.main_text(page) == f"Title\nBy someone\n{TEXT}\nSo this x holds"
    page = f'<body><article><header><a href=1>Home</a></header>{BODY}</article></body>'
    assert extraction.main_text(page) == TEXT


@pytest.mark.parametrize(
    "value,name",
    [
        ("sidebar", "part"), ("no-sidebar", ""), ("left-sidebar", "part"), ("comments-open", ""), ("CommentList", "readers"), ("adSlot", "part"),
        ("badge heading", ""), ("post-header", ""), ("shadow", ""), ("a b c menu", "part"), ("", ""), ("x-1 2", ""), ("reader-discussion", "readers"),
    ],
)
def test_names(value, name):
    assert extraction.name_of("div", [("class", value)]) == name == extraction.name_of("div", [("id", value)])


LONG = "A long paragraph of running text that goes on and on, as paragraphs of a page do. " * 4


def test_short_parts_beside_a_dense_section():
    page = (
        f'<body><div><h2>Head</h2>Own text, <a href=1>linked</a> inside.<br>More<div class="text"><p>{LONG}</p><p>{LONG}</p></div>'
        '<ul><li>one</li><li>two</li></ul><div><a href=2>Next page here</a> <a href=3>Previous page</a></div>Last words</div></body>'
    )
    text = LONG.strip()
    assert extraction.main_text(page).split("\n") == ["Head", "Own text, linked inside. More", text, text, "one", "two", "Last words"]


def reference(html):
    """The pages of the given tables hold one article of headings and paragraphs."""
    article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = (re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{oracle.DEFAULT_DIR}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extract(pages).collect()}
    rows = duckdb.sql(f"select page_id, html from '{oracle.DEFAULT_DIR}/pages.parquet'").fetchall()
    assert got == {i: (reference(h), len(reference(h))) for i, h in rows}


def test_rows(spark):
    rows = [(1, "u", CASES[5][0], "x"), (1, "u", CASES[5][0], "x"), (None, None, None, "x"), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in extraction.extract(pages).collect()) == [(0, 0), (1, 22), (1, 22), (2, 0)]
    assert extraction.extract(pages.limit(0)).count() == 0


def test_density_prefers_text_to_links():
    tree = extraction.Tree("<body><div><a href=1>link one</a><a href=2>link two</a></div><div><p>some longer running text</p></div></body>")
    nodes = extraction._measure(tree.root)
    body = next(n for n in nodes if n.tag == "body")
    links, text = (n for n in nodes if n.tag == "div")
    assert extraction.density(text, body) > extraction.density(links, body)
