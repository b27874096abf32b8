"""Main text of pages whose wrappers carry hints, and of pages that nest without end."""

import time

import pytest

from graphselect.llm import html_density

TEXT = "A sentence of the article that goes on for some time, and then ends here. " * 4
WRAPPERS = ['div class="content has-sidebar"', 'div class="post menu-open"', 'div id="page" class="nav-open"', 'div class="wrapper has-sidebar"', 'div class="content-sidebar-wrap"', 'div class="site header-fixed"', 'div class="post comments-open"', "form"]


@pytest.mark.parametrize("inner", ["article", "div"])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_with_hints_stay(wrapper, inner):
    page = f'<body><{wrapper}><{inner}><div class="entry-header"><h1>Title</h1></div><p>{TEXT}</p><p>{TEXT}</p></{inner}><div class="sidebar"><p>Beside it.</p></div></{wrapper.split()[0]}></body>'
    assert html_density.extract(page) == "\n".join(["Title", TEXT.strip(), TEXT.strip()])


def test_articles_among_comments_are_no_wrappers_mark():
    page = f'<body><article><p>{TEXT}</p></article><div id="comments"><article class="comment"><p>Nice post!</p></article></div></body>'
    assert html_density.extract(page) == TEXT.strip()


def test_sparse_sibling_does_not_end_the_growth():
    parts = [f"<div>{''.join(f'<p>{c * 300}</p>' for _ in range(5))}</div>" for c in "ab"]
    links = "<ul>" + '<li><a href="x">tenletters</a>' * 6 + "</ul>"
    want = "\n".join([*["a" * 300] * 5, *["b" * 300] * 5])
    assert html_density.extract(f"<body>{parts[0]}{links}{parts[1]}</body>") == want


def test_links_of_an_article_stay():
    links = "<ul>" + '<li><a href="x">A reference</a>' * 3 + "</ul>"
    assert html_density.extract(f"<body><article><p>{TEXT}</p><p>{TEXT}</p>{links}</article></body>").endswith("\n".join(["A reference"] * 3))


def test_headers_of_pages_go_and_those_of_articles_stay():
    assert html_density.extract(f"<body><header>My Site Slogan Home</header><p>{TEXT}</p></body>") == TEXT.strip()
    for inner in ("<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div class="site"><section>{}</section></div>'):
        body = inner.format(f"<header><h1>Title</h1></header><p>{TEXT}</p><p>{TEXT}</p>")
        assert html_density.extract(f'<body><header class="site-header"><h1>Site</h1><p>Slogan</p></header>{body}</body>') == "\n".join(["Title", TEXT.strip(), TEXT.strip()])
    for named in ("article-header", "post-header", "entry-header"):
        assert html_density.extract(f'<body><article><div class="{named}"><h1>Title</h1></div><p>{TEXT}</p></article></body>') == "Title\n" + TEXT.strip()


def test_hinted_paragraphs_of_an_article():
    page = f'<body><article><p>{TEXT}</p><p class="related">Part of the text.</p><p class="advert">Buy it!</p><div class="related"><a href="x">Other</a></div></article></body>'
    assert html_density.extract(page) == TEXT.strip() + "\nPart of the text."


def test_nothing_is_dropped_within_an_article():
    short = "".join(f"<p>{w}</p>" for w in ("Sh is.", "Of.", "x"))
    table = "<table><tr><td>a</td><td>b</td></tr></table><pre>one\n  two</pre><blockquote>Said.</blockquote><figure><figcaption>Shown.</figcaption></figure>"
    assert html_density.extract(f"<body><article><p>{TEXT}</p>{short}{table}</article></body>") == "\n".join([TEXT.strip(), "Sh is.", "Of.", "x", "a", "b", "one two", "Said.", "Shown."])


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "deep", "<span>" * 100_000 + "<p>deep" * 100_000, "<b>" * 100_000 + "</i>" * 100_000 + "deep", "<b><div>" + "<span>" * 50_000 + "</b>" * 100_000 + "deep", "<ul><li>deep" * 50_000])
def test_time_grows_with_the_page_only(page):
    start = time.perf_counter()
    assert html_density.extract(page).startswith("deep")
    assert time.perf_counter() - start < 20
