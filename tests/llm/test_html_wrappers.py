"""Names of classes against the share of the page's text."""

import pytest

from netsift.llm import html_text
from netsift.llm.html_text import main_text

LONG = " ".join(f"<p>We store the data that you give us and we use it for the purposes of the site, part {i}.</p>" for i in range(8))
ARTICLE = "The river was high in the spring and all of the fields were under water for a week."


def page(*parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


@pytest.mark.parametrize("name", ["cookie-notice", "sidebar", "ad-box", "comments", "newsletter", "widget"])
def test_a_long_block_beside_a_short_article_stays_out(name):
    assert main_text(page(f'<div class="{name}">{LONG}</div>', f'<div id="content"><p>{ARTICLE}</p></div>')) == ARTICLE
    assert main_text(page(f"<article><p>{ARTICLE}</p></article>", f'<div class="{name}"><h2>More</h2><div>{LONG}</div></div>')) == ARTICLE


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "sidebar", "advert"])
def test_a_page_of_nothing_else_is_empty(name):
    assert main_text(page(f'<section class="{name}">{LONG}</section>')) == ""


def test_comments_marked_as_articles_stay_out():
    thread = "".join(f'<article class="comment"><p>I think that this is the best of all the texts on it, {i}.</p></article>' for i in range(9))
    assert main_text(page(f'<div id="comments"><h2>Comments</h2>{thread}</div>')) == ""
    assert main_text(page(f'<div id="content"><p>{ARTICLE}</p></div><div id="comments"><h2>Comments</h2>{thread}</div>')) == ARTICLE


@pytest.mark.parametrize("inner", [f"<article><p>{ARTICLE}</p></article>", f"<main><p>{ARTICLE}</p></main>",
                                   f"<h1>Spring</h1><div><p>{ARTICLE}</p></div>"])
def test_a_wrapper_of_the_article_is_no_hint(inner):
    got = main_text(page('<div class="menu"><a href="/">Home</a></div>', f'<div class="page-sidebar">{inner}</div>'))
    assert got.removeprefix("Spring ") == ARTICLE


def test_empty_table_and_a_very_long_page(spark):
    kind = "page_id bigint, url string, html string, text string, URL int, HTML int"
    assert html_text.extract_text(spark.createDataFrame([], kind)).collect() == []
    many = " ".join(f"<p>{ARTICLE} {i}</p>" for i in range(50_000))
    rows = [(1, "u", page(f"<article>{many}</article>"), None, None, None), (1, None, None, "x", 1, 1), (2, "u", "", None, None, None)]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(spark.createDataFrame(rows, kind)).collect()]
    want = " ".join(f"{ARTICLE} {i}" for i in range(50_000))
    assert got == [(1, "u", want, len(want)), (1, None, "", 0), (2, "u", "", 0)] and len(rows[0][2]) > 4_500_000
