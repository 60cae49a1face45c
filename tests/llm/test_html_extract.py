"""Extraction on small pages, and the defined edge cases."""

import time
from math import e, log

import pytest

from lodekv.llm.html_extract import content, extract, main_text, measure, parse

LONG = "This is a sentence of the article that goes on for a while, with some words in it. " * 4


def page(body, head="<title>t</title><script>var t='</p><article>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


MENU = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news about contact".split()) + "</ul></nav>"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("<", "<"),
        ("plain &amp; text", "plain & text"),
        (page(MENU), ""),
        (page(f"{MENU}<article><h1>A &lt;b&gt;</h1><p>{LONG}</p><p>x  \n y&nbsp;z</p></article><footer>foot</footer>"), f"A <b>\n{LONG.strip()}\nx y z"),
        (page(f"<article><h1>T</h1><p><b>{LONG}<br><p>two<p>three</article><footer>&copy;"), f"T\n{LONG.strip()}\ntwo\nthree"),
        (page(f"<div class='ad'>Buy {LONG}</div><div id=main><p>{LONG}</p><p>more <i>in</i>line<br>text</p></div>"), f"{LONG.strip()}\nmore inline text"),
        (page(f"<div><p>{LONG}</p></div><section class='post-comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section>"), LONG.strip()),
        (page(f"<!-- c --><article><p>{LONG}</p><form><p>{LONG}</p></form><aside>{LONG}</aside><p>end</p></article>"), f"{LONG.strip()}\nend"),
        (page(f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>"), f"{LONG.strip()}\none\ntwo\na\nb\nc"),
        (page(f"<article><p>{LONG}</p><!-- open"), LONG.strip()),
        (page(f"<article><p>{LONG} <a href='x>y'>link</a>.</p></article>"), f"{LONG.strip()} link."),
        (f"</div></p><p>{LONG}</i></p>", LONG.strip()),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


def test_long_and_deep_pages():
    assert main_text("<div>" * 5000 + LONG + "</div>" * 5000) == LONG.strip()
    assert main_text(page("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")).count("\n") == 2999
    assert main_text("<a b='" * 2000) is not None


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>hi</p>", 5), (1, "<p>hi</p>", 5), (2, None, 5)], "page_id long, html string, n_chars int")
    out = extract(df)
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted(map(tuple, out.select("page_id", "text", "n_chars").collect())) == [(1, "hi", 2), (1, "hi", 2), (2, "", 0)]
    assert extract(df.limit(0)).collect() == []


PARAGRAPH = "This paragraph has about a hundred characters of plain text, as the paragraphs of an article often do."
TWENTY = f"<div>{f'<p>{PARAGRAPH}</p>' * 20}</div>"
BODY = "\n".join([PARAGRAPH] * 20)


@pytest.mark.parametrize(
    "html, want",
    [
        (page(f"<article><header><h1>A title of the page</h1></header>{TWENTY}</article>"), f"A title of the page\n{BODY}"),
        (page(f"{MENU}<main><section><h2>One</h2><p>Short.</p></section><section><h2>Two</h2>{TWENTY}</section></main>"), f"One\nShort.\nTwo\n{BODY}"),
        (page(f"<div><div><h1>Title</h1></div>{TWENTY}<div><p>Short end.</p></div></div><div><a href=a>more news</a> <a href=b>archive</a></div>"), f"Title\n{BODY}\nShort end."),
        (page(f"<article><p>First post.</p></article><article>{TWENTY}</article>"), f"First post.\n{BODY}"),
        (page(f"<div class='content has-sidebar'><article><p>{LONG}</p></article><div class=sidebar><p>side</p></div></div>"), LONG.strip()),
        (page(f"<div class='content has-sidebar'><article><p>{LONG}</p></article><div class=comments><article><p>{LONG * 3}</p></article></div></div>"), LONG.strip()),
        (page(f"<div class='page no-sidebar'><div><p>{LONG}</p></div></div>"), LONG.strip()),
    ],
)
def test_nested_pages(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("name", ["search-results", "related", "share-prices", "social-history", "footer-notes"])
def test_a_word_of_a_class_does_not_drop_running_text(name):
    assert main_text(page(f"<article><p>{LONG}</p><p class='{name}'>{PARAGRAPH}</p></article>")) == f"{LONG.strip()}\n{PARAGRAPH}"
    assert main_text(page(f"<article><p>{LONG}</p><div id='{name}'><p>{PARAGRAPH}</p><p>{LONG}</p></div></article>")) == f"{LONG.strip()}\n{PARAGRAPH}\n{LONG.strip()}"


@pytest.mark.parametrize("name", ["ad", "advert-box", "cookie-notice", "reader-comments", "comments", "newsletter", "sidebar_right", "promo", "adSlot top"])
def test_names_of_boilerplate_do_inside_an_article(name):
    assert main_text(page(f"<article><p>{LONG}</p><div class='{name}'><p>{PARAGRAPH}</p></div></article>")) == LONG.strip()


def test_short_or_linked_blocks_with_a_weak_name_go():
    links = "".join(f"<a href={i}>another article of this site</a> " for i in range(6))
    for block in ("<div class=share>Share this</div>", f"<div class=related>{links}</div>", f"<ul class='related-links'><li>{links}</ul>"):
        assert main_text(page(f"<article><p>{LONG}</p>{block}</article>")) == LONG.strip()


N = 60_000
HOSTILE = {
    "unclosed tags": "<a " * N,
    "unclosed quotes": "<a '" * N,
    "quotes that end nowhere": "<a " + "\" > \" ' > ' " * N + "\"",
    "tags inside quotes": "<a \"<a >\" " * N + "\"",
    "nested": "<div>" * N,
    "nested within an open paragraph": "<p><button>" + "<div>" * N,
    "spans and blocks": "<p>" + "<span><div>" * N,
    "stray ends": "<b>" * N + "</i></table></li>" * N,
    "list items": "<ul><li>" * N + "<li>" * N,
    "unclosed comments": "<!-- " * N,
    "declarations": "<! " * N,
    "classes": "<p class='" * N,
    "raw": "<script>" * N + "</script" * N,
    "cells": "<table><tr><td>" * (N // 3),
    "entities": "&" * N + "&amp" * N,
}


@pytest.mark.parametrize("shape", HOSTILE)
def test_hostile_pages_take_linear_time(shape):
    start = time.process_time()
    assert main_text(HOSTILE[shape]) is not None
    assert time.process_time() - start < 8


def test_density_against_the_formulas():
    """Densities, sums and the core of a page, recomputed by recursion."""
    links = "<div><a href=a>one link</a> <a href=b>another</a> and text</div>"
    root = parse(page(f"<div><div><p>{LONG}</p><p>short <a href=c>link</a></p></div>{links}</div><div><p>{PARAGRAPH}<br>{PARAGRAPH}</p></div>"))
    order = measure(root)
    kids = lambda x: [y for y in x.items if type(y) is not str and not y.boiler]

    def counts(x, linked=False):
        linked = linked or x.name == "a"
        own = sum(len(" ".join(y.split())) for y in x.items if type(y) is str)
        chars, tags, link_chars, link_tags = own, 0, own if linked else 0, 0
        for y in kids(x):
            c, t, lc, lt = counts(y, linked)
            chars, tags, link_chars, link_tags = chars + c, tags + t + (y.name not in ("br", "img")), link_chars + lc, link_tags + lt + (y.name == "a")
        return chars, tags, link_chars, link_tags

    whole = counts(root)

    def density(x, linked):
        c, t, lc, lt = counts(x, linked)
        if not c:
            return 0.0
        t1, lc1, lt1 = max(1, t), max(1, lc), max(1, lt)
        base = log(c / max(1, c - lc) * lc1 + max(1, whole[2]) / max(1, whole[0]) * c + e)
        return c / t1 * max(0.0, log(c / lc1 * t1 / lt1)) / log(base)

    def walk(x, linked=False):
        linked = linked or x.name == "a"
        inner = [walk(y, linked) for y in kids(x)]
        mine = density(x, linked)
        assert x.density == pytest.approx(mine) and x.total == pytest.approx(sum(inner) if inner else mine)
        return mine

    walk(root)
    core = max(order, key=lambda x: x.total)
    assert core.name == "div" and PARAGRAPH not in str(core.items) and content(root)
