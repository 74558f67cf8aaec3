"""Main-text extraction: markup that would make a careless reader quadratic, layouts, and awkward rows."""

import time

import pytest

from webloom.llm import html_density

HOSTILE = {
    "tags that never end": "<a " * 60_000,
    "end tags without start": "<b>" * 20_000 + "</i>" * 20_000,
    "end tags out of scope": "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000,
    "quotes around ends": '<a b=">"' * 20_000,
    "open quotes": "<a b='>x" * 20_000,
    "paragraphs in open inline tags": "<b><p>x" * 20_000,
    "open brackets": "<" * 200_000,
    "declarations": "<!" * 100_000,
    "half ends of scripts": "<script>" + "</script" * 50_000,
    "list items": "<ul>" + "<li><b>" * 20_000,
    "cells": "<table>" + "<tr><td>" * 20_000,
    "comments": "<!--" * 50_000,
    "deep": "<div>" * 50_000 + "x",
    "attributes": "<div " + "id " * 100_000 + ">x",
    "names": "<div class='" + "sidebar " * 50_000 + "'>x",
    "weak marks": "<form><div class=has-sidebar>x " * 10_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_text(name):
    began = time.perf_counter()
    html_density.main_text(HOSTILE[name])
    assert time.perf_counter() - began < 5


PROSE = [f"Sentence {k} of the article says enough, with commas, to look like running prose of a page." for k in range(8)]


def body(kind: str) -> tuple[str, list[str]]:
    """(markup, blocks) of an article in one of several shapes."""
    p = "".join(f"<p>{x}</p>" for x in PROSE)
    if kind == "table":
        return f"{p}<table><tr><td>Cell one has words.<td>Cell two has words.</table>", [*PROSE, "Cell one has words.", "Cell two has words."]
    if kind == "list":
        return f"{p}<ul><li>First point of many.<li>Second point of many.</ul>", [*PROSE, "First point of many.", "Second point of many."]
    if kind == "quote":
        return f"{p}<blockquote>{PROSE[0]}</blockquote>", [*PROSE, PROSE[0]]
    if kind == "links":
        return p.replace("article", "<a href=/x>article</a>"), PROSE
    return p, PROSE


@pytest.mark.parametrize("kind", ["plain", "table", "list", "quote", "links"])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><section>{}</section></main>", "<div id=content><div class=post>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "{}"])
def test_layouts_without_a_tag_that_decides(kind, wrap):
    inner, blocks = body(kind)
    nav = "<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>"
    foot = "<footer>All rights reserved by the owner of this page.</footer>"
    assert html_density.main_text(f"<html><body>{nav}{wrap.format(inner)}{foot}</body></html>").split("\n") == blocks


def test_an_article_tag_alone_decides_nothing():
    p = "".join(f"<p>{x}</p>" for x in PROSE)
    page = f"<body><div><article><a href=/a>Teaser one</a></article><article><a href=/b>Teaser two</a></article></div><div>{p}</div></body>"
    assert html_density.main_text(page).split("\n")[-8:] == PROSE


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, None, "<p>a</p>", 1, "t"), (1, "u", None, 2, "t"), (1, "u", "<p>a</p>", 2, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_density.extract(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "", 0), (1, "u", "a", 1), (None, None, "a", 1)]
