"""Surge and dive decide: pages without marks and names, implied end tags, furniture names in articles, windows by brute force."""

import random
import re
import time

import pytest

from evalloom.llm import html_extraction as H

LONG = "Here is an article text that is long enough to be one of its own, more than eighty characters of it."


def pages(spark, size):
    return [r.html for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").select("html").collect() if r.html]


def test_pages_keep_their_text_without_marks_and_names(spark):
    """Article and main become plain containers, and all classes, ids and roles go: at least 96 of 100 pages give the same text."""
    own = pages(spark, "sf0.01")
    bare = [re.sub(r'\s(?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:article|main)\b", r"<\1div", p)) for p in own]
    same = sum(H.extract_main_text(p) == H.extract_main_text(q) for p, q in zip(own, bare, strict=True))
    assert same >= 0.96 * len(own)


@pytest.mark.parametrize(
    "html",
    [
        f"<p class='notice'>Ad.<p>{LONG}",
        f"<ul><li class='share'>Share<li>{LONG}</ul>",
        f"<table><tr><td class='side'>Menu<td>{LONG}</table>",
        f"<table><tr class='ads'><td>Ad<tr><td>{LONG}</table>",
        f"<dl><dt class='promo'>Ad<dd>{LONG}</dl>",
        f"<article><section class='legal'><p>{LONG}</p></section></article>",
        f"<article><div id='search'><p>{LONG}</p></div></article>",
        f"<ul><li><ul><li class='menu'>in</ul><li>{LONG}</ul>",
        f"<div hidden><p>not<p>shown</div><p>{LONG}",
        f"<article><p>{LONG}</p><div class='share'>Share this</div></article>",
    ],
)
def test_furniture_ends_where_it_ends(html):
    assert H.extract_main_text(html) == LONG


def test_bare_text_counts_where_there_is_no_other():
    assert H.extract_main_text(f"<div>{LONG}</div><div><a href='x'>Menu of links and links</a></div>") == LONG
    assert H.extract_main_text(f"<div>Ad of one sentence.</div><p>{LONG}</p><div>&copy; someone</div>") == LONG


def test_windows_by_brute_force():
    r = random.Random(5)
    for _ in range(500):
        own = [float(r.choice([0, 0, 10, 30, 50, 90])) for _ in range(r.randrange(1, 25))]
        back = r.choice([0, 2])
        surges = [i for i in range(len(own)) if sum(own[i : i + 3]) >= 80 and own[i]]
        dives = [i for i in range(len(own)) if not sum(own[i : i + 3])]
        want, at = set(), 0
        while True:
            start = next((i for i in surges if i >= at), None)
            if start is None:
                break
            end = next((i for i in dives if i > start), len(own))
            first = start
            while first > 0 and start - first < back and own[first - 1]:
                first -= 1
            want |= {i for i in range(first, end) if own[i]}
            at = end + 1
        assert [i for i, k in enumerate(H.regions(own, 3, 80, back)) if k] == sorted(want)


@pytest.mark.parametrize("part", ["<div>x", "<p><b>x", "<ul><li>x", "<table><tr><td>x"])
def test_pages_of_many_open_elements_take_linear_time(part):
    began = time.process_time()
    H.extract_main_text(part * 100_000)
    assert time.process_time() - began < 8
