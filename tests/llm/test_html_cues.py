"""Pages whose wrappers, attributes and markup must not cost them their main text, and a scan by brute force."""

import random
import time

import pytest

op3 = pytest.importorskip("codeloom.llm.op03_html_text")

TEXT = " ".join(f"Sentence {i} of the story says a thing." for i in range(12))
BODY = f"<h1>Two words</h1><p>{TEXT}</p><p>The end.</p>"
WHOLE = f"Two words {TEXT} The end."
NAV = "<nav><a href=/>Home</a> <a href=/a>All about us</a></nav>"
FOOT = "<footer>&copy; the owners of this site, all rights reserved</footer>"


@pytest.mark.parametrize(
    "main",
    [
        f"<article style='overflow:hidden'>{BODY}</article>",
        f"<article data-id='comments'>{BODY}</article>",
        f"<article class='share-prices'>{BODY}</article>",
        f"<form id='aspnetForm'><article>{BODY}</article></form>",
        f"<form id='aspnetForm'><div>{BODY}</div></form>",
        f"<form id='aspnetForm'>{NAV}<div>{BODY}</div><p class='cookie'>We use cookies</p></form>",
        f"<div title=don't><article>{BODY}</article></div>",
        f"<article data-x='a > b' title=\"it's\">{BODY}</article>",
        f"<div class='wrapper site'><main role='main'>{BODY}</main></div>",
        f"<article><header>{BODY[:18]}</header><section>{BODY[18:]}</section></article>",
        f"<article>{BODY[:18]}<section><p>{TEXT}</p></section><section><p>The end.</p></section></article>",
        f"<div class=post>{BODY}</div><div class=comments>" + "<p>Great story, thank you!</p>" * 9 + "</div>",
        f"<article>{BODY}<svg><text>No</text></svg><map-view></map-view></article><select><option>One</select>",
        f"<div class='sidebar left'><p>Words at the side of it</p></div><div class='left'>{BODY}</div>",
        f"<article>{BODY[:18]}<div class='ad'>Buy now</div>{BODY[18:]}<div id='share'>Share it</div></article>",
        f"<div hidden><p>{TEXT}</p></div><div>{BODY}</div>",
        f"<article>{BODY}<ol class='commentlist'><li>I liked it very much indeed</li></ol><div class='newsletterbox'>Write to us now</div></article>",
        f"<div class='postbody'>{BODY}</div><div class='sidenav'><p>Some words at the side of the page here</p></div>",
        f"<div class='shareholders'>{BODY}</div>",
    ],
)
def test_the_article_is_the_text(main):
    assert op3.main_text(f"<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body>{NAV}{main}{FOOT}</body></html>") == WHOLE
    assert op3.main_text(f"<head><meta x><style>p{{}}</style><body>{NAV}{main}{FOOT}") == WHOLE


def test_best_run_is_the_best_of_all_runs():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.25, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        every = [(sum(scores[a : b + 1]), a, b) for a in range(len(scores)) for b in range(a, len(scores))]
        best, first, last = op3.best_sum(scores)
        assert best == max([0.0, *(e[0] for e in every)])
        if best:
            assert (best, first, last) in every
        else:
            assert (first, last) == (0, -1)


@pytest.mark.parametrize("unit", ["<div>", "<p>", "<div class=ad>", "<svg>", "<!-- ", "<span hidden>", "</div>", "<a href='", "<b x=\"", "&amp;"])
def test_time_is_linear(unit):
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        op3.main_text("<body>" + unit * n + f"<p>{TEXT}</p>")
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (3, "v", "plain words only"), (4, None, "<p>" + "word " * 200_000), (5, "w", "<nav>x</nav>"), (None, "w", "<p>a b c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as `__html`")
    got = sorted(((r["page_id"] or 0), r["url"], r["n_chars"]) for r in op3.extract(frame).collect() if r["url"])
    assert got == [(0, "w", 5), (1, "u", 0), (2, "u", 0), (2, "u", 0), (3, "v", 16), (5, "w", 0)]
    assert op3.extract(frame.limit(0)).count() == 0 and op3.extract(frame).where("page_id = 4 and n_chars = 999999").count() == 1
