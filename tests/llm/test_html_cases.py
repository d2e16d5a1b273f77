"""Linked text of an article, cells that tell what they are, deep pages, and the job over a table of pages."""

import time

import pytest

pytest.importorskip("tallyforge.llm")

from tallyforge.llm import html  # noqa: E402

LONG = "This is the text of the page and it goes on for long enough to be taken for what it is by its words alone, here and there."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h2>Sources</h2><ul><li><a href="x">The bridge report of 2024</a></li><li><a>Reuters</a></li></ul><p>Words of the article.</p></article>', "Sources\nThe bridge report of 2024\nReuters\nWords of the article."),
        ("<main><p><a>By Jane Doe</a></p><p>Words here.</p><p><a>Read it in full</a></p></main>", "By Jane Doe\nWords here.\nRead it in full"),
        (f'<nav><a>Home</a></nav><article><p>{LONG}</p><ul class="share-links"><li><a>Post this</a></li></ul></article>', LONG),
        (f'<table><tr><td class="sidebar">Words at the side</td><td>{LONG}</td></tr></table>', LONG),
        (f'<table><tr><td class="nav"><a>Home</a><td>{LONG}<tr><td class="footer">Below</table>', LONG),
        ("<article><table><tr><th>a</th><td>b</td></tr><tr><td>c<table><tr><td>d</td></tr></table></td><td>e</td></tr></table></article>", "a b\nc\nd\ne"),
        ('<table><tr><td class="content"><p>Short.</p><table><tr><td>1</td><td>2</td></tr></table>More.</td></tr></table>', "Short.\n1 2\nMore."),
    ],
)
def test_what_is_kept(page, text):
    assert html.main_text(page) == text


def test_time_grows_with_the_page():
    pages = lambda n: ["<div>" * n + "x", "<div class=nav>x" * n, f"<article><p>{LONG}</p>" * n, "<div>" * n + "<td>x" * n, "</div>" * n, "<table><tr><td class=ad>x" * n]
    took = []
    for n in (4000, 16000):
        start = time.process_time()
        for p in pages(n):
            html.main_text(p)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.5


def test_a_table_of_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, f"<p>{LONG}</p>"), (3, None, f"<p>{LONG}</p>"), (None, "u", f"<p>{LONG}\n <b>ß</b>&amp;</p>"), (4, "u", f"<article>{'<p>a b</p>' * 40_000}</article>"), (5, "u", "<nav><a>x</a></nav>")]
    pages = spark.createDataFrame([(*r, 7, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string").repartition(3)
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html.extract_text(pages).collect()}
    long = "\n".join(["a b"] * 40_000)
    assert got == {(1, "u", "", 0), (2, "u", "", 0), (3, None, LONG, len(LONG)), (None, "u", f"{LONG} ß&", len(LONG) + 3), (4, "u", long, len(long)), (5, "u", "", 0)}
    assert html.extract_text(pages).count() == len(rows)
    assert html.extract_text(pages.limit(0)).count() == 0
