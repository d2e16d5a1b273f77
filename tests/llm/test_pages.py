"""Pages of different makes, marked by hand: what is the article, and what isn't. No Spark."""

import time

import pytest

pytest.importorskip("tallyforge.llm")

from tallyforge.llm.html import main_text  # noqa: E402

A = "The council met on Monday to discuss the new bridge over the river and heard from three engineers."
B = "Most of the members agreed that the plan would cost more than expected, but nobody wanted to wait."
C = "A vote is expected next week after the finance committee has seen the final figures for the work."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"
READER = "I have lived here for thirty years and I think that this bridge is a complete waste of our money."

PAGES = {
    "semantic": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><main><article><h1>Bridge</h1><p>{A}</p><p>{B}</p></article></main><aside><p>{C}</p></aside><footer><p>&copy; 2020 All rights reserved</p></footer></body></html>", f"Bridge\n{A}\n{B}"),
    "divs": (f"<body><div id=header>{MENU}</div><div class='post-content'><h2>Bridge</h2><div>{A}</div><div>{B}<br><br>{C}</div></div><div class=sidebar><p>Subscribe to our newsletter for more news every day</p></div></body>", f"Bridge\n{A}\n{B}\n{C}"),
    "bare": (f"<p>{A}<p>{B}<p>{C}", f"{A}\n{B}\n{C}"),
    "comments": (f"<article><p>{A}</p><p>{B}</p></article><section id=comments><h3>2 comments</h3><p>{READER}</p></section>", f"{A}\n{B}"),
    "state classes": (f"<body class='has-sidebar no-comments'><div class='content tags'><p>{A}</p><p>{B}</p></div></body>", f"{A}\n{B}"),
    "custom elements": (f"<video-player src=x></video-player><article><p>{A}</p><title-block>Aside</title-block><p>{B}</p></article>", None),
    "self closing": (f"<article><svg class=i /><p>{A}</p><p>{B}</p></article>", f"{A}\n{B}"),
    "formulas": (f"<article><p>{A} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {B}</p><object>{C}</object></article>", f"{A} x=2 {B}\n{C}"),
    "scripts": (f"<article><p>{A}</p><script>if (a < b && c > \"d) {{ x('</p>') }}</script><p>{B}</p></article>", f"{A}\n{B}"),
    "entities": (f"<article><p>{A.replace('new', 'n&eacute;w')}</p><p>1 &lt; 2 &amp; {B}</p></article>", f"{A.replace('new', 'néw')}\n1 < 2 & {B}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    got = main_text(page)
    assert got == want if want is not None else A in got and B in got


@pytest.mark.parametrize("part", ["<a ", "<script ", "</script ", "<title>", '<a "', "<a '\"", "<!-- ", '<a "<b>', "\"><a '"])
def test_broken_tags_take_linear_time(part):
    for page in (part * 60_000, "<p>x</p>" + part * 60_000 + ">"):
        start = time.time()
        main_text(page)
        assert time.time() - start < 10


def test_ends_inside_things():
    for tail in ("<p", "<p class='", "<!-- x", "<script>x", "<textarea>x", "</"):
        assert main_text(f"<article><p>{A}</p><p>{B}</p>{tail}").startswith(f"{A}\n{B}")
