"""Pages whose markup once took the article's text with it."""

import pytest

pytest.importorskip("tallyforge.llm")

from tallyforge.llm import html  # noqa: E402

TEXT = "This is the first sentence of an article that goes on for quite some words, so that nobody takes it for a menu or a label, and then it ends."
ARTICLE = f"<h1>A heading</h1><p>{TEXT}</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<svg class="i"/>{}', "<svg class='i' />{}<svg><text>x</text></svg>", "<datalist><option value=a>An option<option>Other</datalist>{}", "<video-player src=x></video-player>{}", "<title-block>{}</title-block>",
        "<iframe src=x />{}", "<button>Menu{}<button>Share</button>", "<noscript>{}", "<select><option>a<option>b</select>{}", "<svg><svg>x</svg><text>in</text></svg>{}", "<iframe src=a>{}", "<title>T</title>{}<textarea>",
    ],
)
def test_left_out_elements_take_no_more_than_they_hold(page):
    got = html.main_text(f"<html><body>{page.format(ARTICLE)}</body></html>")
    assert TEXT in got and "Other" not in got and "Share" not in got and ">" not in got and "in\n" not in got


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "post tag-social", "search-open", "sidebar-right", "widget2 social", "c-banner-grid"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_layout_classes_around_an_article(name, inner):
    side = '<div class="sidebar"><p>Some blurb of the site that stands in the bar beside each page of it.</p></div><div class="comments"><p>I think this is a comment by some reader.</p></div>'
    assert html.main_text(f'<div class="{name}">{inner.format(ARTICLE)}{side}</div>') == f"A heading\n{TEXT}"
    assert html.main_text(f'<div id="{name}">{inner.format(ARTICLE)}</div>') == f"A heading\n{TEXT}"


def test_a_form_around_the_page():
    assert html.main_text(f'<form id="aspnetForm"><div>{ARTICLE}</div></form>') == f"A heading\n{TEXT}"


def test_what_stands_around_stays_out():
    long = " ".join(["A reader says this and that, and more of it, as readers do."] * 20)
    page = f'<article>{ARTICLE}</article><section class="comment-list"><article class="comment"><p>{long}</p></article></section><div class="main-nav"><p>Here go some words about the site and where to go on it.</p></div><svg><title>t</title></svg>'
    assert html.main_text(page) == f"A heading\n{TEXT}"
