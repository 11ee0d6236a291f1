"""Broken and hostile markup: run time in proportion to the page, references, wrappers."""

import time

import pytest

from millrace.llm import html

N = 200_000


@pytest.mark.parametrize("page", [
    "<a " * N, "<div class=\"" * N, "<!" * N, "<a '" * N + ">", "<p>x" + "</b>" * N, "<div class='sidebar'>" * N + "text", "<b>" * N + "<div>t</div>" * N,
    "<div>" * N + "deep text" + "</div>" * N, "<div class='" + "c" * 1_000_000 + "'>" + "<p>t" * 1000, "&" * N, "<" * N, "<svg" * N, "<li>" * N,
    "<article>" + "<i>" * N + "words</article>", "<!--" * N, "< " * N + ">",
])
def test_time_grows_with_the_page(page):
    started = time.perf_counter()
    tokens = html.read(page)
    path = html.main_path([tokens], [(p, "") for k, p, *_ in tokens if k == "tag"])
    html.main_text(tokens, path, frozenset())
    assert time.perf_counter() - started < 20


def text_of(page):
    tokens = html.read(page)
    return html.main_text(tokens, html.main_path([tokens], [(p, "") for k, p, *_ in tokens if k == "tag"]), frozenset())


def test_a_reference_ends_with_its_tag():
    assert text_of("<article><p>a &<b>lt;</b> c &lt; d</p></article>") == "a &lt; c < d"


def test_open_quotes_and_tags_lose_no_text():
    assert text_of("<article><p title=\"open>first</p><p>second</p></article>") == "first\nsecond"
    assert text_of("<article><p title='a > b'>kept</p></article>") == "kept"
    assert text_of("<article><p>a < b and <c") == "a < b and <c"


def test_wrappers_inside_wrappers():
    inner = "<p>" + "word " * 50 + "</p>"
    assert text_of("<body>" + "<div class='sidebar'>" * 300 + inner + "</div>" * 300 + "</body>").startswith("word word")
    assert text_of("<body><div class='content'>" + inner + "</div><div class='sidebar'><p>gone</p></div></body>") == ("word " * 50).strip()
