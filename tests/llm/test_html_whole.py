"""No article text is lost on pages without article or main elements."""

import random

import pytest

from millrace.llm import html
from tests.llm.test_html_template import texts, words


@pytest.mark.parametrize("opening", ["<div class='layout has-sidebar'>", "<div id='post-with-comments'>", "<div class='comments'>", "<div class='page-search'><div id='notice'>"])
def test_wrappers_with_a_marked_word(spark, opening):
    rng = random.Random(5)
    bodies = [words(rng, 60) for _ in range(3)]
    got = texts(spark, [f"<html><body><nav>Menu</nav>{opening}<p>{b}</p><div class='ad-slot'>Buy</div></div></body></html>" for b in bodies])
    assert [got[k] for k in range(3)] == bodies


def test_sections_of_an_article(spark):
    page = "<article><p>One</p><section id='discussion'><p>Two</p></section><div class='related-work'>Three</div><div class='related-posts'>Four</div></article>"
    assert texts(spark, [page])[0] == "One\nTwo\nThree"


def test_title_and_lead_beside_the_body(spark):
    rng = random.Random(6)
    parts = [(words(rng, 4), words(rng, 9), words(rng, 140), words(rng, 10)) for _ in range(6)]
    pages = [
        f"<html><body><ul class='c1'><li><a href='/'>Home</a></ul><h1>{t}</h1><p class='c2'>{lead}</p><div class='c3'><p>{b}</p></div>"
        f"<div class='c4'><p>{end}</p></div><div class='c5'><a href='/x'>{t}</a></div><div class='c6'>All rights are ours</div></body></html>"
        for t, lead, b, end in parts
    ]
    got = texts(spark, pages)
    assert [got[k] for k in range(6)] == ["\n".join(p) for p in parts]


def test_marked_names():
    marked = lambda name: html._is_marked(f" class='{name}'")[0]
    assert all(map(marked, ("ad", "cookie-notice", "sidebar-left", "post-comments", "x siteFooter")))
    assert not any(map(marked, ("has-sidebar", "post-with-comments", "related-work", "no-ads", "content")))
