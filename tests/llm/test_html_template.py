"""Boilerplate without telling names is found by the template alone."""

import random

from millrace.llm import html


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))


def texts(spark, pages, host="http://h.example/"):
    df = spark.createDataFrame([(i, f"{host}{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in html.extract(df).collect()}


def test_boilerplate_with_neutral_names(spark):
    rng = random.Random(3)
    notice, advert, bodies = words(rng, 30), words(rng, 20), [(words(rng, 60), words(rng, 50)) for _ in range(12)]
    pages = [
        f"<html><body><div class='c-17'><ul><li>Home</li><li>Contact us</li></ul></div><div class='c-2'><p>{a}</p>"
        f"<div class='c-9'>{advert} <b>now</b></div><p>{b}</p></div><div class='c-18'><p>{notice}</p></div></body></html>"
        for a, b in bodies
    ]
    pages.append(pages[0])  # a copy of a page does not make its text a template
    got = texts(spark, pages)
    assert [got[i] for i in range(12)] == [f"{a}\n{b}" for a, b in bodies] and got[12] == got[0]


def test_copies_and_articles_keep_their_text(spark):
    rng = random.Random(4)
    a, b = words(rng, 80), words(rng, 60)
    near = texts(spark, [f"<body><div class='x'><p>{a}</p><p>{b}</p><p>visit {k}</p></div></body>" for k in range(5)])
    assert all(near[k] == f"{a}\n{b}\nvisit {k}" for k in range(5))
    same = texts(spark, [f"<body><p>{a}</p><p>{b}</p></body>"] * 3)
    assert set(same.values()) == {f"{a}\n{b}"}
    inside = texts(spark, [f"<body><article><p>Our motto</p><p>{words(rng, 40)}</p></article></body>" for _ in range(4)])
    assert all(t.startswith("Our motto\n") for t in inside.values())
