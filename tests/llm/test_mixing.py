"""Balanced sampling: targets against plain sharing, the flight against its constraints."""

import random
import re
from collections import Counter

import pytest

from millrace.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, pi int, times int"


def shared(sizes, weights, most):
    """Targets by sharing again what lies above a limit, until nothing does."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        out = [most * s if i in capped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and out[i] > most * s}
        if not over:
            return out
        capped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    some = lambda n: " ".join("w" for _ in range(n))
    out = [(i, some(int(rng.lognormvariate(3, 1))), "hot", "x", 1, 1) for i in range(3000)]
    out += [(i, some(rng.randint(0, 40)), rng.choice(["a", "b", "é", "", None]), "x", None, 1) for i in range(3000, 3400)]
    out += [(9, "same words", "copies", "x", 1, 1)] * 5001 + [(10, "a b　c d\x0b\x1fe", "copies", "x", 1, 1)]
    out += [(11, some(2), "tiny", "x", 1, 1), (12, some(90_000), "long", "x", 1, 1)]
    return out + [(None, "no id", "hot", "x", 1, 1), (None, None, "void", "x", 1, 1), (13, "\t\n ", "void", "x", 1, 1)]


def test_targets_and_totals(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs.repartition(3), chunk=100).collect()
    assert sorted(((r["doc_id"], r["size"], r["source"]) for r in got), key=repr) == sorted(((r[0], words(r[1]), r[2]) for r in rows), key=repr)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    size, taken, docs_taken, n = Counter(), Counter(), Counter(), Counter(r[2] for r in rows)
    target = {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        docs_taken[r["source"]] += r["times"] if r["size"] else 0
        target[r["source"]] = r["target"]
        assert r["taken"] == r["times"] * r["size"] <= 3 * r["size"]
    want = shared([size[s] for s in names], [i % 3 + 1 for i in range(len(names))], 3)
    for name, t in zip(names, want):
        assert target[name] == pytest.approx(t) and all(r["source_size"] == size[name] for r in got if r["source"] == name)
        if n[name] > 30:
            assert abs(taken[name] - t) <= 5, name
            ratio, full = t / size[name], sum(1 for r in rows if r[2] == name and words(r[1]))
            assert abs(docs_taken[name] - ratio * full) <= 8, name
    # copies of a row differ by one repeat at most
    same = {r["times"] for r in got if r["doc_id"] == 9 and r["source"] == "copies"}
    assert max(same) - min(same) <= 1
    other = mixing.mix(docs.repartition(11), chunk=100).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, other))
    assert sorted(map(repr, mixing.mix(docs, chunk=100, seed=1).collect())) != sorted(map(repr, got))


def test_flight_keeps_totals_and_probabilities():
    rng = random.Random(1)
    values = [(rng.randint(1, 500), 1.0, rng.random()) for _ in range(40)]
    pi = [rng.random() for _ in values]
    hits, runs = [0.0] * 40, 3000
    for k in range(runs):
        out = mixing.flight(values, pi, random.Random(k))
        assert sum(0 < p < 1 for p in out) <= 3 and all(0 <= p <= 1 for p in out)
        for j in range(3):
            assert sum(v[j] * p for v, p in zip(values, out)) == pytest.approx(sum(v[j] * p for v, p in zip(values, pi)), abs=1e-5)
        hits = [h + p for h, p in zip(hits, out)]
    assert max(abs(h / runs - p) for h, p in zip(hits, pi)) < 0.04


def test_flight_with_equal_sizes_and_nulls_in_the_matrix():
    for values in ([(5, 1.0)] * 9, [(0, 1.0)] * 9, [(0, 0)] * 9, [(1, 2), (2, 4), (3, 6), (5, 1)]):
        pi = [0.3] * len(values)
        out = mixing.flight(values, pi, random.Random(2))
        assert sum(0 < p < 1 for p in out) <= 2
        assert sum(v[0] * p for v, p in zip(values, out)) == pytest.approx(sum(v[0] * 0.3 for v in values))
    for n in (1, 2, 3, 5):
        columns = [tuple(random.Random(n * 10 + c).randint(0, 3) for _ in range(n)) for c in range(n + 1)]
        u = mixing.null_vector(columns)
        assert any(u) and all(abs(sum(c[j] * x for c, x in zip(columns, u))) < 1e-9 for j in range(n))


def test_landing_is_near_the_best_rounding():
    rng = random.Random(4)
    for _ in range(30):
        size, pi = [rng.randint(1, 60) for _ in range(12)], [rng.random() for _ in range(12)]
        want = sum(s * p for s, p in zip(size, pi))
        best = min(abs(sum(s for i, s in enumerate(size) if k >> i & 1) - want) for k in range(1 << 12))
        assert abs(sum(s * p for s, p in zip(size, mixing.landing(size, pi))) - want) <= best + 1.5


def test_empty_and_without_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, "", "s", None, None, None), (2, None, None, None, None, None)], SCHEMA)).collect()
    assert {(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
