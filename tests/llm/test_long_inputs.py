"""Many hits in one text take time in proportion to them; passes of a benchmark stay small."""

import random
import time
from collections import defaultdict

import numpy as np
from pyspark import cloudpickle

from millrace.llm import decontaminate, secrets, toxicity


def test_many_secrets_in_one_text_that_is_not_ascii():
    machine = secrets.compiled()
    piece = "é token=abcdef12 "
    started = time.perf_counter()
    spans = secrets.text_spans(machine, piece * 100_000)
    assert time.perf_counter() - started < 60
    assert len(spans) == 100_000
    assert [(a, b) for a, _, b in spans[::9999]] == [(k * len(piece) + 2, k * len(piece) + len(piece) - 1) for k in range(0, 100_000, 9999)]


def test_places_count_code_points():
    machine, rng = secrets.compiled(), random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["é", "😀", " ", "\ud800", "x", " password: hunter22 ", "AKIA" + "Q" * 16, "0123456789abcdef" * 2]) for _ in range(30))
        data = text.encode("utf-8", "surrogatepass")
        place = lambda at: len(data[:at].decode("utf-8", "surrogatepass"))  # noqa: B023, E731
        assert secrets.text_spans(machine, text) == [(place(a), r, place(b)) for a, r, b in machine.spans(data)]


def _model(weights, exceptions):
    return toxicity.Model(weights=weights, exceptions=exceptions).matcher()


def test_many_excused_hits_in_one_text():
    matcher = _model({" zorg": 1.0, " vex": 2.0}, [" vex sign "])
    started = time.perf_counter()
    total, places = toxicity.weigh(matcher, " zorg vex sign vex x" * 100_000)
    assert time.perf_counter() - started < 20
    assert total == 300_000 and len(places) == 200_000


def test_exceptions_agree_with_all_pairs():
    weights, exceptions = {" ab": 1.0, " abc": 3.0, " b": 2.0, " c d": 1.5}, [" ab b ", " b ", " c d b a ", " d b "]
    matcher, rng = _model(weights, exceptions), random.Random(4)
    for _ in range(300):
        text = " " + " ".join(rng.choice(["ab", "abc", "b", "c", "d", "a"]) for _ in range(rng.randrange(1, 25)))
        padded = text + " "
        best, excused = {}, []
        for at in range(len(padded)):
            for term, weight in weights.items():
                if padded.startswith(term, at) and weight > best.get(at, (0, 0))[0]:
                    best[at] = (weight, at + len(term) - 1)
            excused += [(at, at + len(e) - 1) for e in exceptions if padded.startswith(e, at)]
        want = {(s, e): w for s, (w, e) in best.items() if not any(a <= s and e <= b for a, b in excused)}
        total, places = toxicity.weigh(matcher, text)
        assert set(places) == set(want) and total == sum(want.values())


def test_windows_of_a_pass_are_distinct_and_named():
    rng = random.Random(8)
    items = [(f"i{k % 30}", [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 9))]) for k in range(80)]
    want = defaultdict(set)
    for name, found in items:
        for w in decontaminate.windows(found, 4):
            want[w].add(name)
    plan = decontaminate.phrases(items, 4)
    back = {n: t for t, n in plan.vocabulary.items()}
    got = {}
    for terms, begins, owners in plan.groups:
        for i, row in enumerate(terms.tolist()):
            got[tuple(back[t] for t in row)] = {plan.names[o] for o in owners[begins[i] : begins[i + 1]]}
    assert got == dict(want)
    plan.rarity = np.array([0 if back[n] == b"c" else 5 for n in range(len(back))])
    kept = plan.known()
    assert sum(len(g[0]) for g in kept.groups) == sum(b"c" not in w for w in want) and set(kept.vocabulary) == {b"a", b"b"}


def test_a_pass_is_small_beside_its_text():
    rng = random.Random(2)
    words = [b"w%d" % i for i in range(20_000)]
    items = [(f"item{k}", [rng.choice(words) for _ in range(120)]) for k in range(1500)]
    size = sum(len(w) + 1 for _, found in items for w in found)
    plan = decontaminate.phrases(items)
    assert sum(len(g[0]) for g in plan.groups) == 1500 * 108
    assert len(cloudpickle.dumps(plan)) < 20 * size


def test_an_empty_benchmark_has_no_windows():
    plan = decontaminate.phrases([])
    assert plan.groups == [] and plan.known().groups == []
    assert decontaminate.phrases([("a", [])]).groups == []
