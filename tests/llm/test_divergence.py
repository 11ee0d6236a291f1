"""Divergences of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int, count int"
S = divergence.SCALE


def expected(rows, min_docs=3, top=200):
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        sources[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, names in sources.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        v, p = len(kept), {}
        whole = Counter()
        for s in names:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + S * (c[t] + 1) // (sum(c[t] for t in kept) + v) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in names}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in names:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = ["w" + "abcdefghij"[i % 10] * (i // 10 % 7 + 1) + "xyz"[i % 3] * (i // 70) for i in range(500)] + ["Straße", "éa", "Éa", "İ", "a1b", "naïve", "漢字", "x_y"]
    some = lambda k: " ".join(rng.choice(vocabulary[k % 50 :]) for _ in range(rng.randint(0, 120)))
    out = [(i, some(i), rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s%d" % (i % 9), "hot", None]), "x", 1, 1) for i in range(500)]
    out += [out[7]] * 5  # repeated rows are documents of their own
    out += [(900, "rare words only", "fr", "s1", "x", 1, 1), (901, "", "fr", "s2", "x", 1, 1), (902, None, "it", "s1", None, None, None)]
    out += [(903, "Tie tie TIE " * 3 + "\x00\x1f 12 -- ", "tt", s, "x", 1, 1) for s in ("a", "b", "é", "B")]
    return out + [(904, "long Text, " * 200_000, "en", "s1", "x", 1, 1)]


def test_equals_plain_counting(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for cells in (divergence.CELLS, 700):
        got = sorted(tuple(r) for r in divergence.audit(docs, cells=cells).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == expected(rows)
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=1, top=3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == expected(rows, 1, 3)


def test_blocks_of_many_sources(spark):
    rows = [(i, "common " + "abc"[i % 3] * (1 + i % 5), "en", "s%03d" % i, "x", 1, 1) for i in range(divergence.BLOCK + 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == expected(rows)


def test_partial_counts_flush_and_merge(monkeypatch, rows):
    table = pa.table({"lang": [r[2] or "" for r in rows], "source": [r[3] or "" for r in rows], "text": [r[1] or "" for r in rows]})
    whole = Counter()
    for size, flush in ((1 << 22, 1 << 19), (2000, 300)):
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        monkeypatch.setattr(divergence, "FLUSH_ROWS", flush)
        sums = Counter()
        for b in divergence._counting(iter(table.to_batches(100))):
            for r in b.to_pylist():
                sums[r["lang"], r["source"], r["term"], "count"] += r["count"]
                sums[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        assert not whole or sums == whole
        whole = sums


def test_counts_beyond_64_bits_of_product():
    count = np.array([[5, 10**15], [0, 7]], dtype=np.int64)
    n = np.array([[5, 10**15 + 7]], dtype=np.int64)
    assert divergence.shares(count, n, 2).tolist() == [[1 + S * (c + 1) // (m + 2) for c, m in zip(row, n[0].tolist())] for row in count.tolist()]


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
