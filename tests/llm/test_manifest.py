"""The Merkle manifest against whole trees held in memory."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, pos int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        n = levels[-1]
        levels.append([H(*n[i : i + 8]) for i in range(0, len(n), 8)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i - i % 8
        out.append((level[run:i], level[i + 1 : run + 8]))
        i //= 8
    return out


def expected(rows):
    leaf = lambda r, text: H(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    lower = str.maketrans(manifest.UPPER, manifest.LOWER)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = tree([leaf(r, r[1]) for r in by[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            beside = path(trees[lang], i) + path(top, k)
            node = leaf(r, r[1])
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, r[1].translate(lower))
            for a, b in beside:
                node = H(*a, node, *b)
            root = top[-1][0]
            out.append((r[0], trees[lang][0][i], trees[lang][-1][0], root, H(*(x for a, b in beside for x in a + b)), node, node == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i * 7 % 1201, rng.choice(["Abc", "abc", "", None, "é İ Z" * 5, "x" * 100_000 if i == 5 else "Q"]), "en", "s", i, "x", 1) for i in range(1201)]
    out += [(i, "T%d" % i, rng.choice(["de", "", None, "fr"]), None, None, None, None) for i in range(90)]
    out += [(4, "same", "hot", "s", 1, "x", 1)] * 1100  # equal rows over several subtrees
    out += [(None, "No id", "en", "s", 1, None, None), (None, None, "en", None, None, None, None), (4, "Same id", "hot", "s", 1, "x", 1)]
    return out + [(1, "lone", "it", "s", 1, "x", 1)]


def test_proofs_equal_whole_trees(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in manifest.audit(docs, manifest.every_third()).collect()), key=repr)
    assert got == expected(rows)
    changed = [r for r in rows if r[0] is not None and r[1] and r[1].lower() != r[1] and zlib.crc32(str(r[0]).encode()) % 3 == 0]
    assert sum(not r[-1] for r in got) == len(changed) > 50


def test_layers_are_every_third_level(spark, rows):
    found = manifest.build(spark.createDataFrame(rows, SCHEMA))
    sizes = [layer.agg(F.sum("copies")).first()[0] for layer in found.layers]
    langs = Counter(r[2] for r in rows)
    assert sizes[:2] == [len(rows), sum(-(-n // 512) for n in langs.values())]
    assert sizes[-1] == found.subroots.count() == 7 and found.root.count() == 1


def test_wanted_documents_alone(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = manifest.build(docs)
    root = found.root.first()["root"]
    some = manifest.proofs(found, spark.createDataFrame([(0,), (600,), (9999,)], "doc_id bigint"))
    got = some.select("doc_id", manifest.folded("leaf").alias("root"), "pos").collect()
    assert {r["doc_id"] for r in got} == {0, 600} and all(r["root"] == root for r in got)
    assert len(got) == sum(r[0] in (0, 600) for r in rows)


def test_empty_and_single(spark):
    assert manifest.audit(spark.createDataFrame([], SCHEMA), manifest.every_third()).count() == 0
    one = [(5, None, None, None, None, None, None)]
    got = manifest.audit(spark.createDataFrame(one, SCHEMA), manifest.every_third()).collect()
    assert [tuple(r) for r in got] == expected(one) and got[0]["leaf"] == got[0]["root"]
