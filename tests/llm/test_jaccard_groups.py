"""Large groups compared node by node, and rows that share an id but not the text."""

import random

import pytest

from millrace.llm import jaccard

SCHEMA = "doc_id bigint, text string, lang string"


def _truth(texts):
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in texts.items()}
    links = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    reach = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        reach[i] = min(seen)
    return links, reach


def _chain(n, step, length, first=0):
    """Texts of which neighbours share all but ``step`` words."""
    return {first + i: " ".join(f"w{k}" for k in range(i * step, i * step + length)) for i in range(n)}


@pytest.mark.parametrize("step", [9])
def test_chain_compared_by_nodes_equals_brute_force(spark, step):
    texts = _chain(200, step, 84)
    base = [f"b{k}" for k in range(100)]
    rng = random.Random(1)
    for i in range(60):  # a tight group beside the chain
        copy = list(base)
        for k in rng.sample(range(100), 3):
            copy[k] = f"x{i}"
        texts[1000 + i] = " ".join(copy)
    links, reach = _truth(texts)
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], SCHEMA).repartition(4)
    got = jaccard.join(docs, block=8).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == {i: (len(links[i]), reach[i]) for i in texts}


def test_copies_sent_for_a_chain_grow_with_its_length(spark):
    sent = {}
    for n in (400, 1600):
        classes = spark.createDataFrame(
            [(i, [str(k).encode() + b"x" + str((i + k) // 4).encode() for k in range(4)]) for i in range(n)], "class_id bigint, prefixes array<binary>"
        )
        nodes = classes.selectExpr("class_id", "posexplode(prefixes) as (tree, prefix)")
        shared = nodes.groupBy("tree", "prefix").agg(jaccard.F.min("class_id").alias("b"), jaccard.F.count("*").alias("n")).where("n > 1")
        groups = classes.selectExpr("class_id as node", "0L as component")
        dealt = jaccard.deal(nodes, shared, groups, 16)
        assert dealt.where("tree < 0").count() == 0
        sent[n] = dealt.count()
    assert sent[400] <= 4 * 400 and sent[1600] <= 4 * 1600


def test_a_tight_large_group_is_compared_as_a_whole(spark):
    nodes = spark.range(100).selectExpr("id as class_id", "explode(sequence(0, 31)) as tree", "cast('p' as binary) as prefix")
    shared = nodes.groupBy("tree", "prefix").agg(jaccard.F.min("class_id").alias("b"), jaccard.F.count("*").alias("n"))
    dealt = jaccard.deal(nodes, shared, spark.range(100).selectExpr("id as node", "0L as component"), 16)
    assert dealt.select("tree").distinct().collect() == [(-1,)] and dealt.count() == 100 * 7


def test_rows_of_one_id_with_other_texts(spark):
    texts = _chain(2, 3, 60)
    lone = " ".join(f"q{k}" for k in range(60))
    rows = [(0, texts[0], "en"), (1, texts[1], "en"), (1, "zz " + lone, "de"), (5, lone, "en"), (5, lone, "en"), (5, lone, "fr"), (7, None, "en"), (7, lone, "en")]
    for seed in range(1):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
        got = {r.doc_id: (r.class_id, r.n_links, r.component_id) for r in jaccard.join(docs).collect()}
        # the smallest text of 1 is the one that is near 0; that of 7 is empty
        assert got == {0: (0, 1, 0), 1: (1, 1, 0), 5: (5, 0, 5), 7: (7, 0, 7)}
        kept = jaccard.keep_one(docs)
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} == {(0, texts[0], "en"), (5, lone, "en"), (7, None, "en")}
