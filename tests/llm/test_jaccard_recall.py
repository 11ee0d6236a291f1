"""Isolated pairs exactly at the threshold."""

from millrace.llm import jaccard


def test_no_isolated_pair_at_the_threshold_is_missed(spark):
    # 84 common words are 80 n-grams, ten other words are ten n-grams of each text: 80 of 100
    common = lambda k: " ".join(f"c{k}x{i}" for i in range(84))
    rows = [(2 * k + side, common(k) + "".join(f" {name}{k}x{i}" for i in range(10))) for k in range(3000) for side, name in ((0, "a"), (1, "b"))]
    a, b = (set(jaccard.shingles(t).tolist()) for _, t in rows[:2])
    assert len(a & b) / len(a | b) == 0.8
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    assert len(got) == 6000
    assert [r.doc_id for r in got if r.n_links != 1 or r.component_id != r.doc_id // 2 * 2] == []


def test_depth_follows_the_target():
    depth = jaccard.prefix_depth(jaccard.THRESHOLD, jaccard.TREES, jaccard.MAX_DEPTH, jaccard.TARGET_RECALL)
    assert 1 - (1 - jaccard.THRESHOLD**depth) ** jaccard.TREES >= 0.99999
