"""A bounded sample of labelled rows must not move the verdicts."""

import random

from millrace.llm import toxicity


def test_verdicts_do_not_depend_on_the_sample(spark):
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "classic", "house", "river"]
    rows, labels = [], []
    for i in range(4000):
        toxic = i % 10 == 0
        body = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        # weak hits: one in a toxic document, and in every fifteenth clean one
        if toxic or i % 15 == 1:
            body[rng.randrange(len(body))] = rng.choice(["zorgling", "vexel"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").cache()
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    # labels without a document are not among the rows that may be learned from
    marks = marks.unionByName(spark.range(10_000, 13_000).selectExpr("id AS doc_id", "1 AS toxic"))
    whole, small = (toxicity.fit(docs, marks, per_class=n) for n in (1_000_000, 600))
    assert abs(whole.prior - 0.1) < 0.02 and small.prior == whole.prior
    a, b = ({r.doc_id: r for r in toxicity.score(docs, m).collect()} for m in (whole, small))
    assert max(abs(a[i].score - b[i].score) for i in a) < 0.15
    assert sum(a[i].predicted != b[i].predicted for i in a) <= 0.002 * len(a)
    assert toxicity.keep_clean(docs, small).count() == sum(r.predicted == 0 for r in b.values())
