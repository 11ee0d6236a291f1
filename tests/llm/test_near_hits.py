"""Proximity matches over the stored index against brute force."""

import random
from collections import Counter

from millrace.llm import decontaminate


def test_near_hits(spark):
    rng = random.Random(8)
    every = [[f"w{rng.randint(0, 25)}" for _ in range(rng.randint(0, 60))] for _ in range(60)]
    items = [("one", ["w1", "w2", "w3"]), ("two", ["w4", "w4", "w5"]), ("long", [f"w{k}" for k in range(6, 12)]), ("none", ["w1", "zz"]), ("empty", [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(every)], "doc_id bigint, text string").repartition(3)
    index = decontaminate.build_index(docs, shard_bytes=800)
    count = Counter(t for w in every for t in w)
    for span in (3, 9):
        want = {}
        for name, found in items:
            for k in range(max(1, len(found) - 3) if found else 0):
                terms = list(dict.fromkeys(found[k : k + 4]))
                rare = min(terms, key=lambda t: (count[t], terms.index(t)))
                for i, w in enumerate(every):
                    at = [p for p, t in enumerate(w) if t == rare and all(o in w[max(0, p - span) : p + span + 1] for o in terms)]
                    if at:
                        want.setdefault((i, name), set()).update(at)
        ids = {r.shard: r.ids for r in index.select("shard", "ids").collect()}
        coded = [(name, [t.encode() for t in found]) for name, found in items]
        got = {(ids[r.shard][r.row], r.item): set(r.places) for r in decontaminate.near_hits(index, coded, span, window=4).collect()}
        assert got == want and want
