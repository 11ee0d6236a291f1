"""Byte repeats: large buckets and runs of NUL, against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm import substrings


def check(got, texts):
    every = [t.encode() for t in texts]
    seen = Counter(w[s : s + 200] for w in every for s in range(len(w) - 199))
    total = 0
    for i, w in enumerate(every):
        gone = bytearray(len(w))
        for s in range(len(w) - 199):
            if seen[w[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        total += sum(gone)
        spans = sum(1 for k in range(len(w)) if gone[k] and not (k and gone[k - 1]))
        assert (got[i].n_removed, got[i].n_spans) == (sum(gone), spans), i
        assert got[i].kept_sha256 == substrings.hashlib.sha256(bytes(b for b, g in zip(w, gone) if not g)).hexdigest()
    return total


def some(rng, n):
    return "".join(rng.choice("abcdefghij") for _ in range(n))


@pytest.mark.parametrize("size", [205, 230, 420])
def test_a_passage_in_many_distinct_contexts(spark, monkeypatch, size):
    rng = random.Random(size)
    passage = some(rng, size)
    texts = [some(rng, rng.randint(150, 300)) + passage + some(rng, rng.randint(150, 300)) for _ in range(120)]
    texts += [some(rng, 500) for _ in range(20)] + texts[:2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(12)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, large=30).collect()}
    assert check(got, texts) >= 120 * size

    def sizes(length, kmer):
        def work(batches):
            count = Counter()
            for batch in batches:
                count.update(batch.column("h").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(count), pa.int64()), pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64())], names=["doc_id", "pos", "n"]
            )

        return work

    monkeypatch.setattr(substrings, "_sorted_buckets", sizes)
    buckets = substrings.repeated_spans(docs, large=30)[1].where("doc_id is null")
    assert 0 < buckets.agg({"n": "max"}).first()[0] <= 30


def test_runs_of_nul(spark):
    rng = random.Random(2)
    padded = some(rng, 90) + "\0" * 40 + some(rng, 90)
    texts = [some(rng, 150) + padded + some(rng, 90), some(rng, 20) + padded + some(rng, 300), "\0" * 260, some(rng, 50) + "\0" * 230, some(rng, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    assert check({r.doc_id: r for r in substrings.remove_repeats(docs).collect()}, texts) >= 2 * 220 + 490
