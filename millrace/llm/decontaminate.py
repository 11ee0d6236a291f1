"""Benchmark passages found in documents through a distributed positional inverted index.

The index is partitioned by document: a shard holds the postings of a bounded amount of
text. Every phrase starts from its globally rarest term and intersects the offset-adjusted
posting lists term by term, the rarest first, so most phrases end after one or two short
lists. Documents stay whole inside a shard, therefore no positions are shuffled.

Defined results: null and empty texts have no words and no hits; an item without words has
no window; items with equal ids count once; repeated rows are judged each by itself; an
empty benchmark leaves all counts at 0; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_and_text, stored, text_groups

WINDOW = 13
SHARD_BYTES = 8 << 20
# Benchmark text that one pass over the index holds in memory, as some 20 bytes for each of
# these; a larger benchmark takes more passes. An item is never cut.
PASS_BYTES = 4 << 20

# Words are runs of digits, letters and bytes above 0x7F; A-Z become a-z; all else separates.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(found: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter text is one window."""
    if not found:
        return []
    return [tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]


_INDEX = "ids array<{id}>, firsts array<bigint>, terms array<binary>, counts array<bigint>, steps binary"


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A stored index, one row per shard.

    ``ids`` and ``firsts`` list the shard's documents and where each begins in the shard's
    running word count (one more value ends the last). ``terms`` and ``counts`` list the
    terms; ``steps`` holds all posting lists in that order as little-endian unsigned 32-bit
    differences of positions.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in text_groups(batches, shard_bytes):
            number: dict[bytes, int] = {}
            firsts, streams = [0], []
            for row in group:
                found = words(row.pop("text"))
                streams.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
                firsts.append(firsts[-1] + len(found))
            stream = np.concatenate(streams)
            counts = np.bincount(stream, minlength=len(number))
            positions = np.argsort(stream, kind="stable").astype(np.int64)
            steps = np.diff(positions, prepend=0)
            begins = (np.cumsum(counts) - counts).astype(np.int64)
            steps[begins] = positions[begins]
            columns = [[[r["doc_id"] for r in group]], [firsts], [list(number)], [counts.tolist()], [steps.astype("<u4").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = _INDEX.format(id=kind)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    names, types = arrow.names, arrow.types
    return stored(id_and_text(docs).mapInArrow(work, schema).withColumn("shard", F.monotonically_increasing_id()))


class Shard:
    """One row of the index, with its posting lists decoded when asked for."""

    def __init__(self, terms, counts, steps, wanted: dict[bytes, int]) -> None:
        ends = np.cumsum(np.asarray(counts, dtype=np.int64))
        self.steps = np.frombuffer(steps, dtype="<u4")
        self.at = {wanted[t]: (int(ends[k]) - counts[k], int(ends[k])) for k, t in enumerate(terms) if t in wanted}
        self.lists: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        if term not in self.lists:
            a, b = self.at[term]
            self.lists[term] = np.cumsum(self.steps[a:b], dtype=np.int64)
        return self.lists[term]

    def phrase(self, terms: tuple[int, ...], rarest: list[int]) -> np.ndarray:
        """Starts of the exact phrase; ``rarest`` orders its places by global frequency."""
        if any(t not in self.at for t in terms):
            return np.empty(0, np.int64)
        starts = self.positions(terms[rarest[0]]) - rarest[0]
        for place in rarest[1:]:
            listed, want = self.positions(terms[place]), starts + place
            found = np.searchsorted(listed, want)
            found[found == len(listed)] = 0
            starts = starts[listed[found] == want]
            if not len(starts):
                break
        return starts

    def near(self, terms: tuple[int, ...], rarest: list[int], span: int, firsts: np.ndarray | None = None) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``span`` words away; with
        the ``firsts`` of the shard's documents, in the same document."""
        if any(t not in self.at for t in terms):
            return np.empty(0, np.int64)
        here = self.positions(terms[rarest[0]])
        for place in rarest[1:]:
            listed, low, high = self.positions(terms[place]), here - span, here + span
            if firsts is not None:
                doc = np.searchsorted(firsts, here, side="right") - 1
                low, high = np.maximum(low, firsts[doc]), np.minimum(high, firsts[doc + 1] - 1)
            here = here[np.searchsorted(listed, low) < np.searchsorted(listed, high, side="right")]
            if not len(here):
                break
        return here


def _passes(benchmark: DataFrame, pass_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item id as text, words) of the items, so many bytes at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // pass_bytes) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(str(r["item_id"]), words(r["text"])) for r in part.toLocalIterator()]


def _rarity(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each wanted term in the whole corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                for term, n in zip(terms.as_py(), counts.as_py()):
                    if term in vocabulary:
                        total[vocabulary[term]] += n
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(total[kept], pa.int64())], names=["term", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    counted = index.select("terms", "counts").mapInArrow(work, "term bigint, n bigint")
    for row in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


_HITS = "shard bigint, row bigint, starts array<bigint>, ends array<bigint>, items array<string>"


@dataclass
class Phrases:
    """Distinct windows of a pass as matrices of term numbers, one for each length.

    ``groups`` holds (terms, begins, owners): window i has the terms ``terms[i]`` and belongs
    to the items ``names[owners[begins[i]]]`` up to ``begins[i + 1]``."""

    names: list[str]
    vocabulary: dict[bytes, int]
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    rarity: np.ndarray

    def known(self) -> Phrases:
        """Only windows all of whose terms occur in the corpus, and their terms."""
        groups, used = [], np.zeros(len(self.vocabulary), dtype=bool)
        for terms, begins, owners in self.groups:
            kept = (self.rarity[terms] > 0).all(axis=1)
            if kept.any():
                counts = np.diff(begins)
                groups.append((terms[kept], np.concatenate([[0], np.cumsum(counts[kept])]), owners[np.repeat(kept, counts)]))
                used[groups[-1][0].ravel()] = True
        return Phrases(self.names, {t: n for t, n in self.vocabulary.items() if used[n]}, groups, self.rarity)

    def found(self, shard: Shard) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """(length, starts, names of items) of the windows that occur in a shard."""
        present = np.zeros(len(self.rarity), dtype=bool)
        present[list(shard.at)] = True
        for terms, begins, owners in self.groups:
            for i in np.flatnonzero(present[terms].all(axis=1)).tolist():
                starts = shard.phrase(tuple(terms[i].tolist()), np.argsort(self.rarity[terms[i]], kind="stable").tolist())
                if len(starts):
                    yield terms.shape[1], starts, [self.names[o] for o in owners[begins[i] : begins[i + 1]].tolist()]


def phrases(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Phrases:
    """The windows of the items, without the frequencies of their terms."""
    vocabulary: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(names)}
    by_length: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
    for name, found in items:
        if found:
            ids = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in found), np.int32, len(found))
            by_length[min(window, len(ids))].append((ids, number[name]))
    groups = []
    for length, texts in sorted(by_length.items()):
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, length) for ids, _ in texts])
        owner = np.repeat([k for _, k in texts], [len(ids) - length + 1 for ids, _ in texts])
        terms, which = np.unique(rows, axis=0, return_inverse=True)
        pairs = np.unique(which.ravel().astype(np.int64) * len(names) + owner)
        begins = np.searchsorted(pairs, np.arange(len(terms) + 1, dtype=np.int64) * len(names))
        groups.append((terms, begins, (pairs % len(names)).astype(np.int32)))
    return Phrases(names, vocabulary, groups, np.zeros(len(vocabulary), dtype=np.int64))


def hits(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> DataFrame:
    """Documents (shard and row in it) with any window of the items: the covered runs of
    words, counted from the document's first word, and the items."""
    plan = phrases(items, window)
    plan.rarity = _rarity(index, plan.vocabulary)
    plan = plan.known()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                shard = Shard(row["terms"], row["counts"], row["steps"], plan.vocabulary)
                firsts = np.asarray(row["firsts"], dtype=np.int64)
                cover, named = np.zeros(int(firsts[-1]) + 1, dtype=np.int64), defaultdict(set)
                for length, starts, names in plan.found(shard):
                    doc = np.searchsorted(firsts, starts, side="right") - 1
                    inside = starts + length <= firsts[doc + 1]
                    np.add.at(cover, starts[inside], 1)
                    np.add.at(cover, starts[inside] + length, -1)
                    for d in np.unique(doc[inside]).tolist():
                        named[d].update(names)
                covered = np.cumsum(cover) > 0
                out = []
                for d in sorted(named):
                    edge = np.diff(np.concatenate([[0], covered[firsts[d] : firsts[d + 1]].astype(np.int8), [0]]))
                    out.append((row["shard"], d, np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), sorted(named[d])))
                columns = list(zip(*out)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "row", "starts", "ends", "items"])

    return index.mapInArrow(work, _HITS)


def near_hits(index: DataFrame, items: list[tuple[str, list[bytes]]], span: int, window: int = WINDOW) -> DataFrame:
    """Documents (shard and row in it) with all words of any window of an item near each other, in
    any order: ``item``, and the ``places`` of the window's globally rarest word, counted from the
    document's first word, with every other word at most ``span`` words away."""
    vocabulary: dict[bytes, int] = {}
    sets: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for name, found in items:
        for w in windows(found, window):
            sets[tuple(dict.fromkeys(vocabulary.setdefault(t, len(vocabulary)) for t in w))].add(name)
    rarity = _rarity(index, vocabulary)
    plan = [
        (terms, sorted(range(len(terms)), key=lambda p: (rarity[terms[p]], p)), sorted(names))
        for terms, names in sets.items()
        if all(rarity[t] for t in terms)
    ]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                shard = Shard(row["terms"], row["counts"], row["steps"], vocabulary)
                firsts = np.asarray(row["firsts"], dtype=np.int64)
                places: dict[tuple[int, str], set[int]] = defaultdict(set)
                for terms, rarest, names in plan:
                    here = shard.near(terms, rarest, span, firsts)
                    doc = np.searchsorted(firsts, here, side="right") - 1
                    for d, at in zip(doc.tolist(), (here - firsts[doc]).tolist()):
                        for name in names:
                            places[d, name].add(at)
                out = [(row["shard"], d, name, sorted(at)) for (d, name), at in sorted(places.items())]
                columns = list(zip(*out)) or [()] * 4
                types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["shard", "row", "item", "places"])

    return index.mapInArrow(work, "shard bigint, row bigint, item string, places array<bigint>")


@F.arrow_udf(T.LongType())
def _union_length(starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(starts, ends):
        total = reach = 0
        for low, high in sorted(zip(a.as_py(), b.as_py())):
            total += max(0, high - max(low, reach))
            reach = max(reach, high)
        out.append(total)
    return pa.array(out, pa.int64())


@F.arrow_udf(T.StructType([T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType())]))
def _digest(items: pa.Array) -> pa.Array:
    names = [sorted(set(x.as_py() or ())) for x in items]
    return pa.StructArray.from_arrays(
        [pa.array([len(n) for n in names], pa.int64()), pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string())],
        names=["n_items", "items_sha256"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: words, words inside benchmark windows, items, and the verdict."""
    index = build_index(docs, shard_bytes)
    found = [stored(hits(index, items, window)) for items in _passes(benchmark, pass_bytes)]
    merged = reduce(DataFrame.unionByName, found).groupBy("shard", "row").agg(
        *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items"))
    )
    merged = merged.select("shard", "row", _union_length("starts", "ends").alias("n_hit"), _digest("items").alias("d"))
    every = index.select("shard", F.posexplode(F.arrays_zip("ids", F.slice("firsts", 1, F.size("ids")).alias("a"), F.slice("firsts", 2, F.size("ids")).alias("b"))).alias("row", "x"))
    every = every.select("shard", F.col("row").cast("bigint").alias("row"), F.col("x.ids").alias("doc_id"), (F.col("x.b") - F.col("x.a")).alias("n_words"))
    none = hashlib.sha256(b"").hexdigest()
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return every.join(merged, ["shard", "row"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("d.n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("d.items_sha256", F.lit(none)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
