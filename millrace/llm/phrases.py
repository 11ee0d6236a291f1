"""Removal of word sequences that occur earlier in the corpus, on a compacted De Bruijn graph.

1. Minimizers leave only the windows whose rarest sampled k-mer occurs elsewhere.
2. Those windows of ``WINDOW`` words are the edges of a De Bruijn graph whose nodes are the
   overlaps of ``WINDOW - 1`` words. Within a task equal edges are combined first, and edges that
   follow each other under one minimizer are one row. Equal edges share their minimizer, so one
   shuffle by it gives each edge its first source coordinate (document and word) and its number
   of occurrences, and the rows are runs again.
3. Runs that are equal at consecutive places in a document and in its source make a nonbranching
   path. Repeated runs are joined with the one that follows them at their first coordinate; where
   both occur equally often the path goes on, elsewhere a new one begins. An occurrence of a path
   is then one row with a length.
4. The spans are verified against the source coordinate: an occurrence is removed if its
   coordinate is later than the path's first one. Coordinates, never texts, are shuffled here.

Words are runs without white space, unchanged. Defined results: null and empty texts have no
words; texts shorter than a window lose nothing; repeated rows of an id are equally early and
take nothing from each other; rows without an id are neither sources nor changed; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import forget, id_and_text, slices, stored, text_groups
from .minimizers import Laid, candidates, minimizer_rows, mixed, of_documents, rolling, runs

WINDOW = 20
KMER = 11
GROUP_BYTES = 8 << 20


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


_HASHES = _WordHash()


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def _edges(kind: pa.DataType, window: int, kmer: int):
    """Distinct candidate edges of a group of texts at their first coordinates there, one row per run
    of them that shares a minimizer ``h``; and one row per run of edges that came earlier in the group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_groups(batches, GROUP_BYTES):
            rows.sort(key=lambda r: r["doc_id"])
            laid = Laid([word_hashes(r["text"]) for r in rows], kmer, window)
            at = candidates(laid, [np.array(r["hashes"], dtype=np.int64).view(np.uint64) for r in rows])
            e, h = mixed(rolling(laid.values, window))[at], laid.minima[at]
            order = np.lexsort((h, e))  # stable: the first of equal edges is the earliest
            first = np.ones(len(order), dtype=bool)
            first[1:] = (e[order][1:] != e[order][:-1]) | (h[order][1:] != h[order][:-1])
            ids = pa.array([r["doc_id"] for r in rows], kind)
            head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            source = at[order[head]]
            # equal coordinates of repeated rows are equally early
            doc, src = laid.owner[at[order]], laid.owner[source]
            same_id = np.array([rows[a]["doc_id"] == rows[b]["doc_id"] for a, b in zip(doc[~first], src[~first])], dtype=bool)
            same = same_id & ((at[order] - laid.starts[doc]) == (source - laid.starts[src]))[~first] if len(same_id) else same_id
            later = np.sort(at[order[~first]][~same])
            start, length = runs(later)
            if len(start):  # a run ends with its text
                owner = laid.owner[start]
                over = start + length > laid.starts[owner] + laid.lengths[owner]
                assert not over.any()
            sent = np.sort(order[first])  # places in ``at``
            cut = np.ones(len(sent), dtype=bool)
            cut[1:] = (np.diff(at[sent]) != 1) | (h[sent][1:] != h[sent][:-1])
            begin = np.flatnonzero(cut)
            n, m = len(begin), len(start)
            place = np.concatenate([at[sent][begin], start])
            owner = laid.owner[place] if len(place) else np.empty(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.append(begin, len(sent)), pa.int32()), pa.array(e[sent].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(h[sent][begin].view(np.int64)), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([held, pa.nulls(m, held.type)]),
                    ids.take(pa.array(owner)),
                    pa.array(place - laid.starts[owner], pa.int64()),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(length, pa.int64())]),
                ],
                names=["h", "edges", "doc_id", "pos", "length"],
            )

    return work


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> tuple[DataFrame, DataFrame]:
    """(touched, spans), both stored: the documents with candidate windows; and (doc_id, spans of pos,
    length): runs of windows that start earlier elsewhere."""
    known = docs.where(F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType
    minimizers = minimizer_rows(known, word_hashes, kmer, window, GROUP_BYTES)
    lists = stored(of_documents(minimizers))  # by itself: its shuffles are gone before the texts move
    forget(minimizers)
    touched = stored(known.join(lists, "doc_id"))
    forget(lists)
    schema = f"h bigint, edges array<bigint>, doc_id {kind.simpleString()}, pos bigint, length bigint"
    sent = stored(touched.mapInArrow(_edges(to_arrow_type(kind), window, kmer), schema))
    edges = sourced(sent)
    spans = sent.where("h is null").select("doc_id", "pos", "length").unionByName(compacted(edges))
    of_doc = stored(spans.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "length")).alias("spans")))
    forget(sent)
    forget(edges)
    return touched, of_doc


def sourced(sent: DataFrame) -> DataFrame:
    """(doc_id, pos, length, src_doc, src_pos, n), stored: runs of edges that occur n > 1 times, with
    the place of the earliest occurrence.

    Equal edges have one minimizer: dealt by it, the runs are opened, compared and closed again
    without another shuffle."""
    dealt = sent.where("h is not null").repartition("h")
    each = dealt.select("h", "doc_id", F.col("pos").alias("run"), F.posexplode("edges").alias("i", "e"))
    each = each.select("h", "e", "doc_id", "run", (F.col("run") + F.col("i")).alias("pos"))
    by_edge = Window.partitionBy("h", "e")
    found = each.withColumns({"src": F.min(F.struct("doc_id", "pos")).over(by_edge), "n": F.count(F.lit(1)).over(by_edge)}).where("n > 1")
    closed = found.groupBy("h", "doc_id", "run", F.col("src.doc_id").alias("src_doc"), (F.col("pos") - F.col("src.pos")).alias("shift"), "n").agg(
        F.array_sort(F.collect_set("pos")).alias("at")
    )
    whole = F.size("at") == F.element_at("at", -1) - F.element_at("at", 1) + 1
    one = lambda pos, n: F.struct(pos.alias("pos"), n.cast("bigint").alias("length"))
    rows = F.when(whole, F.array(one(F.element_at("at", 1), F.size("at")))).otherwise(F.transform("at", lambda x: one(x, F.lit(1))))
    out = closed.select("doc_id", F.explode(rows).alias("r"), "src_doc", "shift", "n")
    return stored(out.select("doc_id", "r.pos", "r.length", "src_doc", (F.col("r.pos") - F.col("shift")).alias("src_pos"), "n"))


def compacted(edges: DataFrame) -> DataFrame:
    """(doc_id, pos, length): occurrences of paths later than their source."""
    own = (F.col("doc_id") == F.col("src_doc")) & (F.col("pos") == F.col("src_pos"))
    first = edges.where(own).select("src_doc", "src_pos", "length", "n").distinct()
    before = first.select("src_doc", (F.col("src_pos") + F.col("length")).alias("src_pos"), "n").distinct()
    heads = first.join(before.withColumn("inner", F.lit(True)), ["src_doc", "src_pos", "n"], "left")
    along = Window.partitionBy("src_doc").orderBy("src_pos")
    paths = heads.select("src_doc", "src_pos", F.last(F.when(F.col("inner").isNull(), F.col("src_pos")), True).over(along).alias("path")).distinct()
    # an occurrence may begin inside a run of its source: it is a path by itself then
    later = edges.where(~own).select("doc_id", "pos", "length", "src_doc", "src_pos").join(paths, ["src_doc", "src_pos"], "left")
    # a copy of a path lies on one diagonal; if it has gaps (a copy that leaves and returns) its runs stay single
    shift = (F.col("pos") - F.col("src_pos")).alias("shift")
    spans = later.groupBy("doc_id", "src_doc", F.coalesce("path", "src_pos").alias("path"), shift).agg(
        F.min("pos").alias("low"), F.max(F.col("pos") + F.col("length")).alias("high"), F.collect_set(F.struct("pos", "length")).alias("at")
    )
    covered = F.aggregate("at", F.lit(0).cast("bigint"), lambda n, x: n + x["length"])
    rows = F.when(covered == F.col("high") - F.col("low"), F.array(F.struct(F.col("low").alias("pos"), (F.col("high") - F.col("low")).alias("length"))))
    return spans.select("doc_id", F.explode(rows.otherwise(F.col("at"))).alias("r")).select("doc_id", "r.pos", "r.length")


def _kept(window: int, with_spans: bool, kind: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            spans = batch.column("spans").to_pylist() if with_spans else [()] * batch.num_rows
            for text, found in zip(batch.column("text").to_pylist(), spans):
                held = words(text)
                n = len(held)
                if found:
                    cover = np.zeros(n + 1, dtype=np.int64)
                    begin = np.array([s["pos"] for s in found])
                    end = begin + np.array([s["length"] for s in found]) + window - 1
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, np.minimum(end, n), -1)
                    held = [w for w, gone in zip(held, (np.cumsum(cover) > 0).tolist()) if not gone]
                out.append((n, n - len(held), hashlib.sha256(b" ".join(held)).hexdigest()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    texts = id_and_text(docs)
    kind = docs.schema["doc_id"].dataType
    touched, of_doc = repeated_spans(texts, window, kmer)
    schema = f"doc_id {kind.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    arrow = to_arrow_type(kind)
    changed = touched.select("doc_id", "text").join(of_doc, "doc_id").mapInArrow(_kept(window, True, arrow), schema)
    whole = texts.mapInArrow(_kept(window, False, arrow), schema).join(of_doc.select("doc_id"), "doc_id", "left_anti")
    return whole.unionByName(changed)
