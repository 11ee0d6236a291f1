"""Removal of byte strings that occur more than once, by blockwise suffix sorting.

Suffixes are sorted one bucket at a time, and only as deep as ``LENGTH`` bytes.

1. Minimizers leave the suffixes whose bucket, named by their smallest sampled k-mer, has
   more than one member; a suffix alone in its bucket is repeated nowhere.
2. A bucket's members are the surroundings of one k-mer, so all of them are aligned at it. The
   difference cover is taken on that alignment: one cover place in ``COVER`` bytes. Ranks of
   the cover sample are computed first, for strings of 8, 16, 32 bytes and so on.
3. A suffix is then sorted by the few bytes before the next cover place, the rank of the cover
   string there, which resolves ties of any depth at once, and the few bytes after it. Equal
   neighbours in this order share ``LENGTH`` bytes, and all of them are marked.
4. Buckets are dealt out by Spark and worked off in blocks of bounded size; larger buckets are
   split by ranges of columns until none is left. Within a task of
   the scan equal surroundings are combined first: they repeat each other, which needs no sort,
   and one row for all of them goes to the bucket.

Texts are UTF-8 bytes. Defined results: null and empty texts have no bytes; texts shorter than
``LENGTH`` lose nothing; equal texts lose everything from ``LENGTH`` bytes on, in all copies;
repeated rows of an id count as copies; rows without an id are not compared; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_and_text, slices, stored, text_groups
from .minimizers import Laid, candidates, repeated_minimizers, runs

LENGTH = 200
KMER = 33
COVER = 8
GROUP_BYTES = 3 << 20
BLOCK_ROWS = 4096
# A bucket with more rows than this is split by longer prefixes, again and again, over ranges of
# columns from SPLIT_COLUMNS down to one; the list of such buckets is copied to every task up to
# LISTED, that of repeated rows up to LISTED_ROWS, else it is joined.
LARGE_BUCKET = 20_000
LISTED = 500_000
LISTED_ROWS = 100_000
SPLIT_COLUMNS = 24


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1].reshape(a.shape)


def cover_ranks(block: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of ``length - COVER`` bytes at every cover place of each row (one
    in ``COVER`` columns), by doubling. ``block`` has whole multiples of ``COVER`` columns."""
    words = block.reshape(len(block), -1, COVER)
    eights = np.ascontiguousarray(words).view(">u8").reshape(len(block), -1)
    ranks = {1: np.unique(eights, return_inverse=True)[1].reshape(eights.shape)}
    want = (length - COVER) // COVER
    size = 1
    while 2 * size <= want:
        r = ranks[size]
        ranks[2 * size] = pair_ranks(r[:, :-size], r[:, size:])
        size *= 2
    out, have = ranks[size], size
    for k in sorted(ranks, reverse=True):
        while have + k <= want:
            n = out.shape[1] - k
            tail = ranks[k][:, have : have + n]
            n = min(n, tail.shape[1])
            out, have = pair_ranks(out[:, :n], tail[:, :n]), have + k
    return out


def _packed(block: np.ndarray, at: int, n: int) -> np.ndarray:
    out = np.zeros(len(block), dtype=np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | block[:, at + k]
    return out


def repeated_starts(bucket: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For rows of surroundings (all buckets aligned at the same column) whether the string of
    ``length`` bytes that begins in column j occurs in another row of the bucket. Row r has
    strings in columns ``low[r]`` to ``high[r]``."""
    ranks = cover_ranks(block, length)
    span = int(high.max()) + 1 if len(high) else 0
    out = np.zeros((len(block), span), dtype=bool)
    for j in range(span):
        rows = np.flatnonzero((low <= j) & (high >= j))
        if len(rows) < 2:
            continue
        place = -(-j // COVER)
        before = place * COVER - j
        keys = [bucket[rows], ranks[rows, place], _packed(block[rows], j, before), _packed(block[rows], (place * COVER) + length - COVER, COVER - before)]
        order = np.lexsort(keys)
        same = np.ones(len(rows) - 1, dtype=bool)
        for key in keys:
            same &= key[order][1:] == key[order][:-1]
        marked = np.zeros(len(rows), dtype=bool)
        marked[1:] |= same
        marked[:-1] |= same
        out[rows[order[marked]], j] = True
    return out


def _surroundings(kind: pa.DataType, length: int, kmer: int):
    """For every candidate anchor its surroundings; equal ones of a group of texts are combined.

    Rows with ``h`` go to a bucket; rows without are known runs (``pos``, ``n`` starts)."""
    reach = length - kmer  # starts that precede an anchor at most
    width = -(-(reach + length + COVER) // COVER) * COVER

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_groups(batches, GROUP_BYTES):
            laid = Laid([text_bytes(r["text"]) for r in rows], kmer, length)
            lists = [np.array(r["hashes"], dtype=np.int64).view(np.uint64) for r in rows]
            at = candidates(laid, lists)
            ids = pa.array([r["doc_id"] for r in rows], kind)
            columns: dict[str, list] = {k: [] for k in ("h", "around", "doc", "pos", "low", "high")}
            known = []
            if len(at):
                values = np.concatenate([laid.values, np.zeros(width + reach, np.uint8)])
                anchors = laid.anchors()
                # the first anchor at or after a start is not always its minimizer: take the first with its hash
                which = np.searchsorted(anchors, at)
                hashes = laid.kmers[anchors]
                wanted = laid.minima[at]
                todo = np.flatnonzero(hashes[np.minimum(which, len(anchors) - 1)] != wanted)
                while len(todo):
                    which[todo] += 1
                    todo = todo[hashes[which[todo]] != wanted[todo]]
                anchor = anchors[which]
                cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(at) > 1)]))
                first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
                center, h = anchor[cut], wanted[cut]
                seen: dict[tuple, list[int]] = {}
                for k in range(len(cut)):
                    a, b, c = int(first[k]), int(last[k]), int(center[k])
                    seen.setdefault((int(h[k]), values[a : b + length].tobytes(), c - a), []).append(k)
                for (name, body, before), where in seen.items():
                    k = where[0]
                    if len(where) > 1:
                        known += [(int(first[i]), int(last[i]) - int(first[i]) + 1) for i in where]
                    columns["h"].append(name - (1 << 64) if name >> 63 else name)
                    columns["around"].append(body)
                    columns["doc"].append(int(laid.owner[first[k]]) if len(where) == 1 else None)
                    columns["pos"].append(int(first[k] - laid.starts[laid.owner[first[k]]]))
                    columns["low"].append(reach - before)
                    columns["high"].append(reach - before + int(last[k] - first[k]))
            n, m = len(columns["h"]), len(known)
            owner = [int(laid.owner[a]) for a, _ in known]
            place = [a - int(laid.starts[o]) for (a, _), o in zip(known, owner)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns["h"] + [None] * m, pa.int64()),
                    pa.array(columns["around"] + [None] * m, pa.binary()),
                    ids.take(pa.array(columns["doc"] + owner, pa.int64())),
                    pa.array(columns["pos"] + place, pa.int64()),
                    pa.array(columns["low"] + [0] * m, pa.int32()),
                    pa.array(columns["high"] + [c - 1 for _, c in known], pa.int32()),
                ],
                names=["h", "around", "doc_id", "pos", "low", "high"],
            )

    return work


def _sorted_buckets(length: int, kmer: int):
    """Buckets arrive whole and in order; several small ones are sorted as one block."""
    reach = length - kmer
    width = -(-(reach + length + COVER) // COVER) * COVER

    def solve(rows: pa.Table) -> pa.RecordBatch:
        low, high = (rows.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
        block = np.zeros((len(rows), width), dtype=np.uint8)
        for k, body in enumerate(rows.column("around").to_pylist()):
            block[k, low[k] : low[k] + len(body)] = np.frombuffer(body, np.uint8)
        marks = repeated_starts(rows.column("h").to_numpy(), block, low, high, length)
        asked = np.flatnonzero(rows.column("doc_id").is_valid().to_numpy())
        at, n, row = [], [], []
        for k in asked.tolist():
            start, count = runs(np.flatnonzero(marks[k]))
            at += (start - low[k]).tolist()
            n += count.tolist()
            row += [k] * len(start)
        rows = rows.select(["doc_id", "pos"]).take(pa.array(row, pa.int64())).combine_chunks()
        pos = rows.column("pos").to_numpy() + np.array(at, dtype=np.int64)
        ids = rows.column("doc_id").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "pos", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in slices(batches, BLOCK_ROWS // 2):
            held.append(pa.Table.from_batches([batch]))
            count += len(batch)
            if count >= BLOCK_ROWS:
                rows = pa.concat_tables(held)
                h = rows.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
                if whole:
                    yield solve(rows.slice(0, whole))
                    held, count = [rows.slice(whole)], len(rows) - whole
                else:
                    held = [rows]
        if count:
            yield solve(pa.concat_tables(held))

    return work


def _finer(length: int, columns_at_once: int):
    """Rows of large buckets by ranges of columns. All strings that begin in a range share the
    bytes from the range's last column to the end of its first string: these join the name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK_ROWS):
            out = []
            for r in batch.to_pylist():
                for first in range(r["low"] // columns_at_once * columns_at_once, r["high"] + 1, columns_at_once):
                    last = first + columns_at_once - 1
                    a, b = max(r["low"], first), min(r["high"], last)
                    shared = r["around"][last - r["low"] : first + length - r["low"]]
                    name = hashlib.blake2b(shared, digest_size=8, key=f"{r['h']} {first}".encode()).digest()
                    body = r["around"][a - r["low"] : b - r["low"] + length]
                    out.append((int.from_bytes(name, "little", signed=True), body, r["doc_id"], r["pos"] + a - r["low"], a, b))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch.schema)], schema=batch.schema)

    return work


def bounded(rows: DataFrame, length: int, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows in buckets of at most ``large`` rows, repeats found on the way as doc_id, pos, n).

    Rows of a large bucket are split; equal ones then repeat each other, and one row without
    document stands for them. What is still large is split over narrower ranges. With one column
    the name covers the whole string, so no more than one row of a name is left."""
    schema = "h bigint, around binary, " + ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "pos", "low", "high"))
    key = ["h", "around", "low", "high"]
    done, found, width = [], [], SPLIT_COLUMNS
    while True:
        hot = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("h"))
        if not (n_hot := hot.count()):
            return reduce(DataFrame.unionByName, done, rows), found
        named = F.broadcast(hot) if n_hot <= LISTED else hot
        done.append(rows.join(named, "h", "left_anti"))
        split = stored(rows.join(named, "h", "left_semi").select(*rows.columns).mapInArrow(_finer(length, width), schema))
        each = split.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("pos").alias("pos"))
        each = stored(each.withColumn("doc_id", F.when(F.col("n") == 1, F.col("doc_id"))))
        again = each.where("n > 1").select(*key)
        again = F.broadcast(again) if again.count() <= LISTED_ROWS else again
        members = split.where("doc_id is not null").join(again, key, "left_semi")
        found.append(members.select("doc_id", "pos", (F.col("high") - F.col("low") + 1).cast("bigint").alias("n")))
        rows = each.select(*rows.columns)
        if width == 1:
            return reduce(DataFrame.unionByName, done, rows), found
        width = max(1, width // 2)


def repeated_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, large: int = LARGE_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(touched, spans): the documents with candidates, stored; and (doc_id, pos, n): runs of
    starts of repeated strings."""
    known = docs.where(F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType
    hashes = repeated_minimizers(known, text_bytes, kmer, length, GROUP_BYTES)
    touched = stored(known.join(hashes, "doc_id"))
    schema = f"h bigint, around binary, doc_id {kind.simpleString()}, pos bigint, low int, high int"
    sent = stored(touched.mapInArrow(_surroundings(to_arrow_type(kind), length, kmer), schema))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, found = bounded(sent.where("h is not null"), length, large)
    dealt = rows.repartition(n, "h").sortWithinPartitions("h")
    sorted_ = dealt.mapInArrow(_sorted_buckets(length, kmer), f"doc_id {kind.simpleString()}, pos bigint, n bigint")
    at_once = sent.where("h is null").select("doc_id", "pos", (F.col("high") + 1).cast("bigint").alias("n"))
    return touched, reduce(DataFrame.unionByName, found, at_once.unionByName(sorted_))


def _kept(length: int, with_spans: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            spans = batch.column("spans").to_pylist() if with_spans else [()] * batch.num_rows
            for text, found in zip(batch.column("text").to_pylist(), spans):
                data = text.encode("utf-8", "surrogatepass")
                pieces, end, removed, count = [], 0, 0, 0
                merged: list[list[int]] = []
                for a, b in sorted((s["pos"], s["pos"] + s["n"] + length - 1) for s in found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                for a, b in merged:
                    pieces.append(data[end:a])
                    removed, count, end = removed + b - a, count + 1, b
                pieces.append(data[end:])
                out.append((len(data), removed, count, hashlib.sha256(b"".join(pieces)).hexdigest()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return work


def remove_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, large: int = LARGE_BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts = id_and_text(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    touched, spans = repeated_spans(texts, length, kmer, large)
    of_doc = stored(spans.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("spans")))
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    changed = touched.select("doc_id", "text").join(of_doc, "doc_id").mapInArrow(_kept(length, True), schema)
    whole = texts.mapInArrow(_kept(length, False), schema).join(of_doc.select("doc_id"), "doc_id", "left_anti")
    return whole.unionByName(changed)
