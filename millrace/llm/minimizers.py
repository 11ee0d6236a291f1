"""Minimizers: a sample of k-mers such that equal windows always share a sampled k-mer.

The smallest k-mer hash of a window depends on the window alone. Two equal windows, wherever
they lie, therefore have the same minimizer, and a window whose minimizer occurs once in the
corpus is repeated nowhere. This leaves exact methods a small part of the corpus to work on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored, text_groups

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, k: int, base: np.uint64 = _ODD) -> np.ndarray:
    """Polynomial hash of every run of k values, by doubling; len(values) - k + 1 results."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, out_k = None, 0
    part, part_k, power = values.astype(np.uint64), 1, base
    bits = k
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                if out is None:
                    out, out_k = part, part_k
                else:  # the longer part goes first, what there is so far after it
                    m = len(out) - part_k
                    out, out_k = part[:m] * _power(base, out_k) + out[part_k:], out_k + part_k
            bits >>= 1
            if bits:
                m = len(part) - part_k
                part = part[:m] * power + part[part_k : part_k + m]
                power, part_k = power * power, 2 * part_k
    return out[:n]


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, hashes.dtype)
    part, k = hashes, 1
    while 2 * k <= width:
        part, k = np.minimum(part[:-k], part[k:]), 2 * k
    return np.minimum(part[:n], part[width - k : width - k + n])


def valid_starts(lengths: np.ndarray, window: int) -> np.ndarray:
    """Whether a window begins here and ends in the same text, for texts laid end to end."""
    total = int(lengths.sum())
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(total)
    return (left >= window)[: max(0, total - window + 1)]


class Laid:
    """A group of texts laid end to end, with the minimizer of every window."""

    def __init__(self, parts: list[np.ndarray], k: int, window: int) -> None:
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.ok = valid_starts(self.lengths, window)
        self.owner = np.repeat(np.arange(len(parts)), self.lengths)
        self.width = window - k + 1
        # Bytes count from one: a run of NUL would hash to 0, which stands for no k-mer.
        bytewise = self.values.dtype == np.uint8
        self.kmers = mixed(rolling(self.values.astype(np.uint64) + np.uint64(1) if bytewise else self.values, k))
        self.minima = window_minima(self.kmers, self.width)

    def anchors(self) -> np.ndarray:
        """Places of k-mers that are the minimizer of any window around them, ties included.

        No window around a k-mer has a minimum above it, so the largest of these minima tells."""
        edge = np.zeros(self.width - 1, np.uint64)
        around = ~window_minima(~np.concatenate([edge, np.where(self.ok, self.minima, np.uint64(0)), edge]), self.width)
        return np.flatnonzero((around == self.kmers) & (self.kmers > 0)) if len(self.minima) else np.empty(0, np.int64)


def minimizer_rows(docs: DataFrame, parts_of, k: int, window: int, group_bytes: int) -> DataFrame:
    """(h, doc_id, known), stored: the distinct minimizers of each group of texts.

    A task sends one row per distinct minimizer of its group of texts: with the document if
    only one holds it, else as a witness without document, since all its documents are then
    known to repeat it. So a passage in a third of all documents costs one row per group.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_groups(batches, group_bytes):
            laid = Laid([parts_of(r["text"]) for r in rows], k, window)
            at = laid.anchors()
            low, who = laid.kmers[at], laid.owner[at]
            order = np.lexsort((who, low))
            low, who = low[order], who[order]
            first = np.ones(len(low), dtype=bool)
            first[1:] = low[1:] != low[:-1]
            count = np.diff(np.append(np.flatnonzero(first), len(low)))
            many = np.repeat(count > 1, count)
            single = ~many
            new = first.copy()
            new[1:] |= who[1:] != who[:-1]
            ids = pa.array([r["doc_id"] for r in rows], arrow_type)
            for mask, named, known in ((single, True, False), (many & new, True, True), (many & first, False, False)):
                hashes = pa.array(low[mask].view(np.int64), pa.int64())
                doc = ids.take(pa.array(who[mask])) if named else pa.nulls(int(mask.sum()), ids.type)
                yield pa.RecordBatch.from_arrays([hashes, doc, pa.array(np.full(int(mask.sum()), known), pa.bool_())], names=["h", "doc_id", "known"])

    return stored(docs.mapInArrow(work, f"h bigint, doc_id {kind}, known boolean"))


def repeated_minimizers(docs: DataFrame, parts_of, k: int, window: int, group_bytes: int) -> DataFrame:
    """(doc_id, hashes): for each document the minimizers that also occur at another place."""
    return of_documents(minimizer_rows(docs, parts_of, k, window, group_bytes))


def of_documents(sent: DataFrame) -> DataFrame:
    """(doc_id, hashes) from the rows of all groups."""
    counted = sent.where(~F.col("known")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h")))
    shared = counted.where("n > 1 and doc_id is not null").select("doc_id", "h").unionByName(sent.where("known").select("doc_id", "h"))
    return shared.groupBy("doc_id").agg(F.collect_set("h").alias("hashes"))


def candidates(laid: Laid, lists: list[np.ndarray]) -> np.ndarray:
    """Starts of the windows whose minimizer is in their text's list."""
    out = laid.ok.copy()
    for k, hashes in enumerate(lists):
        a, b = int(laid.starts[k]), min(int(laid.starts[k] + laid.lengths[k]), len(out))
        if a < b:
            out[a:b] &= np.isin(laid.minima[a:b], hashes)
    return np.flatnonzero(out)


def runs(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of consecutive sorted positions."""
    if not len(positions):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(np.diff(positions) != 1) + 1
    begin = np.concatenate([[0], cut])
    return positions[begin], np.diff(np.append(begin, len(positions)))
