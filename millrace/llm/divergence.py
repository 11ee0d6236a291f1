"""Audit of how sources of one language diverge in their terms.

1. Counting is an Arrow compute pipeline inside each task: ``ascii_lower``,
   ``split_pattern_regex``, ``dictionary_encode`` and hash ``group_by`` turn slices of texts into
   partial counts per (lang, source, term), which are merged in the task up to ``FLUSH_ROWS`` rows.
2. One shuffle by (lang, term) merges the partial counts. Terms in fewer than ``MIN_DOCS``
   documents of their lang go; a term that stays is one row with its counts by source.
3. The terms of a lang are dealt by hash into shards of at most about ``CELLS`` cells (terms
   times sources). Each is a dense matrix of smoothed shares p in integers; it gives one sum of
   divergences per pair of sources and the best terms of each source, ``BLOCK`` sources at a time.
4. Sums of shards are added and ranked.

p = 1 + floor(SCALE * (count + 1) / (N + V)) with N counts of the group and V terms of the lang;
the divergence of a term is floor((p - q)^2 / q). All arithmetic is in integers.

Defined results: null text, lang and source count as empty texts; a repeated row is a document
of its own; a group without terms has p from counts of 0; a lang without kept terms gives pairs
with the value 0 and no terms; an empty table gives an empty result; equal values are ranked by
the bytes of their item; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
SLICE_BYTES = 4 << 20
FLUSH_ROWS = 1 << 19
CELLS = 1 << 18
BLOCK = 256  # sources whose sums with all others are one group's work
_KEY = ["lang", "source", "term"]


def _sums(table: pa.Table, keys: list[str], **named: str) -> pa.Table:
    out = table.group_by(keys, use_threads=False).aggregate([(c, "sum") for c in named.values()])
    return out.rename_columns([*keys, *named])


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, count, docs of a slice of rows."""
    split = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), NO_TERM)
    terms, doc = split.flatten(), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(terms), 0)
    coded = terms.filter(full).dictionary_encode()
    found = pa.table({"term": coded.indices, "doc": doc.filter(full), "docs": pa.repeat(pa.scalar(1, pa.int64()), len(coded))})
    in_doc = _sums(found, ["doc", "term"], count="docs")
    group = [batch.column(c).take(in_doc.column("doc").combine_chunks()).dictionary_encode() for c in ("lang", "source")]
    at = pa.table(
        {
            "lang": group[0].indices,
            "source": group[1].indices,
            "term": in_doc.column("term"),
            "count": in_doc.column("count"),
            "docs": pa.repeat(pa.scalar(1, pa.int64()), in_doc.num_rows),
        }
    )
    out = _sums(at, _KEY, count="count", docs="docs")
    words = [d.take(out.column(c).combine_chunks()) for c, d in zip(_KEY, (group[0].dictionary, group[1].dictionary, coded.dictionary))]
    return pa.table([*words, out.column("count"), out.column("docs")], names=[*_KEY, "count", "docs"])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for part in _by_bytes(batch):
            counts = partial_counts(part)
            held.append(counts)
            rows += counts.num_rows
            if rows >= FLUSH_ROWS:
                merged = _sums(pa.concat_tables(held), _KEY, count="count", docs="docs")
                if merged.num_rows >= FLUSH_ROWS // 2:
                    yield from merged.to_batches(1 << 14)
                    held, rows = [], 0
                else:
                    held, rows = [merged], merged.num_rows
    if held:
        yield from _sums(pa.concat_tables(held), _KEY, count="count", docs="docs").to_batches(1 << 14)


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of up to SLICE_BYTES of text; a longer text is a slice by itself."""
    for part in slices([batch], 4096):
        ends = np.cumsum(pc.binary_length(part.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < part.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield part.slice(at, to - at)
            at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: partial counts of every task, to be added up."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(_counting, "lang string, source string, term string, count bigint, docs bigint")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, by_source (source, count): the terms in at least ``min_docs`` documents of the lang, stored."""
    dealt = term_counts(docs).repartition("lang", "term")  # both groupings below keep this partitioning
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "count")).alias("by_source"))
    return stored(terms.where(F.col("docs") >= min_docs).drop("docs"))


def groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, n, v, sources: a row per group that occurs, with its counts of kept terms, stored."""
    occur = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    counted = terms.select("lang", F.explode("by_source").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.count").alias("n"))
    size = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    here = stored(occur.join(counted, ["lang", "source"], "left").join(size, "lang", "left").na.fill(0, ["n", "v"]))
    return here.join(here.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang")


def shares(count: np.ndarray, n: np.ndarray, v: int, scale: int = SCALE) -> np.ndarray:
    """p of every count; Python integers where 64 bits do not hold the product."""
    if count.size and int(count.max()) + 1 >= (1 << 63) // scale:
        return (1 + (scale * (count.astype(object) + 1)) // (n.astype(object) + v)).astype(np.int64)
    return 1 + scale * (count + 1) // (n + v)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q  # p and q are at most SCALE + 1: the square fits 64 bits


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _shard(top: int):
    """Partial results of a shard and a block of its sources: rows of pairs (value of a sum) and of
    terms (the best ``top`` a source)."""

    def work(key, terms: pa.Table, here: pa.Table) -> pa.Table:
        here = here.sort_by("source")
        names, block = here.column("source").combine_chunks(), here.column("block")[0].as_py()
        n, v = here.column("n").to_numpy().astype(np.int64), here.column("v")[0].as_py()
        lang, n_sources = here.column("lang")[0].as_py(), here.num_rows
        words = terms.column("term").combine_chunks()
        lists = terms.column("by_source").combine_chunks()
        cells = lists.flatten()
        count = np.zeros((len(words), n_sources), dtype=np.int64)
        if len(cells):
            row = pc.list_parent_indices(lists).to_numpy()
            count[row, pc.index_in(cells.field("source"), names).to_numpy(zero_copy_only=False)] = cells.field("count").to_numpy()
        p = shares(count, n[None, :], v)
        q = shares(count.sum(axis=1), np.array([n.sum()]), v)

        def rows(part: str, source, item, value) -> pa.Table:
            size = len(value)
            columns = [pa.repeat(pa.scalar(lang), size), names.take(pa.array(source)), pa.repeat(pa.scalar(part), size), item, pa.array(value, pa.int64())]
            return pa.table(columns, schema=_FOUND)

        every = np.arange(n_sources)
        left = every[block * BLOCK : (block + 1) * BLOCK]
        sums = np.zeros((len(left), n_sources), dtype=np.int64)
        if len(words):
            for k, i in enumerate(left):
                sums[k] = _divergence(p[:, i : i + 1], p).sum(axis=0)
        source, other = np.repeat(left, n_sources), np.tile(every, len(left))
        off = source != other
        out = [rows("pair", source[off], names.take(pa.array(other[off])), sums.ravel()[off])]
        for i in left:
            at = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
            value = _divergence(p[at, i], q[at])
            if len(at) > top:  # ties with the last one stay: they are ranked by their item later
                low = np.partition(value, len(value) - top)[len(value) - top]
                at, value = at[value >= low], value[value >= low]
            out.append(rows("term", np.full(len(at), i), words.take(pa.array(at)), value))
        return pa.concat_tables(out)

    return work


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence from every other source of the lang (part
    ``pair``), and the ``top`` terms by which a source stands out from its lang (part ``term``)."""
    terms = kept_terms(docs, min_docs)
    shards = F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / cells)).cast("bigint")
    here = stored(groups(docs, terms).withColumns({"shards": shards, "blocks": F.expr(f"(sources + {BLOCK - 1}) div {BLOCK}")}))
    langs = stored(here.select("lang", "shards", "blocks").distinct())
    block = F.explode(F.expr("sequence(0L, blocks - 1)"))
    dealt = terms.join(langs, "lang").select("lang", "term", "by_source", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), block.alias("block"))
    everywhere = here.withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)"))).select("lang", "shard", "source", "n", "v", block.alias("block"))
    key = ["lang", "shard", "block"]
    schema = "lang string, source string, part string, item string, value bigint"
    found = stored(dealt.groupBy(*key).cogroup(everywhere.groupBy(*key)).applyInArrow(_shard(top), schema))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best)
