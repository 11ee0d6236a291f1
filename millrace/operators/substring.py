"""A substring index over the texts of a catalogue: posting lists of runs of three characters.

A text that contains a term contains every run of three of its characters, so the entries
of a few rare runs are the only candidates. They are then checked with ``contains``, so an
indexed search gives the same rows as a scan. Terms of fewer than three characters, and
terms whose rarest run is in a large share of the entries, are searched by a scan.

The index is a folder of Parquet tables, dealt by a hash of the run and sorted by it, so
that a search reads few row groups. A posting row holds the entries of one run in one block
of keys, at most ``BLOCK`` of them, however frequent the run is. Defined results: null
texts have no runs; equal keys are one entry whose texts all count; rows without a key are
always searched by a scan; an empty catalogue gives an empty index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rows import quoted
from .catalog import keyword_match, search_terms

RUN = 3
BLOCK = 1 << 16
PARTS = 64
PIECE = 1 << 16
# Runs of texts that a task holds before it sends their lists. A run is one number: three characters of 21 bits.
PAIRS = 1 << 21
_POINT = (1 << 21) - 1
# Runs looked up for a term: the rarest ones. All of them together are told apart by the bits of a BIGINT.
RAREST = 4
# Beyond this share of the entries a scan is cheaper than a look-up.
LARGE_SHARE = 0.25


def runs_of(text: str) -> list[str]:
    """Distinct runs of a term, in order."""
    return list(dict.fromkeys(text[i : i + RUN] for i in range(len(text) - RUN + 1)))


def _text(columns: list[str]) -> Column:
    return F.lower(F.concat_ws(" ", *map(quoted, columns)))


@dataclass(frozen=True)
class SubstringIndex:
    postings: DataFrame
    key: str
    columns: tuple[str, ...]
    entries: int

    def frequency(self, runs: list[str]) -> dict[str, int]:
        """Entries that hold each run."""
        counted = self._lists(runs).groupBy("run").agg(F.sum("n").alias("n"))
        return {r["run"]: r["n"] for r in counted.collect()}  # one row per run of the query

    def _lists(self, runs: list[str]) -> DataFrame:
        parts = {r[0] for r in self.postings.sparkSession.range(1).select(F.explode(F.array(*[_part(F.lit(x)) for x in runs]))).collect()}
        return self.postings.filter(F.col("part").isin(*parts) & F.col("run").isin(*runs))

    def candidates(self, query: str) -> DataFrame | None:
        """Keys of the entries that can match; None if a scan has to decide."""
        joiner, terms = search_terms(query)
        runs = {t: runs_of(t) for t in terms}
        if joiner == "and":
            terms = [t for t in terms if runs[t]] if any(runs.values()) else terms
        if not all(runs[t] for t in terms) or len(terms) > 62:
            return None
        wanted = list(dict.fromkeys(r for t in terms for r in runs[t]))
        often = self.frequency(wanted)
        each = max(1, min(RAREST, 62 // len(terms)))
        rarest = {t: sorted(runs[t], key=lambda r: (often.get(r, 0), r))[:each] for t in terms}
        fewest = [often.get(rarest[t][0], 0) for t in terms]
        if (min(fewest) if joiner == "and" else sum(fewest)) > LARGE_SHARE * self.entries:
            return None
        if joiner == "and":  # a run in nearly all entries sorts out little
            chosen = [r for t in terms for r in rarest[t]]
            rare = [r for r in chosen if often.get(r, 0) <= LARGE_SHARE * self.entries]
            needed = [list(dict.fromkeys(rare))]
        else:
            needed = [rarest[t] for t in terms]
        bit = {r: 1 << k for k, r in enumerate(dict.fromkeys(r for n in needed for r in n))}
        mark = reduce(lambda a, r: a.when(F.col("run") == r, F.lit(bit[r])), bit, F).cast("bigint")
        held = self._lists(list(bit)).select(F.explode("keys").alias(self.key), mark.alias("bit"))
        held = held.groupBy(self.key).agg(F.bit_or("bit").alias("bits"))
        masks = [sum(bit[r] for r in n) for n in needed]
        fits = [F.col("bits").bitwiseAND(F.lit(m).cast("bigint")) == m for m in masks]
        return held.filter(reduce(lambda a, b: a | b, fits)).select(self.key)

    def search(self, catalog: DataFrame, query: str) -> DataFrame:
        """The rows that ``catalog.search`` returns, through the index where it helps."""
        found = self.candidates(query)
        if found is not None:
            nameless = catalog.filter(quoted(self.key).isNull())
            catalog = catalog.join(found, self.key, "left_semi").select(*map(quoted, catalog.columns)).unionByName(nameless)
        return catalog.filter(keyword_match(list(self.columns), query))


def _part(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(PARTS)).cast("int")


def _listed(bits: int):
    """Lists of the keys of pieces, without repeats, one row per run and block of ``1 << bits`` keys of a group."""

    def rows(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        held.sort(key=lambda h: h[0])
        codes = np.concatenate([c for _, c in held])
        keys = np.repeat(np.array([k for k, _ in held], np.int64), [len(c) for _, c in held])
        order = np.argsort(codes, kind="stable")  # keys stay in order
        codes, keys = codes[order], keys[order]
        new_run = np.append(True, codes[1:] != codes[:-1])
        fresh = new_run | np.append(True, keys[1:] != keys[:-1])
        codes, keys, new_run = codes[fresh], keys[fresh], new_run[fresh]
        block = keys >> bits
        begin = np.flatnonzero(new_run | np.append(True, block[1:] != block[:-1]))
        points = np.stack([codes[begin] >> np.uint64(42), codes[begin] >> np.uint64(21), codes[begin]], axis=1) & np.uint64(_POINT)
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(keys)), pa.int32()), pa.array(keys))
        runs = pa.array([text[i : i + RUN] for i in range(0, len(text), RUN)], pa.string())
        return pa.RecordBatch.from_arrays([runs, pa.array(block[begin]), lists], names=["run", "block", "keys"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, piece in zip(batch.column("k").to_pylist(), batch.column("piece")):
                p = np.frombuffer(piece.as_py().encode("utf-32-le"), "<u4").astype(np.uint64)
                if len(p) < RUN:
                    continue
                codes = np.unique(p[:-2] << np.uint64(42) | p[1:-1] << np.uint64(21) | p[2:])
                held.append((key, codes))
                size += len(codes)
                if size >= PAIRS:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return work


def build_index(catalog: DataFrame, key: str, columns: list[str], folder: str) -> SubstringIndex:
    """Write an index of ``columns`` under ``folder``; ``key`` is a whole number that names an entry.

    A task sends one list per run, block and some ``PAIRS`` distinct runs of its texts. A new build becomes the
    one that ``open_index`` finds when its last, one-row table is written.
    """
    spark, build = catalog.sparkSession, uuid.uuid4().hex
    known = catalog.filter(quoted(key).isNotNull())
    texts = known.select(quoted(key).cast("bigint").alias("k"), _text(columns).alias("text"))
    pieces = F.transform(  # long texts in overlapping pieces, so that no row holds all its runs
        F.sequence(F.lit(0), F.floor(F.char_length("text") / PIECE).cast("int")), lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE + RUN - 1))
    )
    pairs = texts.select("k", F.explode(pieces).alias("piece")).mapInArrow(_listed(BLOCK.bit_length() - 1), "run string, block bigint, keys array<bigint>")
    # Dealt once, by the part and a hash that spreads its lists over several files of its folder; the lists are joined there.
    named = pairs.select(_part(F.col("run")).alias("part"), F.pmod(F.xxhash64("run", "block"), F.lit(4)).alias("deal"), "run", "block", "keys")
    keys = F.sort_array(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys")
    lists = named.repartition("part", "deal").groupBy("part", "deal", "run", "block").agg(keys)
    dealt = lists.select("part", "run", F.size("keys").cast("bigint").alias("n"), "keys").sortWithinPartitions("part", "run")
    dealt.write.partitionBy("part").parquet(f"{folder}/{build}/postings")
    about = known.select(F.countDistinct(quoted(key)).alias("entries")).select(
        F.lit(build).alias("build"), F.current_timestamp().alias("made"), F.lit(key).alias("key"), F.array(*map(F.lit, columns)).alias("columns"), "entries"
    )
    about.coalesce(1).write.mode("append").parquet(f"{folder}/builds")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> SubstringIndex:
    """The last finished build under ``folder``."""
    last = spark.read.parquet(f"{folder}/builds").orderBy(F.desc("made"), "build").first()
    schema = "run string, n bigint, keys array<bigint>, part int"
    postings = spark.read.schema(schema).parquet(f"{folder}/{last['build']}/postings")
    return SubstringIndex(postings, last["key"], tuple(last["columns"]), last["entries"])
