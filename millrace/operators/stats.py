"""Exact statistics that need no global sort: counts of values, ranks, modes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rows import data_columns, dtype_of, estimated_bytes, is_text, local_table, quoted
from ..session import checkpointed
from . import digests

# Values of one column that may be sorted, and steps of a histogram that narrows down the rest.
KEPT_VALUES = 100_000
BUCKETS = 1024
# Bins of the summary of frequent values, and the size up to which every value is counted outright.
BINS = 4096
PLAIN_BYTES = 256 << 20


def cells(df: DataFrame, columns: list[str], **parts) -> DataFrame:
    """One row per cell: ``column`` and the named expressions of each column."""
    structs = [
        F.struct(F.lit(c).alias("column"), *[make(c).alias(name) for name, make in parts.items()]) for c in columns
    ]
    return df.select(F.explode(F.array(*structs)).alias("_cell")).select("_cell.*")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` of non-null values; counts combine before the shuffle."""
    columns = data_columns(df) if columns is None else columns
    long = cells(df, columns, value=lambda c: quoted(c).cast("string"))
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct values per column, and distinct values when case is ignored."""
    columns = data_columns(df) if columns is None else columns
    if not exact:
        long = cells(df, columns, value=lambda c: quoted(c).cast("string"))
        return long.groupBy("column").agg(
            F.approx_count_distinct("value").alias("unique_count"),
            F.approx_count_distinct(F.lower("value")).alias("unique_folded"),
        )
    # Numbers are compared as such, which spares writing them out, and have no case.
    real = [c for c in columns if isinstance(dtype_of(df, c), (T.DoubleType, T.FloatType))]
    whole = [c for c in columns if isinstance(dtype_of(df, c), T.IntegralType)]
    texts = [c for c in columns if c not in real + whole]
    parts = [_distinct_numbers(df, names, dtype) for names, dtype in ((real, "double"), (whole, "bigint")) if names]
    return reduce(DataFrame.unionByName, parts + ([_distinct_texts(df, texts)] if texts or not parts else []))


def _distinct_numbers(df: DataFrame, columns: list[str], dtype: str) -> DataFrame:
    values = cells(df, columns, x=lambda c: quoted(c).cast(dtype)).filter(F.col("x").isNotNull()).distinct()
    return values.groupBy("column").agg(F.count("*").alias("unique_count"), F.count("*").alias("unique_folded"))


def _distinct_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    long = cells(df, columns, s=lambda c: quoted(c).cast("string")).filter(F.col("s").isNotNull())
    # long texts travel as digests, of the text and of its form without case
    low = F.lower("s")
    long_ = F.octet_length("s") > digests.LONG * 2 // 3  # a form without case has half as many bytes again at most
    keys = [digests.short_key(F.col("s")).alias("key"), digests.check(F.col("s")).alias("check")]
    keys += [F.when(long_, digests.short_key(low)).alias("low"), F.when(long_, digests.check(low)).alias("low_check")]
    values = long.select("column", *keys).distinct()
    form = F.coalesce("low", F.lower("key")).alias("form")
    folded = values.groupBy("column", form, F.coalesce("low_check", F.lit(0)).alias("form_check")).agg(F.count("*").alias("k"))
    return folded.groupBy("column").agg(
        F.sum("k").cast("bigint").alias("unique_count"), F.count("*").alias("unique_folded")
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5, plain_bytes: int | None = None) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller text."""
    columns = [c for c in data_columns(df) if is_text(dtype_of(df, c))] if columns is None else columns
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = frequent_values(df, columns, k, plain_bytes).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("column", F.col("rank").cast("bigint").alias("rank"), "value", "n")


def modes(df: DataFrame, columns: list[str], plain_bytes: int | None = None) -> dict[str, str]:
    """Most frequent text per column, ties to the smallest; missing if all NULL."""
    if not columns:
        return {}
    counted = frequent_values(df, columns, 1, plain_bytes)
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"))
    return {r["column"]: r["b"]["value"] for r in best.collect()}


def mode_of(df: DataFrame, column: str):
    """Most frequent value in the column's own type."""
    if is_text(dtype_of(df, column)):
        return modes(df, [column]).get(column)
    c = quoted(column)
    counts = df.select(c.alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(F.count("*").alias("n"))
    row = counts.orderBy(F.desc("n"), F.asc("v")).first()
    return None if row is None else row["v"]


def frequent_values(df: DataFrame, columns: list[str], k: int, plain_bytes: int | None = None) -> DataFrame:
    """(column, value, n) with exact counts: the ``k`` most frequent values per column are among them.

    A table up to ``plain_bytes`` is counted value by value. In a larger one the values are first
    counted in ``BINS`` bins by hash. A bin's count bounds that of each value in it from above, and a
    bin with one hash gives a value's count: bins below the k-th such count hold no candidate. Full
    bins with several values are split into as many again. Only the values of the bins that remain
    are counted one by one. A column for which the bins rule out little has many values of like
    frequency: its values are counted by digest, and only the texts of the winners are read.
    """
    limit = PLAIN_BYTES if plain_bytes is None else plain_bytes
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return value_counts(df, columns)
    long = cells(df, columns, value=lambda c: quoted(c).cast("string")).filter(F.col("value").isNotNull())
    h = F.xxhash64("value")
    long = long.withColumns({"bin": F.pmod(h, F.lit(BINS)).cast("int"), "sub": F.pmod(F.shiftright(h, 24), F.lit(BINS)).cast("int")})
    summary = [F.count("*").alias("n"), F.min(h).alias("a"), F.max(h).alias("b")]
    bins: dict[str, list] = {}
    for row in long.groupBy("column", "bin").agg(*summary).toLocalIterator():
        bins.setdefault(row["column"], []).append(row)
    kept, split, open_columns, least = [], [], [], {}
    for c, rows in bins.items():
        least[c] = _kth([r["n"] for r in rows if r["a"] == r["b"]], k)
        full = [r for r in rows if r["n"] >= least[c]]
        mixed = [r for r in full if r["a"] != r["b"]]
        if len(mixed) > BINS // 2:
            open_columns.append(c)
            continue
        kept += [(c, r["bin"], -1) for r in full if r["a"] == r["b"]]
        split += [(c, r["bin"], least[c]) for r in mixed]
    spark = df.sparkSession
    if split:
        within = long.join(F.broadcast(local_table(spark, split, "column string, bin int, least bigint")), ["column", "bin"])
        again: dict[str, list] = {}
        for row in within.groupBy("column", "bin", "sub", "least").agg(*summary).filter("n >= least").toLocalIterator():
            again.setdefault(row["column"], []).append(row)
        for c, rows in again.items():
            known = [r["n"] for r in bins[c] if r["a"] == r["b"]] + [r["n"] for r in rows if r["a"] == r["b"]]
            bound = _kth(known, k)
            kept += [(c, r["bin"], r["sub"]) for r in rows if r["n"] >= bound]
    out = None
    if kept:
        chosen = local_table(spark, kept, "column string, bin int, only int")
        mine = long.join(F.broadcast(chosen), ["column", "bin"]).filter("only IN (-1, sub)")
        out = mine.groupBy("column", "value").agg(F.count("*").alias("n"))
    if open_columns:
        many = _by_digest(long.filter(F.col("column").isin(open_columns)), k)
        out = many if out is None else out.unionByName(many)
    return value_counts(df, columns) if out is None else out


def _kth(counts: list[int], k: int) -> int:
    return sorted(counts, reverse=True)[k - 1] if len(counts) >= k else 1


def _by_digest(long: DataFrame, k: int) -> DataFrame:
    """Candidates of columns with many values: counted by digest, texts read for the winners alone.

    Of values that all occur once the smallest texts win: each task offers its own ``k`` smallest."""
    keyed = long.select("column", "value", digests.short_key(F.col("value")).alias("key"), digests.check(F.col("value")).alias("check"))
    counts = keyed.groupBy("column", "key", "check").agg(F.count("*").alias("n"))
    order = W.partitionBy("column").orderBy(F.desc("n"), "key", "check")
    best = checkpointed(counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k))
    bound = {r["column"]: r["n"] for r in best.groupBy("column").agg(F.min("n").alias("n")).collect()}
    several = best.filter("n > 1").select("column", "key", "check")  # k rows a column at most
    if any(n > 1 for n in bound.values()):
        limits = F.broadcast(local_table(long.sparkSession, list(bound.items()), "column string, bound bigint"))
        several = counts.join(limits, "column").filter("n >= bound AND bound > 1").select("column", "key", "check").unionByName(several).distinct()
    winners = keyed.join(several, ["column", "key", "check"], "left_semi").groupBy("column", "value").agg(F.count("*").alias("n"))
    once = [c for c, n in bound.items() if n == 1]
    if not once:
        return winners
    single = keyed.filter(F.col("column").isin(once)).join(F.broadcast(best.filter("n > 1").select("column", "key", "check")), ["column", "key", "check"], "left_anti")
    smallest = single.withColumn("r", F.row_number().over(W.partitionBy("column").orderBy("value"))).filter(F.col("r") <= k)
    return winners.unionByName(smallest.select("column", "value", F.lit(1).cast("bigint").alias("n")))


@dataclass(frozen=True)
class Ranks:
    """Order statistics wanted of one numeric expression (1-based ranks)."""

    name: str
    value: Column
    count: int
    ranks: tuple[int, ...]
    low: float | None = None
    high: float | None = None


def median_ranks(n: int) -> tuple[int, ...]:
    return ((n + 1) // 2, n // 2 + 1)


@dataclass
class _Target:
    """One rank, the values between which it must lie, and how many values are below and inside."""

    wanted: Ranks
    rank: int
    low: float
    high: float
    below: int
    inside: int


def order_statistics(df: DataFrame, wanted: list[Ranks], keep: int = KEPT_VALUES) -> dict[str, list[float]]:
    """Exact values at the given ranks, for many columns side by side.

    Every pass counts the values between the bounds in ``BUCKETS`` equal steps, with the least
    and the greatest value of each step, and the step that holds the rank gives the next bounds.
    A task sends at most ``BUCKETS`` short rows per rank, whatever the size or skew of the
    table. Once at most ``keep`` values are left, these are sorted.
    """
    wanted = [w for w in wanted if w.count > 0]
    if not wanted:
        return {}
    # given bounds are hints: only few values are sorted by them, and a miss is made good below
    open_ = [w for w in wanted if w.low is None or w.high is None or w.count > keep]
    ends = df.agg(*[x for i, w in enumerate(open_) for x in (F.min(w.value).alias(f"a{i}"), F.max(w.value).alias(f"b{i}"))]).first() if open_ else None
    bounds = {w.name: (ends[f"a{i}"], ends[f"b{i}"]) for i, w in enumerate(open_)}
    bounds |= {w.name: (w.low, w.high) for w in wanted if w.name not in bounds}
    targets = [_Target(w, r, *map(float, bounds[w.name]), 0, w.count) for w in wanted for r in dict.fromkeys(w.ranks)]
    found: dict[tuple[str, int], float] = {}
    while wide := [t for t in targets if t.inside > keep and t.low < t.high and math.isfinite(t.high - t.low)]:
        steps: dict[int, list] = {}
        for row in _histogram(df, wide).toLocalIterator():
            steps.setdefault(row["i"], []).append(row)
        for i, t in enumerate(wide):
            for row in sorted(steps.get(i, []), key=lambda x: x["bucket"]):
                if t.rank <= t.below + row["n"]:
                    if t.rank == t.below + 1 or t.rank == t.below + row["n"] or row["low"] == row["high"]:
                        found[t.wanted.name, t.rank] = row["low"] if t.rank == t.below + 1 else row["high"]
                    t.low, t.high, t.inside = row["low"], row["high"], row["n"]
                    break
                t.below += row["n"]
        targets = [t for t in targets if (t.wanted.name, t.rank) not in found]
    rest = [Ranks(f"{k}", t.wanted.value, t.wanted.count, (t.rank,), t.low, t.high) for k, t in enumerate(targets)]
    picked = _pick(df, rest) if rest else {}
    found |= {(t.wanted.name, t.rank): picked[str(k)][0] for k, t in enumerate(targets) if str(k) in picked}
    missed = [Ranks(str(k), t.wanted.value, t.wanted.count, (t.rank,), -math.inf, math.inf) for k, t in enumerate(targets) if str(k) not in picked]
    if missed:
        again = _pick(df, missed)
        found |= {(targets[int(k)].wanted.name, targets[int(k)].rank): v[0] for k, v in again.items()}
    return {w.name: [found[w.name, r] for r in w.ranks] for w in wanted if all((w.name, r) in found for r in w.ranks)}


def _histogram(df: DataFrame, targets: list[_Target]) -> DataFrame:
    """(i, bucket, n, low, high) of the values between each target's bounds."""
    cells = []
    for i, t in enumerate(targets):
        v = t.wanted.value
        step = F.floor((v - F.lit(t.low)) / F.lit(t.high - t.low) * BUCKETS)
        inside = v.between(F.lit(t.low), F.lit(t.high))
        cells.append(F.struct(F.lit(i).alias("i"), F.when(inside, F.least(step, F.lit(BUCKETS - 1))).alias("bucket"), v.alias("v")))
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("bucket IS NOT NULL")
    return long.groupBy("i", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def _pick(df: DataFrame, wanted: list[Ranks]) -> dict[str, list[float]]:
    structs = [
        F.struct(
            F.lit(i).alias("i"),
            (w.value >= F.lit(w.low)).alias("inside"),
            F.when(w.value >= F.lit(w.low), w.value).alias("v"),
            (w.value <= F.lit(w.high)).alias("use"),
        )
        for i, w in enumerate(wanted)
    ]
    long = df.select(F.explode(F.array(*structs)).alias("c")).select("c.*").filter("use")
    counts = long.groupBy("i", "v").agg(F.count("*").alias("n"))
    run = W.partitionBy("i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("n").over(run))
    want = F.create_map(
        *[x for i, w in enumerate(wanted) for x in (F.lit(i), F.array(*[F.lit(int(r)) for r in w.ranks]))]
    )
    hits = (
        placed.filter(F.exists(want[F.col("i")], lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n"))))
        .select("i", "v", "n", "upto")
        .collect()
    )
    out: dict[str, list[float]] = {}
    for i, w in enumerate(wanted):
        mine = [h for h in hits if h["i"] == i]
        values = [next((h["v"] for h in mine if h["upto"] - h["n"] < r <= h["upto"]), None) for r in w.ranks]
        if all(v is not None for v in values):
            out[w.name] = values
    return out


def medians(df: DataFrame, facts: dict[str, dict], columns: list[str], value) -> dict[str, float]:
    """Exact medians of columns whose facts hold a count and the bounds."""
    wanted = []
    for c in columns:
        f = facts[c]
        n = f["num_count"]
        if n:
            wanted.append(Ranks(c, value(c), n, median_ranks(n), f.get("num_min"), f.get("num_max")))
    return {c: sum(v) / len(v) for c, v in order_statistics(df, wanted).items()}
