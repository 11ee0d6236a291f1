"""Cutting an order into ranges of similar size: many ranks at once, by refined histograms.

``cut_points`` counts the values of a column in ``BUCKETS`` steps between its ends. A step with
more rows than a range should hold is counted again in as many steps between its own least and
greatest value, all such steps of all columns in one pass, until every step is small or holds a
single value. A task sends at most ``BUCKETS`` short rows per open step, so neither skew nor the
number of ranks makes a task grow, and the cuts are exact: no range holds more than twice the
wanted rows unless a single value does.

``with_range`` gives each row the number of its range by a search tree over the cuts: each level
is a small table that is joined, with ``FANOUT`` cuts a node.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rows import local_table
from ..session import checkpointed

ROWS_PER_RANGE = 1_000_000
BUCKETS = 1024
FANOUT = 32

Cuts = dict[str, list[float]]


def _spread(x: Column) -> Column:
    """Monotone, and alike for values of any size: the first pass steps by orders of magnitude."""
    return F.signum(x) * F.log1p(F.abs(x))


def _half(x: Column) -> Column:
    return x / 2  # the distance between the largest doubles is finite


def cut_points(long: DataFrame, rows_per_range: int = ROWS_PER_RANGE, ends: list[tuple] | None = None) -> Cuts:
    """Least values of the ranges per column, the first as -inf, for rows of (column, x double).

    ``ends`` are (column, n, low, high) where these are known, which spares a pass. The list grows with rows / ``rows_per_range``; single passes are bounded as said above."""
    usable = long.select("column", "x").filter(F.abs("x") < F.lit(math.inf))
    if ends is None or not all(math.isfinite(v) for _, _, *bounds in ends for v in bounds):
        ends = usable.groupBy("column").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    start = [(c, "", 0, low, high) for c, n, low, high in ends if n > rows_per_range and low < high]
    if not start:
        return {}
    open_ = local_table(long.sparkSession, start, "column string, step string, before bigint, low double, high double")
    located, leaves, scale = usable.join(open_, "column"), [], _spread
    while True:
        x, low, high = (scale(F.col(c)) for c in ("x", "low", "high"))
        bucket = F.when(high > low, F.least(F.floor((x - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0)
        located = located.withColumn("bucket", bucket.cast("int"))
        counted = located.groupBy("column", "step", "before", "bucket").agg(
            F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
        )
        inside = W.partitionBy("column", "step").orderBy("bucket")  # at most BUCKETS rows
        steps = checkpointed(counted.withColumn("from", F.col("before") + F.sum("n").over(inside) - F.col("n")))
        wide = (F.col("n") > rows_per_range) & (F.col("low") < F.col("high"))
        # a value with more rows than a range has one to itself: nothing after it begins in the same stretch
        place = F.expr(f"2 * (`from` div {rows_per_range}) + CAST(n > {rows_per_range} AS INT)")
        leaves.append(steps.filter(~wide).select("column", place.alias("range"), "low"))
        again = steps.filter(wide)
        if not again.limit(1).count():
            break
        again = again.select("column", "step", "bucket", F.col("from").alias("before"), "low", "high")
        located = located.drop("before", "low", "high").join(again, ["column", "step", "bucket"])
        located = located.select("column", "x", F.concat_ws(".", "step", "bucket").alias("step"), "before", "low", "high")
        scale = _half
    found: Cuts = {}
    cuts = reduce(DataFrame.unionByName, leaves).groupBy("column", "range").agg(F.min("low").alias("low"))
    for row in cuts.toLocalIterator():
        found.setdefault(row["column"], []).append(row["low"])
    return {c: [-math.inf, *sorted(lows)[1:]] for c, lows in found.items()}


def with_range(df: DataFrame, cuts: Cuts, x: Column, column: Column | None = None, name: str = "_range") -> DataFrame:
    """Number of the range each row falls in; rows of other columns and without a value are in range 0."""
    largest = max(map(len, cuts.values()), default=0)
    levels = math.ceil(math.log(largest, FANOUT) - 1e-9) if largest > 1 else 0
    out = df.withColumn(name, F.lit(0))
    if not levels:
        return out
    x, of = x.cast("double"), "_cut_of"
    out = out.withColumns({"_cut_x": x, of: F.lit("") if column is None else column})
    for level in reversed(range(levels)):
        unit, rows = FANOUT**level, []
        for c, lows in cuts.items():
            heads = lows[::unit]
            rows += [(c, i // FANOUT, heads[i : i + FANOUT]) for i in range(0, len(heads), FANOUT)]
        if column is None and level == levels - 1:  # one node
            out = out.withColumn("_cut_lows", F.lit(rows[0][2]).cast("array<double>"))
        else:
            kept, keys = (slice(1, 3), [name]) if column is None else (slice(0, 3), [of, name])
            schema = ", ".join([f"{of} string", f"{name} int", "_cut_lows array<double>"][kept])
            out = out.join(local_table(df.sparkSession, [r[kept] for r in rows], schema), keys, "left_outer")
        child = F.col(name) * FANOUT + F.greatest(F.size(F.filter("_cut_lows", lambda v: v <= F.col("_cut_x"))) - 1, F.lit(0))
        out = out.withColumn(name, F.when(F.col("_cut_lows").isNull(), 0).otherwise(child)).drop("_cut_lows")
    return out.select(*df.columns, name)
