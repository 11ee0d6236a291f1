"""Before/after comparison of two versions of a table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..rows import as_double, data_columns, dtype_of, is_number, local_table, quoted
from . import facts as facts_
from . import ranges, stats


def _common(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in data_columns(before) if c in data_columns(after)]


def numeric_in_both(before: DataFrame, after: DataFrame) -> list[str]:
    return [
        c for c in _common(before, after) if is_number(dtype_of(before, c)) and is_number(dtype_of(after, c))
    ]


def diff_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed, retyped or unchanged, per column of either table."""
    b = {c: dtype_of(before, c).simpleString() for c in data_columns(before)}
    a = {c: dtype_of(after, c).simpleString() for c in data_columns(after)}
    rows = []
    for c in [*b, *[c for c in a if c not in b]]:
        state = "added" if c not in b else "removed" if c not in a else "same" if a[c] == b[c] else "type_changed"
        rows.append((c, state, b.get(c), a.get(c)))
    return local_table(before.sparkSession, rows, "column string, state string, type_before string, type_after string")


def diff_rows(before: DataFrame, after: DataFrame, before_totals: DataFrame | None = None, after_totals: DataFrame | None = None) -> DataFrame:
    """Row, column and duplicate counts of both sides with their changes, one row. Totals that
    are known already are not counted again."""
    b = before_totals if before_totals is not None else facts_.table_totals(before)
    a = after_totals if after_totals is not None else facts_.table_totals(after)
    b = b.select([F.col(c).alias(f"{c}_b") for c in ("rows", "cols", "duplicate_rows")])
    a = a.select([F.col(c).alias(f"{c}_a") for c in ("rows", "cols", "duplicate_rows")])
    both = b.withColumn("one", F.lit(1)).join(a.withColumn("one", F.lit(1)), "one")
    return both.select(
        F.col("rows_b").alias("row_count_before"), F.col("rows_a").alias("row_count_after"),
        (F.col("rows_a") - F.col("rows_b")).alias("row_delta"),
        percent(F.col("rows_a") - F.col("rows_b"), F.col("rows_b")).alias("row_delta_pct"),
        F.col("cols_b").alias("col_count_before"), F.col("cols_a").alias("col_count_after"),
        F.col("duplicate_rows_b").alias("duplicate_before"), F.col("duplicate_rows_a").alias("duplicate_after"),
        (F.col("duplicate_rows_a") - F.col("duplicate_rows_b")).alias("duplicate_delta"),
    )


def _sides(before: DataFrame, after: DataFrame, columns: list[str], **parts) -> DataFrame:
    """Cells of both versions, marked 0 for before and 1 for after."""
    out = None
    for side, df in ((0, before), (1, after)):
        mine = [c for c in columns if c in df.columns]
        if not mine:
            continue
        long = stats.cells(df, mine, **{k: (lambda c, d=df, v=v: v(d, c)) for k, v in parts.items()})
        long = long.withColumn("side", F.lit(side))
        out = long if out is None else out.unionByName(long)
    return out


def _of(side: int, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def column_sums(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing cells and number figures of both sides, one pass over each table."""
    columns = list(dict.fromkeys(data_columns(before) + data_columns(after)))
    nothing = F.lit(None).cast("double")
    long = _sides(
        before, after, columns,
        gone=lambda d, c: quoted(c).isNull().cast("bigint"),
        x=lambda d, c: as_double(d, c) if is_number(dtype_of(d, c)) else nothing,
    )
    x = F.col("x")
    return long.groupBy("column").agg(
        F.sum(_of(0, F.col("gone"))).alias("null_b"), F.sum(_of(1, F.col("gone"))).alias("null_a"),
        F.count(_of(0, F.lit(1))).alias("rows_b"),
        F.avg(_of(0, x)).alias("mean_before"), F.avg(_of(1, x)).alias("mean_after"),
        F.min(_of(0, x)).alias("min_before"), F.min(_of(1, x)).alias("min_after"),
        F.max(_of(0, x)).alias("max_before"), F.max(_of(1, x)).alias("max_after"),
    )


def known_sums(before: DataFrame, after: DataFrame, was: dict[str, dict], now: dict[str, dict]) -> DataFrame:
    """What ``column_sums`` counts, from the column facts of both sides."""
    rows = []
    for c in dict.fromkeys(data_columns(before) + data_columns(after)):
        b, a = ({} if not side.get(c) or not side[c]["row_count"] else side[c] for side in (was, now))
        if not b and not a:
            continue
        x, y = (f if f.get("kind") == "number" else {} for f in (b, a))
        figures = [side.get(k) for k in ("num_mean", "num_min", "num_max") for side in (x, y)]
        rows.append((c, b.get("null_count"), a.get("null_count"), b.get("row_count", 0), *figures))
    return local_table(
        before.sparkSession, rows, "column string, null_b bigint, null_a bigint, rows_b bigint, mean_before double, mean_after double,"
        " min_before double, min_after double, max_before double, max_after double",
    )


def known_ends(columns: list[str], was: dict[str, dict], now: dict[str, dict]) -> list[tuple]:
    """(column, n, low, high) of the numbers of both sides together, from their column facts."""
    out = []
    for c in columns:
        sides = [f[c] for f in (was, now) if f[c]["num_count"]]
        if sides:
            out.append((c, sum(f["num_count"] for f in sides), min(f["num_min"] for f in sides), max(f["num_max"] for f in sides)))
    return out


def same_distribution(df: DataFrame, columns: list[str], held: dict[str, dict]) -> DataFrame:
    """What ``diff_distribution`` finds for columns with the same cells on both sides."""
    rows = [(c, n, n, 0.0, 1.0) for c in columns if is_number(dtype_of(df, c)) and (n := held[c]["num_count"]) > 1]
    return local_table(df.sparkSession, rows, "column string, n_before bigint, n_after bigint, ks_stat double, ks_pvalue double")


def diff_nulls(before: DataFrame, after: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Missing cells per column of the new table; NULL before for new columns."""
    sums = column_sums(before, after) if sums is None else sums
    fresh = [c for c in data_columns(after) if c not in data_columns(before)]
    listing = local_table(before.sparkSession, 
        [(c, c in fresh) for c in data_columns(after)], "column string, fresh boolean"
    )
    n = listing.join(sums, "column", "left_outer")
    old = ~F.col("fresh")
    b = F.when(old, F.coalesce("null_b", F.lit(0)))
    a = F.coalesce(F.col("null_a"), F.lit(0))
    return n.select(
        "column", b.alias("null_before"), a.alias("null_after"), (a - b).alias("delta"),
        F.when(old, percent(a - b, F.col("rows_b"))).alias("delta_pct"),
    )


def diff_drift(before: DataFrame, after: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """Mean, minimum and maximum of both sides and the drift of the mean in percent."""
    sums = column_sums(before, after) if sums is None else sums
    drift = F.round(F.try_divide(F.col("mean_after") - F.col("mean_before"), F.abs("mean_before")) * 100, 2)
    return sums.filter(F.col("column").isin(numeric_in_both(before, after))).select(
        "column", "mean_before", "mean_after", drift.alias("drift_pct"), "min_before", "min_after", "max_before", "max_after"
    )


def diff_categories(before: DataFrame, after: DataFrame, samples: int = 20) -> DataFrame:
    """Values of non-numeric columns found on one side only: true counts, small samples."""
    columns = [c for c in _common(before, after) if not is_number(dtype_of(before, c))]
    schema = "column string, added_count bigint, removed_count bigint, added_values array<string>, removed_values array<string>"
    if not columns:
        return local_table(before.sparkSession, [], schema)
    long = _sides(before, after, columns, value=lambda d, c: quoted(c).cast("string"))
    seen = (
        long.filter(F.col("value").isNotNull()).groupBy("column", "value")
        .agg(F.min("side").alias("first_side"), F.max("side").alias("last_side"))
        .filter(F.col("first_side") == F.col("last_side"))
        .select("column", "value", (F.col("first_side") == 1).alias("added"))
    )
    totals = seen.groupBy("column").agg(
        F.count_if("added").alias("added_count"), F.count_if(~F.col("added")).alias("removed_count")
    )
    ranked = seen.withColumn("k", F.row_number().over(W.partitionBy("column", "added").orderBy("value")))
    few = ranked.filter(F.col("k") <= samples).groupBy("column").agg(
        F.array_sort(F.collect_list(F.when(F.col("added"), F.col("value")))).alias("added_values"),
        F.array_sort(F.collect_list(F.when(~F.col("added"), F.col("value")))).alias("removed_values"),
    )
    return totals.join(few, "column")


def diff_distribution(
    before: DataFrame, after: DataFrame, columns: list[str] | None = None, rows_per_range: int = ranges.ROWS_PER_RANGE,
    ends: list[tuple] | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D and p per number column, over all rows; ``ends`` as for ``cut_points``.

    Values are counted per side, cut into ranges by value, and summed inside each
    range; the sums of the ranges before come from a table with one row per range.
    """
    columns = numeric_in_both(before, after) if columns is None else columns
    schema = "column string, n_before bigint, n_after bigint, ks_stat double, ks_pvalue double"
    if not columns:
        return local_table(before.sparkSession, [], schema)
    long = _sides(before, after, columns, x=as_double).filter(F.col("x").isNotNull())
    counts = long.groupBy("column", "x").agg(
        F.count(_of(0, F.lit(1))).alias("b"), F.count(_of(1, F.lit(1))).alias("a")
    )
    cuts = ranges.cut_points(_sides(before, after, columns, x=as_double), rows_per_range, ends)
    counts = ranges.with_range(counts, cuts, F.col("x"), F.col("column"))
    sums = counts.groupBy("column", "_range").agg(F.sum("b").alias("sb"), F.sum("a").alias("sa"))
    order = W.partitionBy("column").orderBy("_range")
    before_range = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("column")
    starts = sums.select(
        "column", "_range",
        *[F.coalesce(F.sum(s).over(before_range), F.lit(0)).alias(f"{s}_start") for s in ("sb", "sa")],
        *[F.sum(s).over(whole).alias(f"{s}_all") for s in ("sb", "sa")],
    )
    run = W.partitionBy("column", "_range").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.join(starts, ["column", "_range"])
    share = lambda side, s: F.try_divide(
        (F.sum(side).over(run) + F.col(f"{s}_start")).cast("double"), F.col(f"{s}_all").cast("double")
    )
    d = placed.withColumn("d", F.abs(share("b", "sb") - share("a", "sa")))
    g = d.groupBy("column").agg(
        F.max("sb_all").alias("n_before"), F.max("sa_all").alias("n_after"), F.max("d").alias("ks_raw")
    ).filter((F.col("n_before") > 1) & (F.col("n_after") > 1))
    return g.select(
        "column", "n_before", "n_after", F.round("ks_raw", 4).alias("ks_stat"),
        F.round(ks_pvalue(F.col("ks_raw"), F.col("n_before"), F.col("n_after")), 4).alias("ks_pvalue"),
    )


# Cells of the lattice up to which the p value is counted exactly; beyond it is the asymptotic one.
EXACT_CELLS = 4_000_000


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Two-sided p value of the statistic: exact for samples of up to EXACT_CELLS cells, (n + m)
    times the smaller of them, else the asymptotic series."""
    cells = (n + m) * (F.least(n, m) + 1)
    return F.when(cells <= EXACT_CELLS, ks_exact(d, n, m)).otherwise(ks_asymptotic(d, n, m))


def ks_exact(d: Column, n: Column, m: Column) -> Column:
    """Share of the orders of n and m values whose statistic reaches d.

    An order is a lattice path from (0, 0) to (n, m). Step by step the chance to be at each point
    (i of the smaller sample, t - i of the larger) without having been off the diagonal by d moves
    on; what reaches the distance leaves. Distances are whole numbers, i * large - j * small."""
    small, large = F.least(n, m).cast("double"), F.greatest(n, m).cast("double")
    total, reach = small + large, F.round(d * small * large)
    first = F.transform(F.sequence(F.lit(0), F.least(n, m).cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))

    def step(at: Column, t: Column) -> Column:
        def moved(v: Column, i: Column) -> Column:
            j = t - i
            stay = v * (large - j + 1)
            come = F.coalesce(F.get(at, i - 1), F.lit(0.0)) * (small - i + 1)
            inside = (j >= 0) & (j <= large) & (F.abs(i * large - j * small) < reach - 0.5)
            return F.when(inside, (stay + come) / (total - t + 1)).otherwise(0.0)

        return F.transform(at, moved)

    staying = F.aggregate(F.sequence(F.lit(1), (n + m).cast("int")), first, step, lambda at: F.element_at(at, -1))
    return F.when(reach < 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - staying))


def ks_asymptotic(d: Column, n: Column, m: Column) -> Column:
    """Limit of the p value (alternating exponential series)."""
    n, m = n.cast("double"), m.cast("double")
    effective = F.sqrt(n * m / (n + m))
    x = effective * d
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * terms)))


def largest_null_changes(nulls: DataFrame, k: int = 10) -> DataFrame:
    """The k columns whose number of missing cells changed most."""
    return nulls.filter(F.col("delta") != 0).orderBy(F.abs("delta").desc(), "column").limit(k)


def largest_drifts(drift: DataFrame, k: int = 8, over_pct: float = 1.0) -> DataFrame:
    """The k columns whose mean moved most, beyond a small tolerance."""
    return drift.filter(F.abs("drift_pct") > over_pct).orderBy(F.abs("drift_pct").desc(), "column").limit(k)


def top_null_columns(nulls: DataFrame, rows: int, k: int = 10) -> DataFrame:
    """The k columns with most missing cells, their share and a traffic-light band."""
    pct = percent(F.col("null_count"), F.lit(rows), 1)
    top = nulls.filter(F.col("null_count") > 0).orderBy(F.desc("null_count"), "column").limit(k)
    return top.select(
        "column", "null_count", pct.alias("null_pct"),
        F.when(pct > 50, "red").when(pct > 20, "amber").otherwise("green").alias("band"),
    )
