"""Filling missing values. One aggregate decides, a plain projection fills."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, numbers
from ..rows import as_double, data_columns, dtype_of, is_number, is_text, quoted, require_columns, together
from . import facts as facts_
from . import stats
from .ordered import carry_fill


@dataclass(frozen=True)
class Fill:
    """One decision: which column gets which value, and why."""

    column: str
    method: str
    value: Any
    missing: int = 0
    missing_pct: float = 0.0
    skewness: float | None = None
    numeric: bool = False


def number_view(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; text that is no plain number becomes NULL."""
    if is_number(dtype_of(df, name)):
        return as_double(df, name)
    return numbers.parse_number(quoted(name).cast("string"))


def _as_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: number_view(df, n) for n in names}) if names else df


def apply_fills(df: DataFrame, fills: list[Fill]) -> DataFrame:
    changed = {}
    for f in fills:
        if f.value is None:
            continue
        c = number_view(df, f.column) if f.numeric else quoted(f.column)
        changed[f.column] = F.coalesce(c, F.lit(f.value))
    return df.withColumns(changed) if changed else df


def decide_fills(df: DataFrame, columns: list[str], min_numeric_share: float = 0.5) -> list[Fill]:
    """Automatic choice per column with missing cells.

    Mostly numeric columns get the mean if the skew is mild, else the median;
    other columns get their most frequent value, or ``Unknown`` if they have none.
    """
    held = facts_.collect_facts(
        facts_.column_facts(df, columns, frozenset({facts_.NUMBERS, facts_.BRACKET}))
    )
    numeric, text = [], []
    for c in columns:
        f = held[c]
        if not f["null_count"]:
            continue
        share = f["num_count"] / f["row_count"] if f["row_count"] else 0
        (numeric if f["kind"] == "number" or share >= min_numeric_share else text).append(c)
    skewed = [c for c in numeric if abs(held[c]["num_skew"] or 0.0) >= fixed.SYMMETRIC_SKEW]
    middle, common = together(
        lambda: stats.medians(df, held, skewed, lambda c: number_view(df, c)), lambda: stats.modes(df, text)
    )
    fills = []
    for c in numeric + text:
        f = held[c]
        missing = f["row_count"] - f["num_count"] if c in numeric else f["null_count"]
        info = dict(missing=missing, missing_pct=round(100 * missing / f["row_count"], 2))
        if c in text:
            fills.append(Fill(c, "mode" if c in common else "constant", common.get(c, "Unknown"), **info))
        elif c in skewed:
            fills.append(Fill(c, "median", middle.get(c), skewness=f["num_skew"], numeric=True, **info))
        else:
            fills.append(Fill(c, "mean", f["num_mean"], skewness=f["num_skew"], numeric=True, **info))
    return fills


def fill_missing(
    df: DataFrame,
    column: str | None = None,
    method: str = "auto",
    value: Any = "",
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Fill one column, or with no column every column that has missing cells."""
    if not column:
        return apply_fills(df, decide_fills(df, data_columns(df)))
    require_columns(df, [column], "Column")
    if method in ("ffill", "bfill"):
        return carry_fill(df, column, forward=method == "ffill", partition_by=partition_by)
    if method == "auto":
        return _fill_auto(df, column)
    if method in ("mean", "median"):
        return _fill_statistic(df, column, method)
    if method == "mode":
        best = stats.mode_of(df, column)
        return df if best is None else df.withColumn(column, F.coalesce(quoted(column), F.lit(best)))
    dt = dtype_of(df, column)
    literal = F.lit(value).cast("string") if is_text(dt) else F.lit(value).try_cast(dt.simpleString())
    return df.withColumn(column, F.coalesce(quoted(column), literal))


def _fill_auto(df: DataFrame, column: str) -> DataFrame:
    fills = decide_fills(df, [column])
    if fills:
        return apply_fills(df, fills)
    return df


def _fill_statistic(df: DataFrame, column: str, method: str) -> DataFrame:
    parts = frozenset({facts_.NUMBERS, facts_.BRACKET} if method == "median" else {facts_.NUMBERS})
    f = facts_.collect_facts(facts_.column_facts(df, [column], parts))
    one = f[column]
    share = one["num_count"] / one["row_count"] if one["row_count"] else 0
    if one["kind"] != "number" and share < 0.5:
        raise ValueError(f"{method} needs a mostly numeric column, {column!r} is not")
    if method == "mean":
        value = one["num_mean"]
    else:
        value = stats.medians(df, f, [column], lambda c: number_view(df, c)).get(column)
    return apply_fills(df, [Fill(column, method, value, numeric=True)]) if value is not None else _as_numeric(df, [column])
