"""Anomalies of a step from its diff, and explanations for them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import local_table, settled, together
from . import diff as diff_
from .causes import in_words
from .cells import split
from .issues import Evidence


@dataclass(frozen=True)
class Thresholds:
    """Limits of the anomaly rules (fixed default values, in percent unless named otherwise)."""

    row_drop_pct: float = 30
    row_drop_pct_critical: float = 70
    row_increase_pct: float = 50
    null_increase_pct: float = 20
    null_mostly_threshold: float = 80
    duplicate_spike_pct: float = 50
    duplicates_appeared: int = 10
    stat_drift_pct: float = 50
    ks_stat_threshold: float = 0.3
    ks_pvalue_threshold: float = 0.05
    category_disappear: int = 3


@dataclass
class Diff:
    """The comparison of a step, one small DataFrame per aspect."""

    rows: DataFrame
    columns: DataFrame
    nulls: DataFrame
    drift: DataFrame
    categories: DataFrame | None = None
    distribution: DataFrame | None = None


def compute_diff(
    before: DataFrame, after: DataFrame, full: bool = True, totals: DataFrame | None = None, unchanged: bool = False,
    known: tuple[Evidence, Evidence] | None = None, kept: tuple[str, ...] = (),
) -> Diff:
    """Compare two versions; ``full`` adds value shifts and distributions.

    The comparisons run side by side, once. Each result has at most a row per column. ``totals``
    are those of ``before`` if they are known; they hold for ``after`` too if it is ``unchanged``,
    that is, has the same rows in any order. ``known`` is the evidence of both versions, which is
    not counted again then; columns that are ``kept`` have the same cells in both.
    """
    was, now, before, after = before, after, split(before), split(after)
    sums_of, ends, new_totals = lambda: diff_.column_sums(before, after), None, totals if unchanged else None
    if known:
        totals, new_totals = (_totals(df, found) for df, found in zip((before, after), known))
        sums_of = lambda: diff_.known_sums(before, after, known[0].held, known[1].held)
    work = [lambda: settled(diff_.diff_rows(before, after, totals, new_totals)), lambda: settled(sums_of())]
    if full and not (known and kept):
        kept = ()
    if full:
        left, right = before.drop(*kept), after.drop(*kept)
        numbers = diff_.numeric_in_both(left, right)
        ends = diff_.known_ends(numbers, known[0].held, known[1].held) if known else None

        def distribution_() -> DataFrame:
            found = diff_.diff_distribution(left, right, numbers, ends=ends)
            return found.unionByName(diff_.same_distribution(before, kept, known[0].held)) if kept else found

        work += [lambda: settled(diff_.diff_categories(left, right)), lambda: settled(distribution_())]
    rows, sums, *more = together(*work)
    categories, distribution = more if full else (None, None)
    return Diff(
        rows=rows,
        columns=diff_.diff_columns(was, now),
        nulls=settled(diff_.diff_nulls(before, after, sums)),
        drift=settled(diff_.diff_drift(before, after, sums)),
        categories=categories,
        distribution=distribution,
    )


def _totals(df: DataFrame, found: Evidence) -> DataFrame:
    return local_table(df.sparkSession, [(found.rows, len(found.held), found.duplicate_rows)], "rows bigint, cols bigint, duplicate_rows bigint")


def totals_after(d: Diff) -> DataFrame:
    """The totals of the new version, which are those of the old one in the next comparison."""
    return settled(d.rows.select(
        F.col("row_count_after").alias("rows"), F.col("col_count_after").alias("cols"), F.col("duplicate_after").alias("duplicate_rows")
    ))


ANOMALY_COLUMNS = ("type", "severity", "column", "value", "threshold", "message")


def _row(kind, severity, column, value, threshold, message: Column) -> list[Column]:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [
        as_col(kind).cast("string").alias("type"), as_col(severity).cast("string").alias("severity"),
        as_col(column).cast("string").alias("column"), as_col(value).cast("double").alias("value"),
        as_col(threshold).cast("double").alias("threshold"), message.alias("message"),
    ]


def detect_anomalies(d: Diff, step_name: str = "", limits: Thresholds = Thresholds()) -> DataFrame:
    """All anomalies of one step: ``type, severity, column, value, threshold, message``."""
    t, step = limits, F.lit(step_name)
    pct = F.col("row_delta_pct")
    grown = F.try_divide(F.col("duplicate_delta").cast("double"), F.col("duplicate_before").cast("double")) * 100
    critical = pct <= -t.row_drop_pct_critical
    found = [
        d.rows.filter(pct <= -t.row_drop_pct).select(
            *_row("large_row_drop", F.when(critical, "critical").otherwise("warning"), None, pct,
                  -F.when(critical, t.row_drop_pct_critical).otherwise(t.row_drop_pct),
                  F.format_string("rows fell by %.1f%% in step %s", F.abs(pct), step))
        ),
        d.rows.filter(pct >= t.row_increase_pct).select(
            *_row("row_explosion", "warning", None, pct, t.row_increase_pct,
                  F.format_string("rows grew by %.1f%% in step %s", pct, step))
        ),
        d.rows.filter((F.col("duplicate_before") > 0) & (grown >= t.duplicate_spike_pct)).select(
            *_row("duplicate_spike", "warning", None, grown, t.duplicate_spike_pct,
                  F.format_string("duplicate rows grew by %.1f%% in step %s", grown, step))
        ),
        d.rows.filter((F.col("duplicate_before") == 0) & (F.col("duplicate_after") > t.duplicates_appeared)).select(
            *_row("duplicates_appeared", "info", None, F.col("duplicate_after"), None,
                  F.format_string("%d duplicate rows appeared in step %s", F.col("duplicate_after"), step))
        ),
        d.columns.filter(F.col("state") == "type_changed").select(
            *_row("type_change", "info", F.col("column"), None, None,
                  F.format_string("%s changed from %s to %s in step %s", F.col("column"), F.col("type_before"), F.col("type_after"), step))
        ),
    ]
    # One row of totals meets one row per column.
    sized = d.nulls.withColumn("one", F.lit(1)).join(
        d.rows.select("row_count_before", "row_count_after", F.lit(1).alias("one")), "one"
    )
    after_pct = F.col("null_after") * 100.0 / F.greatest(F.col("row_count_after"), F.lit(1))
    gained = F.coalesce("delta", F.lit(0))
    gain_pct = F.coalesce(F.try_divide(gained.cast("double"), F.col("row_count_before").cast("double")) * 100, F.lit(0.0))
    mostly = (after_pct >= t.null_mostly_threshold) & (F.col("null_after") > F.coalesce("null_before", F.lit(0)))
    risen = ~mostly & (gain_pct >= t.null_increase_pct) & (gained > 0)
    found.append(
        sized.filter(mostly | risen).select(
            *_row(
                F.when(mostly, "column_mostly_null").otherwise("null_increase"),
                F.when(mostly, "critical").otherwise("warning"), F.col("column"),
                F.when(mostly, after_pct).otherwise(gain_pct),
                F.when(mostly, t.null_mostly_threshold).otherwise(t.null_increase_pct),
                F.when(mostly, F.format_string("%s is %.1f%% missing after step %s", F.col("column"), after_pct, step))
                .otherwise(F.format_string("%s gained %d missing cells in step %s", F.col("column"), gained, step)),
            )
        )
    )
    drift = F.col("drift_pct")
    found.append(
        d.drift.filter(F.abs(drift) >= t.stat_drift_pct).select(
            *_row("stat_drift", "warning", F.col("column"), drift, t.stat_drift_pct,
                  F.format_string("mean of %s moved by %.1f%% in step %s", F.col("column"), drift, step))
        )
    )
    if d.distribution is not None:
        ks, p = F.col("ks_stat"), F.col("ks_pvalue")
        found.append(
            d.distribution.filter((ks >= t.ks_stat_threshold) & (p <= t.ks_pvalue_threshold)).select(
                *_row("distribution_shift", "warning", F.col("column"), ks, t.ks_stat_threshold,
                      F.format_string("%s is distributed differently after step %s (D=%.3f, p=%.4f)", F.col("column"), step, ks, p))
            )
        )
    if d.categories is not None:
        gone = F.col("removed_count")
        found.append(
            d.categories.filter(gone >= t.category_disappear).select(
                *_row("category_disappear", "warning", F.col("column"), gone, t.category_disappear,
                      F.format_string("%s lost %d values in step %s", F.col("column"), gone, step))
            )
        )
    return reduce(DataFrame.unionByName, found)


# --- explanations -----------------------------------------------------------------------------
# How sure an explanation is, by anomaly; and where the kind of step makes it surer.
CONFIDENCE = {
    "large_row_drop": "medium", "row_explosion": "high", "column_mostly_null": "medium", "null_increase": "medium",
    "type_change": "low", "duplicate_spike": "medium", "duplicates_appeared": "medium", "stat_drift": "medium",
    "distribution_shift": "medium", "category_disappear": "medium",
}
SURE_STEPS = {"large_row_drop": ("filter_rows", "join", "drop_missing"), "column_mostly_null": ("change_dtype", "join")}
STEP_GROUPS = {"merge": "join"}
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2}


def confidence(step_type: str) -> dict[str, str]:
    group = STEP_GROUPS.get(step_type, step_type)
    return {k: "high" if group in SURE_STEPS.get(k, ()) else v for k, v in CONFIDENCE.items()}


def _evidence(d: Diff | None, spark) -> DataFrame:
    """What the comparison measured, as (column, facts): one row of totals with a null column,
    and one row per column. Every fact is a text such as ``missing cells: 3 to 40``."""
    if d is None:
        return local_table(spark, [], "column string, facts array<string>")
    shown = lambda label, a, b: F.when(
        a.isNotNull() | b.isNotNull(), F.concat(F.lit(f"{label}: "), F.coalesce(a.cast("string"), F.lit("none")), F.lit(" to "), F.coalesce(b.cast("string"), F.lit("none")))
    )
    pair = lambda label, name: shown(label, F.col(f"{name}_before"), F.col(f"{name}_after"))
    totals = d.rows.select(F.lit(None).cast("string").alias("column"), F.array_compact(F.array(pair("rows", "row_count"), pair("duplicate rows", "duplicate"))).alias("facts"))
    parts = [
        d.nulls.select("column", shown("missing cells", F.col("null_before"), F.col("null_after")).alias("fact")),
        d.columns.filter(F.col("state") == "type_changed").select("column", pair("type", "type").alias("fact")),
        d.drift.select("column", F.format_string("mean moved by %.2f%%", "drift_pct").alias("fact")),
    ]
    if d.categories is not None:
        parts.append(d.categories.filter("removed_count > 0").select("column", F.format_string("values gone: %d", "removed_count").alias("fact")))
    if d.distribution is not None:
        parts.append(d.distribution.select("column", F.format_string("largest gap between the distributions: %.3f", "ks_stat").alias("fact")))
    facts = reduce(DataFrame.unionByName, parts).filter("fact is not null")
    return totals.unionByName(facts.groupBy("column").agg(F.array_sort(F.collect_list("fact")).alias("facts")))


def explain_anomalies(
    anomalies: DataFrame, step_type: str, d: Diff | None = None, config: dict | None = None, causes: DataFrame | None = None
) -> DataFrame:
    """Cause, confidence, checks and fix of each anomaly, most severe first.

    The cause names the step and its settings and, from ``causes`` (operators/causes.py), which
    rows the step treated how; the checks are the facts that the comparison
    measured for the column (or for the table), the fix says which limit the result missed by
    how much. All sides have a few rows per column of the table.
    """
    sure = F.create_map(*[F.lit(x) for kv in confidence(step_type).items() for x in kv])
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    settings = ", ".join(f"{k}={v}" for k, v in sorted((config or {}).items()) if isinstance(v, (str, int, float, bool, list)))
    cause = F.format_string("step %s%s", F.lit(step_type), F.lit(f" with {settings}" if settings else ""))
    fix = F.when(
        F.col("threshold").isNotNull(), F.format_string("change the step until the value of %.2f is back within %.2f", "value", "threshold")
    ).otherwise(F.lit("confirm that the change is wanted"))
    if causes is not None:
        facts = F.array_join("causes", "; ")
        anomalies = anomalies.withColumn("_one", F.lit(1)).join(in_words(causes).withColumn("_one", F.lit(1)), "_one")  # one row
        cause = F.when(F.size("causes") > 0, F.concat(cause, F.lit("; "), facts)).otherwise(cause)
    known = _evidence(d, anomalies.sparkSession).withColumnRenamed("column", "_column")
    out = anomalies.join(known, F.col("column").eqNullSafe(F.col("_column")), "left").select(
        F.col("type").alias("anomaly_type"), "severity", "column", "value", F.col("message").alias("summary"),
        cause.alias("likely_cause"), sure[F.col("type")].alias("confidence"),
        F.coalesce("facts", F.array().cast("array<string>")).alias("recommended_checks"), fix.alias("suggested_fix"),
        rank[F.col("severity")].alias("severity_rank"),
    )
    return out.orderBy("severity_rank", "anomaly_type", "column")


def badge_counts(anomalies: DataFrame) -> DataFrame:
    """Anomalies per step and severity; needs a ``step_index`` column."""
    return anomalies.groupBy("step_index").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")],
        F.count("*").alias("total"),
    )


__all__ = [
    "ANOMALY_COLUMNS", "Diff", "Thresholds", "badge_counts", "compute_diff", "detect_anomalies",
    "confidence", "explain_anomalies",
]
