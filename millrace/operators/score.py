"""Quality score of a table, 0 to 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rows import data_columns, local_table, quoted

# Penalty points per issue, weight and cap of missing cells.
ISSUE_POINTS = {"critical": 5.0, "warning": 2.0, "info": 0.5}
NULL_WEIGHT, NULL_CAP = 0.6, 30.0


def quality_score(df: DataFrame, issues: DataFrame, label: str = "before", counted: tuple[int, int] | None = None) -> DataFrame:
    """100 minus points for missing cells and issues, with the trust in the figure.

    ``counted`` are rows and missing cells if they are known."""
    columns = data_columns(df)
    if counted:
        table = local_table(df.sparkSession, [counted], "rows bigint, nulls bigint")
    else:
        nulls = sum((F.count("*") - F.count(quoted(c)) for c in columns), F.lit(0))
        table = df.agg(F.count("*").alias("rows"), nulls.cast("bigint").alias("nulls"))
    points = F.when(F.col("severity") == "critical", ISSUE_POINTS["critical"]).when(
        F.col("severity") == "warning", ISSUE_POINTS["warning"]
    ).when(F.col("severity") == "info", ISSUE_POINTS["info"]).otherwise(1.0)
    penalty = issues.agg(F.coalesce(F.sum(points), F.lit(0.0)).alias("issue_penalty"), F.count("*").alias("issues"))
    both = table.withColumn("one", F.lit(1)).join(penalty.withColumn("one", F.lit(1)), "one")
    null_pct = F.coalesce(
        F.try_divide(F.col("nulls").cast("double"), (F.col("rows") * len(columns)).cast("double")) * 100, F.lit(0.0)
    )
    null_penalty = F.least(F.lit(NULL_CAP), null_pct * NULL_WEIGHT)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - null_penalty - F.col("issue_penalty")))
    return both.select(
        F.lit(label).alias("label"), F.round(score, 1).alias("score"),
        F.when(F.col("rows") >= 50, "high").when(F.col("rows") >= 10, "medium").otherwise("low").alias("confidence"),
        F.round(null_penalty, 2).alias("null_penalty"), "issue_penalty", "issues",
    )


def quality_pair(
    before: DataFrame, after: DataFrame, issues_before: DataFrame, issues_after: DataFrame,
    counted: tuple[tuple[int, int] | None, tuple[int, int] | None] = (None, None),
) -> DataFrame:
    """Scores of both versions and the improvement, one row."""
    b = quality_score(before, issues_before, counted=counted[0]).select(F.col("score").alias("before_cleaning"), "confidence", F.lit(1).alias("one"))
    a = quality_score(after, issues_after, counted=counted[1]).select(F.col("score").alias("after_cleaning"), F.lit(1).alias("one"))
    return b.join(a, "one").select(
        "before_cleaning", "after_cleaning",
        F.round(F.col("after_cleaning") - F.col("before_cleaning"), 1).alias("improvement"), "confidence",
    )
