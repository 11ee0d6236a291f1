"""Operators that follow row order without pulling the table into one task.

The order is cut into ranges of similar size. What crosses a range border is one
value or one sum per range, so the carry table is as small as the list of ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rows import ROW_ID, quoted, require_columns, require_row_id
from .ranges import ROWS_PER_RANGE, cut_points, with_range

def carry_fill(
    df: DataFrame,
    columns: str | list[str],
    forward: bool = True,
    partition_by: list[str] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Fill NULLs with the last (or next) value in row order.

    Each range offers its last value, a running pick over the ranges gives the value
    that enters the next one, and a window inside a range does the rest. With
    ``partition_by`` the carry is kept per group and range, so a hot group is split too.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    groups = list(partition_by or [])
    require_row_id(df, "ffill/bfill")
    require_columns(df, columns + groups)
    place = quoted(ROW_ID).cast("double")
    cuts = cut_points(df.select(F.lit("").alias("column"), place.alias("x")), rows_per_range)
    placed = with_range(df, cuts, place)
    edge = F.max_by if forward else F.min_by
    values = []
    for i, c in enumerate(columns):
        held = quoted(c).isNotNull()
        values.append(edge(F.when(held, quoted(c)), F.when(held, quoted(ROW_ID))).alias(f"_v{i}"))
    per_range = placed.groupBy(*map(quoted, groups), "_range").agg(*values)

    order = F.col("_range").asc() if forward else F.col("_range").desc()
    before = W.partitionBy(*map(quoted, groups)).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carry = per_range.select(
        *[quoted(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_range").alias("_r"),
        *[F.last(f"_v{i}", ignorenulls=True).over(before).alias(f"_c{i}") for i in range(len(columns))],
    )
    cond = placed["_range"] == carry["_r"]
    for i, g in enumerate(groups):
        cond = cond & placed[g].eqNullSafe(carry[f"_g{i}"])
    joined = placed.join(carry, cond, "left_outer")  # dealt by range, as the window below needs it anyway
    inside = W.partitionBy(*map(quoted, groups), "_range").orderBy(
        quoted(ROW_ID).asc() if forward else quoted(ROW_ID).desc()
    ).rowsBetween(W.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(quoted(c), ignorenulls=True).over(inside), F.col(f"_c{i}")) for i, c in enumerate(columns)
    }
    return joined.select(*[filled[c].alias(c) if c in filled else quoted(c) for c in df.columns])
