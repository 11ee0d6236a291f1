"""Cell-level audit between two versions of a table, and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import RIGHT_ID, ROW_ID, data_columns, quoted, require_row_id
from .cells import cell_kind, mixed_columns

AUDIT_COLUMNS = (ROW_ID, "column", "action", "from", "to", "confidence", "layer")


def audit_entry(column: str, action: Column, before: Column, after: Column, confidence: str, layer: str, hit: Column) -> Column:
    """Struct of one possible audit entry; NULL where nothing happened."""
    return F.when(
        hit,
        F.struct(
            F.lit(column).alias("column"), action.alias("action"), before.cast("string").alias("from"),
            after.cast("string").alias("to"), F.lit(confidence).alias("confidence"), F.lit(layer).alias("layer"),
        ),
    )


def explode_audit(df: DataFrame, entries: list[Column]) -> DataFrame:
    """One row per entry that happened. Entries sit next to the data, so no join."""
    held = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.select(quoted(ROW_ID), F.explode(held).alias("_e")).select(ROW_ID, "_e.*")


def audit_cells(before: DataFrame, after: DataFrame, columns: list[str] | None = None, step_type: str = "") -> DataFrame:
    """Every changed cell of rows present in both versions, matched by row id."""
    require_row_id(before, "audit")
    require_row_id(after, "audit")
    if RIGHT_ID in before.columns:
        raise ValueError("row ids repeat after a join: number the rows before the next audit")
    names = [c for c in (columns or data_columns(before)) if c in before.columns and c in after.columns]
    mixed = [c for c in names if c in mixed_columns(before) and c in mixed_columns(after)]
    sides = [
        df.select(
            quoted(ROW_ID), *[quoted(c).cast("string").alias(f"{s}{i}") for i, c in enumerate(names)],
            *[cell_kind(quoted(c)).alias(f"{s}k{names.index(c)}") for c in mixed],
        )
        for s, df in (("b", before), ("a", after))
    ]
    both = sides[0].join(sides[1], ROW_ID)
    entries = []
    for i, c in enumerate(names):
        x, y = F.col(f"b{i}"), F.col(f"a{i}")
        action = F.when(x.isNull(), "fill_null").when(y.isNull(), "set_null").otherwise("value_changed")
        entries.append(audit_entry(c, action, x, y, "high", "step_execution", ~x.eqNullSafe(y)))
        if c in mixed:  # the text is the same, the type is another one
            was, now = F.col(f"bk{i}"), F.col(f"ak{i}")
            entries.append(audit_entry(c, F.lit("type_changed"), was, now, "high", "step_execution", x.eqNullSafe(y) & ~was.eqNullSafe(now)))
    return explode_audit(both, entries).withColumn("step_type", F.lit(step_type))


def rows_changed(before: DataFrame, after: DataFrame, step_type: str = "") -> DataFrame:
    """The row-count entry of a step, empty if the count is the same."""
    b, a = before.agg(F.count("*").alias("b")), after.agg(F.count("*").alias("a"))
    both = b.withColumn("one", F.lit(1)).join(a.withColumn("one", F.lit(1)), "one").filter(F.col("a") != F.col("b"))
    return both.select(
        F.lit("__all__").alias("column"), F.lit("rows_changed").alias("action"), F.col("b").cast("string").alias("from"),
        F.col("a").cast("string").alias("to"), F.lit("step_execution").alias("layer"), F.lit(step_type).alias("step_type"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """Entries by layer, by action, by column and in total, in one pass."""
    counts = audit.groupingSets(
        [["layer"], ["action"], ["column"], []], "layer", "action", "column"
    ).agg(F.count("*").alias("changes"), F.grouping_id().alias("_g"))
    kind = F.when(F.col("_g") == 3, "layer").when(F.col("_g") == 5, "action").when(F.col("_g") == 6, "column").otherwise("total")
    return counts.select(kind.alias("grouping"), F.coalesce("layer", "action", "column", F.lit("all")).alias("name"), "changes")


def filter_audit(audit: DataFrame, layer: str | None = None, column: str | None = None, action: str | None = None) -> DataFrame:
    for name, value in (("layer", layer), ("column", column), ("action", action)):
        if value:
            audit = audit.filter(F.col(name) == value)
    return audit
