"""What a step did to which rows: counts and examples that explain an anomaly.

Every function reads the table before the step (and what the step joins or casts) and returns
``code, column, rows, examples``, a few rows whatever the size of the table. Counts are exact.
Examples are at most ``EXAMPLES`` values, those of most rows first.

Defined results: a fact with no rows is left out; a step without rules of its own has no facts;
an empty table gives no facts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rows import data_columns, dtype_of, local_table, quoted
from . import steps
from .cells import split

EXAMPLES = 3
SCHEMA = "code string, column string, rows bigint, examples array<string>"
WORDS = {
    "filter_missing": "the cell is missing", "filter_value": "the value does not pass",
    "left_alone": "no partner in the right table", "right_alone": "right rows without a partner",
    "left_alone_folded": "a partner if blanks and case are ignored", "repeated_both": "the key repeats on both sides",
    "largest_key": "rows made by the largest key", "cast_lost": "cannot be read as the new type",
    "gap": "a gap in this column", "copies": "copies of an earlier row", "largest_group": "rows in the largest group of copies",
    "missing_key": "no key to group by", "groups": "groups", "filled": "gaps in this column before the step",
}


def _facts(one_row: DataFrame, column: str, *codes: str) -> DataFrame:
    """A row of counts named by code as rows, those above zero."""
    listed = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("bigint").alias("rows")) for c in codes])
    out = one_row.select(F.explode(listed).alias("_f")).select("_f.*").filter("rows > 0")
    return out.select("code", F.lit(column).alias("column"), "rows", F.array().cast("array<string>").alias("examples"))


def _most(counted: DataFrame, value: Column) -> DataFrame:
    """One row of examples: the values of most rows (column ``n``)."""
    few = counted.select(value.alias("value"), "n").orderBy(F.desc("n"), "value").limit(EXAMPLES)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "value")))
    return few.agg(F.transform(ranked, lambda v: v["value"]).alias("examples"))


def _fact(code: str, column: str, counted: DataFrame, value: Column) -> DataFrame:
    """Total of ``n`` with examples."""
    total = counted.agg(F.sum("n").cast("bigint").alias("rows")).filter("rows > 0")
    one = F.lit(1).alias("one")
    return total.select("rows", one).join(_most(counted, value).select("examples", one), "one").select(F.lit(code).alias("code"), F.lit(column).alias("column"), "rows", "examples")


def filter_causes(before: DataFrame, config: dict) -> DataFrame:
    """Rows that a filter dropped, because the cell is missing or because of its value."""
    column = config["column"]
    passes = F.coalesce(
        steps.row_condition(before, column, config.get("operator", "=="), config.get("value"), config.get("literal", False)), F.lit(False)
    )
    gone, missing = ~passes, quoted(column).isNull()
    counts = before.agg(F.count_if(gone & missing).alias("filter_missing"), F.count_if(gone & ~missing).alias("filter_value"))
    return _facts(counts, column, "filter_missing", "filter_value")


def join_causes(before: DataFrame, right: DataFrame, config: dict) -> DataFrame:
    """Rows without a partner, how many of them have one if blanks and case are ignored, and
    keys that repeat on both sides. Both tables are counted by key first, so that no key's rows
    meet in one task."""
    keys = [config["on"]] if isinstance(config["on"], str) else list(config["on"])
    null_safe = config.get("null_keys_match", True)
    name, at = ", ".join(keys), range(len(keys))
    sides = [
        df.groupBy(*[quoted(k).alias(f"{s}{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(f"n{s}"))
        for s, df in (("l", before), ("r", right))
    ]
    same = [F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) if null_safe else F.col(f"l{i}") == F.col(f"r{i}") for i in at]
    both = sides[0].join(sides[1], reduce(lambda a, b: a & b, same), "full_outer")
    many, made = (F.col("nl") > 1) & (F.col("nr") > 1), F.col("nl") * F.col("nr")
    counts = both.agg(
        F.sum(F.when(F.col("nl").isNull(), F.col("nr"))).alias("right_alone"), F.sum(F.when(many, made)).alias("repeated_both"),
        F.max(F.when(many, made)).alias("largest_key"),
    )
    shown = F.concat_ws(", ", *[F.coalesce(F.col(f"l{i}").cast("string"), F.lit("NULL")) for i in at])
    alone = both.filter("nr is null and nl is not null").withColumnRenamed("nl", "n")
    out = _fact("left_alone", name, alone, shown).unionByName(_facts(counts, name, "right_alone", "repeated_both", "largest_key"))
    if not any(isinstance(dtype_of(df, k), T.StringType) for df in (before, right) for k in keys):
        return out
    folded = lambda s: [F.lower(F.trim(F.col(f"{s}{i}").cast("string"))).alias(f"f{i}") for i in at]
    near = alone.select(*folded("l"), shown.alias("shown"), "n").join(sides[1].select(*folded("r")).distinct(), [f"f{i}" for i in at], "left_semi")
    return out.unionByName(_fact("left_alone_folded", name, near, F.col("shown")))


def cast_causes(before: DataFrame, config: dict) -> DataFrame:
    """Cells that a cast made missing, with examples."""
    column = config["column"]
    both = steps.change_dtype(before.select(quoted(column), quoted(column).cast("string").alias("_was")), column, config["dtype"], config.get("truthy", False))
    lost = both.filter(F.col("_was").isNotNull() & quoted(column).isNull()).groupBy("_was").agg(F.count("*").alias("n"))
    return _fact("cast_lost", column, lost, F.col("_was"))


def gap_causes(before: DataFrame, config: dict, code: str = "gap") -> DataFrame:
    """Missing cells per column that the step looked at."""
    named = config.get("columns") or ([config["column"]] if config.get("column") else None)
    names = [c for c in named or data_columns(before) if c in before.columns]
    counts = before.agg(*[F.count_if(quoted(c).isNull()).alias(f"g{i}") for i, c in enumerate(names)])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"g{i}").alias("rows")) for i, c in enumerate(names)])
    rows = counts.select(F.explode(listed).alias("_f")).select("_f.*").filter("rows > 0")
    return rows.select(F.lit(code).alias("code"), "column", "rows", F.array().cast("array<string>").alias("examples"))


def copy_causes(before: DataFrame, config: dict) -> DataFrame:
    """Rows beyond the first of each group of copies, and the size of the largest group."""
    from ..rows import kind_columns
    from .digests import row_key

    keys = list(config.get("columns") or data_columns(before))
    sizes = before.groupBy(*row_key(before, keys + kind_columns(before, keys))).agg(F.count("*").alias("n")).filter("n > 1")
    counts = sizes.agg(F.sum(F.col("n") - 1).alias("copies"), F.max("n").alias("largest_group"))
    return _facts(counts, ", ".join(keys), "copies", "largest_group")


def group_causes(before: DataFrame, config: dict) -> DataFrame:
    """Number of groups, and rows that no group takes because a key is missing."""
    keys = list(config["group_by"])
    sizes = before.groupBy(*map(quoted, keys)).agg(F.count("*").alias("n"))
    missing = reduce(lambda a, b: a | b, [quoted(k).isNull() for k in keys])
    lost = F.lit(False) if config.get("keep_null_keys", False) else missing
    counts = sizes.agg(F.count_if(~lost).alias("groups"), F.sum(F.when(lost, F.col("n"))).alias("missing_key"))
    return _facts(counts, ", ".join(keys), "missing_key", "groups")


def step_causes(before: DataFrame, step_type: str, config: dict, right: DataFrame | None = None) -> DataFrame:
    """The facts of a step by its type."""
    before = split(before)
    makers: dict[str, Callable[[], DataFrame]] = {
        "filter_rows": lambda: filter_causes(before, config), "change_dtype": lambda: cast_causes(before, config),
        "drop_missing": lambda: gap_causes(before, config), "fill_missing": lambda: gap_causes(before, config, "filled"),
        "remove_duplicates": lambda: copy_causes(before, config), "group_aggregate": lambda: group_causes(before, config),
    }
    if step_type == "join" and right is not None:
        return join_causes(before, split(right), config)
    return makers[step_type]() if step_type in makers else local_table(before.sparkSession, [], SCHEMA)


def in_words(causes: DataFrame) -> DataFrame:
    """The facts as one list of texts, such as ``o_status: 12 rows, no partner in the right table (x, y)``."""
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    shown = F.when(F.size("examples") > 0, F.concat(F.lit(" ("), F.array_join("examples", ", "), F.lit(")"))).otherwise(F.lit(""))
    text = F.concat(F.col("column"), F.lit(": "), F.col("rows").cast("string"), F.lit(" rows, "), words[F.col("code")], shown)
    return causes.agg(F.array_sort(F.collect_list(F.struct(F.col("code"), F.col("column"), text.alias("text")))).alias("_a")).select(
        F.transform("_a", lambda v: v["text"]).alias("causes")
    )


__all__ = ["WORDS", "in_words", "step_causes"]
