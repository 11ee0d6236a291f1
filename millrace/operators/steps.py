"""Single-step table operators: projections, filters, casts, sort, duplicates, groups."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, fixed, text
from ..rows import (
    RIGHT_ID, ROW_ID, as_double, data_columns, dtype_of, is_number, is_text, kind_columns, quoted, require_columns,
    require_row_id,
)
from .cells import cell_text
from .fill import number_view


# --- projections --------------------------------------------------------------------
def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        raise ValueError("select_columns needs a non-empty list of columns")
    require_columns(df, columns)
    hidden = [c for c in (ROW_ID, RIGHT_ID) if c in df.columns and c not in columns]
    return df.select(*map(quoted, hidden + columns))


def rename_columns(df: DataFrame, mappings: dict[str, str]) -> DataFrame:
    """Rename; names the table does not have are ignored."""
    if not mappings:
        raise ValueError("rename_column needs a non-empty mapping")
    return df.withColumnsRenamed(mappings)


_ARITHMETIC = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply}


def _operand(df: DataFrame, name: str) -> Column:
    return quoted(name).cast("int") if isinstance(dtype_of(df, name), T.BooleanType) else quoted(name)


def computed_column(
    df: DataFrame,
    new_column: str,
    operation: str = "add",
    col_a: str | None = None,
    col_b: str | None = None,
    constant_value: Any = None,
) -> DataFrame:
    """New column from one or two columns; overflow and division by zero give NULL."""
    if not new_column:
        raise ValueError("add_computed_column needs the name of the new column")
    if operation == "constant":
        return df.withColumn(new_column, F.lit(constant_value))
    if not col_a:
        raise ValueError("add_computed_column needs col_a")
    require_columns(df, [c for c in (col_a, col_b) if c], "Column")
    a = _operand(df, col_a)
    b = _operand(df, col_b) if col_b else F.lit(constant_value)
    if operation == "concat":
        return df.withColumn(new_column, F.concat(a.cast("string"), b.cast("string")))
    if operation == "divide":
        return df.withColumn(new_column, F.try_divide(a.cast("double"), b.cast("double")))
    if operation not in _ARITHMETIC:
        raise ValueError(f"unknown operation {operation!r}")
    if operation == "add" and is_text(dtype_of(df, col_a)):
        return df.withColumn(new_column, F.concat(a, b.cast("string")))
    return df.withColumn(new_column, _ARITHMETIC[operation](a, b))


def change_dtype(df: DataFrame, column: str, dtype: str, truthy: bool = False) -> DataFrame:
    """Cast a column; what cannot be read becomes NULL."""
    require_columns(df, [column], "Column")
    dt, c = dtype_of(df, column), quoted(column)
    if dtype == "int":
        x = number_view(df, column)
        whole = F.when(x == F.floor(x), x).when(
            x.isNotNull(), F.raise_error(F.lit(f"change_dtype: {column} holds fractional numbers")).cast("double")
        )
        if isinstance(dt, T.IntegralType):
            out = c.cast("bigint")
        elif is_text(dt):  # whole numbers never pass through DOUBLE
            plain = text.trimmed(c)
            out = F.when(plain.rlike(fixed.INTEGER_SHAPE), plain.try_cast("bigint")).otherwise(whole.try_cast("bigint"))
        else:
            out = whole.try_cast("bigint")
    elif dtype == "float":
        out = number_view(df, column)
    elif dtype == "str":
        out = c.cast("string")
    elif dtype == "bool":
        if truthy:
            out = c.isNotNull() & (F.length(c) > 0) if is_text(dt) else F.coalesce(c.cast("double") != 0, F.lit(True))
        else:
            out = c.try_cast("boolean")
    elif dtype == "datetime":
        out = dates.parse_timestamp(c) if is_text(dt) else c.cast("timestamp_ntz")
    else:
        raise ValueError(f"unsupported dtype {dtype!r}: use int, float, str, bool or datetime")
    return df.withColumn(column, out)


# --- filters ---------------------------------------------------------------------------
_BIGINT = (-(1 << 63), (1 << 63) - 1)


def _number(value: Any) -> Decimal | None:
    """The exact value of a number or of its text; None if it is neither."""
    try:
        out = Decimal(repr(value) if isinstance(value, float) else str(value).strip())
    except InvalidOperation:
        return None
    return out if out.is_finite() else None


def _literal(df: DataFrame, column: str, value: Any) -> Column:
    dt = dtype_of(df, column)
    if is_text(dt):
        return F.lit(str(value))
    if isinstance(dt, T.NumericType):
        x = _number(value)
        if x is None:
            return F.lit(float(value)) if isinstance(value, float) else F.lit(None).cast(dt)
        if isinstance(dt, T.IntegralType):
            return F.lit(int(x))
        return F.lit(float(x)) if isinstance(dt, (T.DoubleType, T.FloatType)) else F.lit(x)
    return F.lit(value).try_cast(dt.simpleString())


def _compared(c: Column, dt: T.DataType, operator: str, value: Any) -> Column:
    """Order comparison in the column's own type, so that it is exact and can be pushed down.

    On whole numbers a fractional or far bound becomes the nearest bound that the type has."""
    ops = {">": c.__gt__, ">=": c.__ge__, "<": c.__lt__, "<=": c.__le__}
    x = _number(value)
    if x is None:
        return ops[operator](F.lit(float(value)))
    if isinstance(dt, T.IntegralType):
        up = operator in (">=", "<")
        bound = int(x.to_integral_value(ROUND_CEILING if up else ROUND_FLOOR))
        if not _BIGINT[0] <= bound <= _BIGINT[1]:
            return c.isNotNull() if (bound > 0) == (operator in ("<", "<=")) else F.lit(False)
        return ops[operator](F.lit(bound))
    if isinstance(dt, T.DecimalType):
        return ops[operator](F.lit(x))
    return ops[operator](F.lit(float(x)))


def row_condition(df: DataFrame, column: str, operator: str = "==", value: Any = None, literal: bool = False) -> Column:
    """Condition of a filter step, in the column's own type so it can be pushed down."""
    require_columns(df, [column], "Column")
    c = quoted(column)
    if operator == "isnull":
        return c.isNull()
    if operator == "notnull":
        return c.isNotNull()
    dt = dtype_of(df, column)
    if isinstance(dt, T.IntegralType) and operator in ("==", "!="):
        x = _number(value)
        if x is not None and (x != x.to_integral_value() or not _BIGINT[0] <= x <= _BIGINT[1]):
            return F.lit(operator == "!=")
    if operator == "==":
        return c == _literal(df, column, value)
    if operator == "!=":
        return ~c.eqNullSafe(_literal(df, column, value))
    if operator in (">", ">=", "<", "<="):
        if not is_number(dt):
            raise ValueError(f"filter {operator} needs a numeric column, {column!r} is not")
        return _compared(c.cast("int") if isinstance(dt, T.BooleanType) else c, dt, operator, value)
    if operator == "contains":
        s = c.cast("string")
        return s.contains(str(value)) if literal else s.rlike(str(value))
    if operator == "startswith":
        return c.cast("string").startswith(str(value))
    raise ValueError(f"unknown operator {operator!r}")


def filter_rows(df: DataFrame, column: str, operator: str = "==", value: Any = None, literal: bool = False) -> DataFrame:
    if not column:
        raise ValueError("filter_rows needs a column")
    return df.filter(row_condition(df, column, operator, value, literal))


def drop_missing(
    df: DataFrame, columns: list[str] | None = None, how: str = "any", thresh: int | None = None
) -> DataFrame:
    """Drop rows with missing cells; ``thresh`` is the least number of held cells."""
    subset = columns or data_columns(df)
    require_columns(df, subset)
    if thresh is not None:
        held = reduce(lambda a, b: a + b, [quoted(c).isNotNull().cast("int") for c in subset])
        return df.filter(held >= int(thresh))
    if how not in ("any", "all"):
        raise ValueError("how must be 'any' or 'all'")
    join = (lambda a, b: a & b) if how == "any" else (lambda a, b: a | b)
    return df.filter(reduce(join, [quoted(c).isNotNull() for c in subset]))


def null_share(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Share of missing cells in the row."""
    columns = columns or data_columns(df)
    return reduce(lambda a, b: a + b, [quoted(c).isNull().cast("int") for c in columns]) / F.lit(len(columns))


def drop_sparse_rows(df: DataFrame, share: float = fixed.SPARSE_ROW_SHARE) -> DataFrame:
    """Drop rows where at least this share of the cells is missing."""
    return df.filter(null_share(df) < share)


def meaningful_columns(columns: list[str]) -> list[str]:
    """Columns that carry content, i.e. all but ID columns (all if there are no others)."""
    import re

    rest = [c for c in columns if not re.search(fixed.ID_NAME_SHAPE, c.lower())]
    return rest or list(columns)


def empty_row(df: DataFrame) -> Column:
    """True where every content column is NULL or blank."""
    conds = [
        text.is_blank(quoted(c)) if is_text(dtype_of(df, c)) else quoted(c).isNull()
        for c in meaningful_columns(data_columns(df))
    ]
    return reduce(lambda a, b: a & b, conds)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.filter(~empty_row(df))


def impossible_value(
    df: DataFrame, age: list[str] = (), score: list[str] = (), salary: list[str] = ()
) -> dict[str, Column]:
    """Per number column the condition that its value is out of bounds (NULL is fine)."""
    bounds = [(age, *fixed.AGE_RANGE), (score, *fixed.SCORE_RANGE), (salary, fixed.SALARY_MIN, None)]
    out: dict[str, Column] = {}
    for names, low, high in bounds:
        for n in names:
            if n not in df.columns or not is_number(dtype_of(df, n)):
                continue
            c = as_double(df, n)
            bad = c < low if high is None else (c < low) | (c > high)
            bad = F.coalesce(bad, F.lit(False))
            out[n] = out[n] | bad if n in out else bad
    return out


def drop_impossible_rows(df: DataFrame, age=(), score=(), salary=()) -> DataFrame:
    bad = impossible_value(df, age, score, salary)
    return df.filter(~reduce(lambda a, b: a | b, bad.values())) if bad else df


def columns_over_null_share(df: DataFrame, share: float, columns: list[str] | None = None, strict: bool = False) -> list[str]:
    """Names of columns whose share of missing cells reaches (or exceeds) the limit."""
    columns = data_columns(df) if columns is None else columns
    row = df.agg(
        F.count("*").alias("n"), *[F.count(quoted(c)).alias(f"h{i}") for i, c in enumerate(columns)]
    ).first()
    if not row["n"]:
        return []
    gone = {c: 1 - row[f"h{i}"] / row["n"] for i, c in enumerate(columns)}
    return [c for c in columns if (gone[c] > share if strict else gone[c] >= share)]


def drop_null_columns(df: DataFrame, share: float = fixed.NULL_COLUMN_SHARE) -> DataFrame:
    """Drop columns with at least this share of missing cells."""
    return df.drop(*columns_over_null_share(df, share))


def drop_unimportant_columns(df: DataFrame, share: float = fixed.AUTO_DROP_SHARE, match: str = "token") -> DataFrame:
    """Drop number columns mostly missing, unless name or uniqueness makes them matter."""
    from .infer import is_important, unique_counts

    numeric = [c for c in data_columns(df) if is_number(dtype_of(df, c))]
    weak = columns_over_null_share(df, share, numeric, strict=True)
    if not weak:
        return df
    held = df.agg(*[F.count(quoted(c)).alias(f"h{i}") for i, c in enumerate(weak)]).first()
    unique = unique_counts(df, weak)
    gone = [c for i, c in enumerate(weak) if not is_important(c, held[f"h{i}"], unique.get(c, 0), match)]
    return df.drop(*gone)


# --- order and duplicates --------------------------------------------------------------
def sort_values(df: DataFrame, columns: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    """Sort with NULLs last in both directions; ties keep the row order."""
    return df.orderBy(*sort_order(df, columns, ascending))


def sort_order(df: DataFrame, columns: list[str], ascending: bool | list[bool] = True) -> list[Column]:
    if not columns:
        raise ValueError("sort_values needs columns")
    require_columns(df, columns)
    ups = ascending if isinstance(ascending, list) else [ascending] * len(columns)
    if len(ups) != len(columns):
        raise ValueError("ascending must have one entry per column")
    value = {c: cell_text(quoted(c)) if isinstance(dtype_of(df, c), T.VariantType) else quoted(c) for c in columns}
    order = [value[c].asc_nulls_last() if up else value[c].desc_nulls_last() for c, up in zip(columns, ups)]
    return order + ([quoted(ROW_ID).asc()] if ROW_ID in df.columns else [])


def remove_duplicates(df: DataFrame, columns: list[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """Keep the first, the last or (``keep=False``) no row of each group of copies.

    Groups are reduced inside each task first, so a group of any size crosses the
    shuffle as one row per task and never gathers in one place.
    """
    if keep in ("false", "none"):
        keep = False
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    keys = columns or data_columns(df)
    require_columns(df, keys)
    keys = keys + kind_columns(df, keys)
    pick = F.max if keep == "last" else F.min
    rest = [c for c in df.columns if c not in keys]
    if rest != [ROW_ID]:
        if rest:
            require_row_id(df, "remove_duplicates")
        ordered_rest = sorted(rest, key=lambda c: c != ROW_ID)
        chosen = F.struct(*map(quoted, ordered_rest)) if rest else F.lit(0)
    else:
        chosen = quoted(ROW_ID)
    groups = df.groupBy(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    picked = groups.agg(pick(chosen).alias("_pick"), *([F.count("*").alias("_n")] if keep is False else []))
    if keep is False:
        picked = picked.filter(F.col("_n") == 1)
    out = []
    for c in df.columns:
        if c in keys:
            out.append(F.col(f"_k{keys.index(c)}").alias(c))
        elif rest == [ROW_ID]:
            out.append(F.col("_pick").alias(c))
        else:
            out.append(F.col("_pick").getField(c).alias(c))
    return picked.select(*out)


def duplicate_id_rows(df: DataFrame, column: str, hot_rows: int | None = None) -> DataFrame:
    """Rows whose ID occurs more than once; the copies of a hot ID are spread out."""
    from .joins import HOT_ROWS, join_tables

    require_columns(df, [column], "Column")
    repeated = (
        df.filter(quoted(column).isNotNull()).groupBy(quoted(column)).agg(F.count("*").alias("id_rows"))
        .filter(F.col("id_rows") > 1)
    )
    return join_tables(df, repeated, column, "inner", hot_rows=hot_rows or HOT_ROWS)


def duplicate_ids(df: DataFrame, columns: list[str], examples: int = 3) -> DataFrame:
    """Per ID column: copies beyond the first, all rows in such groups, sample IDs."""
    from pyspark.sql import Window as W

    from .stats import value_counts

    require_columns(df, columns)
    repeated = value_counts(df, columns).filter(F.col("n") > 1)
    ranked = repeated.withColumn("k", F.row_number().over(W.partitionBy("column").orderBy("value")))
    few = ranked.filter(F.col("k") <= examples).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda v: v["value"]).alias("examples")
    )
    totals = repeated.groupBy("column").agg(
        F.sum(F.col("n") - 1).cast("bigint").alias("beyond_first"),
        F.sum("n").cast("bigint").alias("member_rows"),
        F.count("*").alias("repeated_ids"),
    )
    return totals.join(few, "column")


# --- groups --------------------------------------------------------------------------------
AGGREGATES = ("sum", "mean", "count", "min", "max", "first", "last", "std", "var")
_NUMERIC_AGGREGATES = {"sum", "mean", "min", "max", "std", "var"}


def _aggregate(df: DataFrame, column: str, how: str, null_sum: bool) -> Column:
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregation {how!r}; use one of {list(AGGREGATES)}")
    c = quoted(column)
    if how in _NUMERIC_AGGREGATES and not is_number(dtype_of(df, column)):
        c = number_view(df, column)
    elif isinstance(dtype_of(df, column), T.BooleanType) and how in _NUMERIC_AGGREGATES:
        c = c.cast("int")
    if how == "sum":
        return F.try_sum(c) if null_sum else F.coalesce(F.try_sum(c), F.lit(0).cast("double" if not isinstance(dtype_of(df, column), T.IntegralType) else "bigint"))
    if how in ("first", "last"):
        pick = F.min_by if how == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), quoted(ROW_ID)))
    return {
        "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp,
    }[how](c)


def group_aggregate(
    df: DataFrame,
    group_by: list[str],
    aggregations: dict[str, str],
    keep_null_keys: bool = False,
    null_sum: bool = False,
    sort: bool = False,
) -> DataFrame:
    """One aggregate per column over groups; groups with a NULL key are left out."""
    if not group_by:
        raise ValueError("group_aggregate needs group_by")
    if not aggregations:
        raise ValueError("group_aggregate needs aggregations")
    require_columns(df, group_by, "Group-by columns")
    require_columns(df, list(aggregations), "Aggregated columns")
    if any(h in ("first", "last") for h in aggregations.values()):
        require_row_id(df, "first/last")
    if not keep_null_keys:
        df = df.filter(reduce(lambda a, b: a & b, [quoted(g).isNotNull() for g in group_by]))
    out = df.groupBy(*map(quoted, group_by)).agg(
        *[_aggregate(df, c, how, null_sum).alias(c) for c, how in aggregations.items()]
    )
    return out.orderBy(*map(quoted, group_by)) if sort else out


def coercion_losses(df: DataFrame, column: str) -> DataFrame:
    """Cells that hold text which cannot be read as a number."""
    require_columns(df, [column], "Column")
    x = number_view(df, column)
    cols = [quoted(ROW_ID)] if ROW_ID in df.columns else []
    return df.filter(quoted(column).isNotNull() & x.isNull()).select(
        *cols, F.lit(column).alias("column"), F.lit("coerce_numeric_failed").alias("action"),
        quoted(column).cast("string").alias("from"),
    )


