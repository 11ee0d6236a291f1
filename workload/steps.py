"""Single steps: projections, casts, filters, drops, duplicates, order, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import steps
from millrace.operators.fill import fill_missing
from millrace.sources.scan import preview

from .base import day, dirty, num, query, table, with_dirty

ALL = "row_id AS _row_id, order_id, cust_id, price, age, status, order_date, mostly_null"


# --- projections ---------------------------------------------------------------------------
@query("step_select", "SELECT o_orderkey, o_totalprice FROM orders")
def step_select(spark, sf):
    return steps.select_columns(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query("step_rename", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus FROM orders")
def step_rename(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return steps.rename_columns(df, {"o_orderkey": "order_id", "o_custkey": "customer_id", "nowhere": "x"})


@query("step_constant", "SELECT o_orderkey, 'EU' AS market FROM orders")
def step_constant(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return steps.computed_column(df, "market", "constant", constant_value="EU")


_LINE = ("l_orderkey", "l_linenumber")


def _computed(name: str, operation: str, a: str, b: str, sql: str):
    @query(name, f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS result FROM lineitem")
    def run(spark, sf):
        df = table(spark, sf, "lineitem").select(*_LINE, a, b)
        out = steps.computed_column(df, "result", operation, a, b)
        return out.select(*_LINE, F.round("result", 6).alias("result"))

    return run


_computed("step_add", "add", "l_quantity", "l_tax", "l_quantity + l_tax")
_computed("step_subtract", "subtract", "l_extendedprice", "l_quantity", "l_extendedprice - l_quantity")
_computed("step_multiply", "multiply", "l_quantity", "l_extendedprice", "l_quantity * l_extendedprice")
_computed("step_divide", "divide", "l_tax", "l_discount", "CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END")


@query("step_concat", "SELECT c_custkey, c_name || c_mktsegment AS label FROM customer")
def step_concat(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return steps.computed_column(df, "label", "concat", "c_name", "c_mktsegment").select("c_custkey", "label")


# --- casts ------------------------------------------------------------------------------------
@query("step_cast_int", with_dirty(f"SELECT row_id AS _row_id, CAST({num('age')} AS BIGINT) AS age FROM dirty"))
def step_cast_int(spark, sf):
    return steps.change_dtype(dirty(spark, sf).select("_row_id", "age"), "age", "int")


@query("step_cast_float", with_dirty(f"SELECT row_id AS _row_id, {num('price')} AS price FROM dirty"))
def step_cast_float(spark, sf):
    return steps.change_dtype(dirty(spark, sf).select("_row_id", "price"), "price", "float")


@query("step_cast_str", with_dirty("SELECT row_id AS _row_id, CAST(cust_id AS VARCHAR) AS cust_id FROM dirty"))
def step_cast_str(spark, sf):
    return steps.change_dtype(dirty(spark, sf).select("_row_id", "cust_id"), "cust_id", "str")


@query("step_cast_bool", with_dirty("SELECT row_id AS _row_id, CAST(order_id % 2 AS BOOLEAN) AS flag FROM dirty"))
def step_cast_bool(spark, sf):
    df = dirty(spark, sf).select("_row_id", (F.col("order_id") % 2).cast("string").alias("flag"))
    return steps.change_dtype(df, "flag", "bool")


@query(
    "step_cast_datetime",
    with_dirty(f"SELECT row_id AS _row_id, strftime({day('order_date')}, '%Y-%m-%d %H:%M:%S') AS order_date FROM dirty"),
)
def step_cast_datetime(spark, sf):
    out = steps.change_dtype(dirty(spark, sf).select("_row_id", "order_date"), "order_date", "datetime")
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))


# --- filters ------------------------------------------------------------------------------------
def _filter(name: str, column: str, operator: str, value, where: str):
    @query(name, with_dirty(f"SELECT {ALL} FROM dirty WHERE {where}"))
    def run(spark, sf):
        return steps.filter_rows(dirty(spark, sf), column, operator, value)

    return run


_filter("filter_eq", "cust_id", "==", "37", "cust_id = 37")
_filter("filter_ne_nulls", "cust_id", "!=", 37, "cust_id IS DISTINCT FROM 37")
_filter("filter_gt", "mostly_null", ">", "700.5", "mostly_null > 700.5")
_filter("filter_ge", "order_id", ">=", 1000, "order_id >= 1000")
_filter("filter_lt", "mostly_null", "<", 700, "mostly_null < 700")
_filter("filter_le", "cust_id", "<=", 50, "cust_id <= 50")
_filter("filter_contains", "price", "contains", r"^\$.*[05]$", r"regexp_matches(price, '^\$.*[05]$')")
_filter("filter_startswith", "age", "startswith", "t", "starts_with(age, 't')")
_filter("filter_isnull", "age", "isnull", None, "age IS NULL")
_filter("filter_notnull", "mostly_null", "notnull", None, "mostly_null IS NOT NULL")


@query(
    "filter_pushdown",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45",
)
def filter_pushdown(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return steps.filter_rows(df, "l_quantity", ">=", 45)


# --- dropping rows and columns ----------------------------------------------------------------------
@query("drop_missing_any", with_dirty(f"SELECT {ALL} FROM dirty WHERE cust_id IS NOT NULL AND age IS NOT NULL"))
def drop_missing_any(spark, sf):
    return steps.drop_missing(dirty(spark, sf), ["cust_id", "age"])


@query("drop_missing_all", with_dirty(f"SELECT {ALL} FROM dirty WHERE cust_id IS NOT NULL OR mostly_null IS NOT NULL"))
def drop_missing_all(spark, sf):
    return steps.drop_missing(dirty(spark, sf), ["cust_id", "mostly_null"], "all")


_HELD = " + ".join(
    f"CAST({c} IS NOT NULL AS INT)" for c in ("order_id", "cust_id", "price", "age", "status", "order_date", "mostly_null")
)


@query("drop_missing_thresh", with_dirty(f"SELECT {ALL} FROM dirty WHERE {_HELD} >= 7"))
def drop_missing_thresh(spark, sf):
    return steps.drop_missing(dirty(spark, sf), thresh=7)


_THREE = "row_id AS _row_id, cust_id, age, mostly_null"


@query(
    "drop_sparse_rows",
    with_dirty(
        f"SELECT {_THREE}, order_id FROM dirty WHERE (CAST(cust_id IS NULL AS INT) + CAST(age IS NULL AS INT)"
        " + CAST(mostly_null IS NULL AS INT)) / 4.0 < 0.5"
    ),
)
def drop_sparse_rows(spark, sf):
    return steps.drop_sparse_rows(dirty(spark, sf).select("_row_id", "cust_id", "age", "mostly_null", "order_id"))


@query(
    "drop_empty_rows",
    with_dirty(
        "SELECT row_id AS _row_id, order_id, cust_id, note, mostly_null FROM (SELECT *, CASE WHEN order_id % 4 = 0"
        " THEN '  ' WHEN order_id % 4 = 1 THEN NULL ELSE status END AS note FROM dirty)"
        " WHERE NOT ((note IS NULL OR trim(note) = '') AND mostly_null IS NULL)"
    ),
)
def drop_empty_rows(spark, sf):
    k = F.col("order_id") % 4
    note = F.when(k == 0, "  ").when(k == 1, F.lit(None)).otherwise(F.col("status")).alias("note")
    return steps.drop_empty_rows(dirty(spark, sf).select("_row_id", "order_id", "cust_id", note, "mostly_null"))


@query(
    "drop_impossible_rows",
    with_dirty(
        f"SELECT _row_id, age, salary FROM (SELECT row_id AS _row_id, {num('age')} AS age,"
        " CAST(order_id AS DOUBLE) - 100 AS salary FROM dirty)"
        " WHERE (age IS NULL OR (age >= 0 AND age <= 120)) AND salary >= 0"
    ),
)
def drop_impossible_rows(spark, sf):
    df = steps.change_dtype(dirty(spark, sf), "age", "float").select(
        "_row_id", "age", (F.col("order_id").cast("double") - 100).alias("salary")
    )
    return steps.drop_impossible_rows(df, age=["age"], salary=["salary"])


@query("drop_null_columns", with_dirty("SELECT row_id AS _row_id, order_id, cust_id, price, age, status, order_date FROM dirty"))
def drop_null_columns(spark, sf):
    return steps.drop_null_columns(dirty(spark, sf))


@query(
    "drop_unimportant_columns",
    with_dirty("SELECT row_id AS _row_id, cust_id, CASE WHEN mostly_null IS NOT NULL THEN order_id END AS order_code FROM dirty"),
)
def drop_unimportant_columns(spark, sf):
    df = dirty(spark, sf).select(
        "_row_id", "cust_id", F.when(F.col("mostly_null").isNotNull(), F.col("order_id")).alias("order_code"),
        (F.col("mostly_null") % 10).alias("last_digit"),
    )
    return steps.drop_unimportant_columns(df)


# --- duplicates -----------------------------------------------------------------------------------------
_DATA = "order_id, cust_id, price, age, status, order_date, mostly_null"


@query("dedup_first", with_dirty(f"SELECT min(row_id) AS _row_id, {_DATA} FROM dirty GROUP BY ALL"))
def dedup_first(spark, sf):
    return steps.remove_duplicates(dirty(spark, sf))


@query("dedup_last", with_dirty(f"SELECT max(row_id) AS _row_id, {_DATA} FROM dirty GROUP BY ALL"))
def dedup_last(spark, sf):
    return steps.remove_duplicates(dirty(spark, sf), keep="last")


@query("dedup_none", with_dirty(f"SELECT max(row_id) AS _row_id, {_DATA} FROM dirty GROUP BY ALL HAVING count(*) = 1"))
def dedup_none(spark, sf):
    return steps.remove_duplicates(dirty(spark, sf), keep=False)


@query(
    "dedup_subset",
    with_dirty(f"SELECT {ALL} FROM dirty QUALIFY row_number() OVER (PARTITION BY status, age ORDER BY row_id) = 1"),
)
def dedup_subset(spark, sf):
    return steps.remove_duplicates(dirty(spark, sf), ["status", "age"])


@query(
    "duplicate_id_members",
    with_dirty(
        "SELECT row_id AS _row_id, order_id, count(*) OVER (PARTITION BY order_id) AS id_rows FROM dirty"
        " QUALIFY count(*) OVER (PARTITION BY order_id) > 1"
    ),
)
def duplicate_id_members(spark, sf):
    return steps.duplicate_id_rows(dirty(spark, sf).select("_row_id", "order_id"), "order_id")


# --- order --------------------------------------------------------------------------------------------------
@query("sort_rank_nulls_last", with_dirty(
    "SELECT row_number() OVER (ORDER BY status ASC NULLS LAST, cust_id DESC NULLS LAST, row_id) - 1 AS _row_id,"
    " status, cust_id, order_id FROM dirty"
))
def sort_rank_nulls_last(spark, sf):
    """Sorted, then numbered by position: the order itself is compared."""
    from millrace.rows import number_rows

    df = dirty(spark, sf).select("_row_id", "status", "cust_id", "order_id")
    return number_rows(df, steps.sort_order(df, ["status", "cust_id"], [True, False]))


@query("preview_head", with_dirty(f"SELECT {ALL} FROM dirty ORDER BY row_id LIMIT 50"))
def preview_head(spark, sf):
    return preview(dirty(spark, sf), 50)


# --- groups ---------------------------------------------------------------------------------------------------
@query(
    "group_aggregate_basic",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS l_quantity, round(avg(l_discount), 8) AS l_discount,"
    " count(l_orderkey) AS l_orderkey, min(l_extendedprice) AS l_extendedprice, max(l_tax) AS l_tax"
    " FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def group_aggregate_basic(spark, sf):
    out = steps.group_aggregate(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
        {"l_quantity": "sum", "l_discount": "mean", "l_orderkey": "count", "l_extendedprice": "min", "l_tax": "max"},
    )
    return out.withColumns({"l_quantity": F.round("l_quantity", 4), "l_discount": F.round("l_discount", 8)})


@query(
    "group_aggregate_first_last",
    with_dirty(
        "SELECT status, arg_min(age, row_id) FILTER (age IS NOT NULL) AS age,"
        " arg_max(mostly_null, row_id) FILTER (mostly_null IS NOT NULL) AS mostly_null FROM dirty GROUP BY status"
    ),
)
def group_aggregate_first_last(spark, sf):
    return steps.group_aggregate(dirty(spark, sf), ["status"], {"age": "first", "mostly_null": "last"})


@query(
    "group_aggregate_std_var",
    "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS l_quantity, round(var_samp(l_tax), 8) AS l_tax"
    " FROM lineitem GROUP BY l_returnflag",
)
def group_aggregate_std_var(spark, sf):
    out = steps.group_aggregate(table(spark, sf, "lineitem"), ["l_returnflag"], {"l_quantity": "std", "l_tax": "var"})
    return out.withColumns({"l_quantity": F.round("l_quantity", 6), "l_tax": F.round("l_tax", 8)})


@query(
    "group_aggregate_text_coerce",
    with_dirty(
        f"SELECT cust_id, round(coalesce(sum({num('price')}), 0), 2) AS price, round(avg({num('age')}), 6) AS age"
        " FROM dirty WHERE cust_id IS NOT NULL GROUP BY cust_id"
    ),
)
def group_aggregate_text_coerce(spark, sf):
    out = steps.group_aggregate(dirty(spark, sf), ["cust_id"], {"price": "sum", "age": "mean"})
    return out.withColumns({"price": F.round("price", 2), "age": F.round("age", 6)})


# --- fills ----------------------------------------------------------------------------------------------------
@query("fill_value", with_dirty("SELECT row_id AS _row_id, coalesce(age, '0') AS age FROM dirty"))
def fill_value(spark, sf):
    return fill_missing(dirty(spark, sf).select("_row_id", "age"), "age", "value", 0)


_AGE = num("age")


@query(
    "fill_mean",
    with_dirty(f"SELECT row_id AS _row_id, round(coalesce({_AGE}, (SELECT avg({_AGE}) FROM dirty)), 6) AS age FROM dirty"),
)
def fill_mean(spark, sf):
    out = fill_missing(dirty(spark, sf).select("_row_id", "age"), "age", "mean")
    return out.withColumn("age", F.round("age", 6))


@query(
    "fill_median",
    with_dirty(f"SELECT row_id AS _row_id, coalesce({num('price')}, (SELECT median({num('price')}) FROM dirty)) AS price FROM dirty"),
)
def fill_median(spark, sf):
    return fill_missing(dirty(spark, sf).select("_row_id", "price"), "price", "median")


@query(
    "fill_mode",
    with_dirty(
        "SELECT row_id AS _row_id, coalesce(age, (SELECT age FROM dirty WHERE age IS NOT NULL GROUP BY age"
        " ORDER BY count(*) DESC, age LIMIT 1)) AS age FROM dirty"
    ),
)
def fill_mode(spark, sf):
    return fill_missing(dirty(spark, sf).select("_row_id", "age"), "age", "mode")


_AUTO_AGE = (
    f"(SELECT CASE WHEN abs(skewness({_AGE})) < 0.5 THEN avg({_AGE}) ELSE median({_AGE}) END FROM dirty)"
)


@query("fill_auto", with_dirty(f"SELECT row_id AS _row_id, round(coalesce({_AGE}, {_AUTO_AGE}), 6) AS age FROM dirty"))
def fill_auto(spark, sf):
    out = fill_missing(dirty(spark, sf).select("_row_id", "age"), "age", "auto")
    return out.withColumn("age", F.round("age", 6))


@query(
    "fill_auto_all",
    with_dirty(
        f"SELECT row_id AS _row_id, round(coalesce({_AGE}, {_AUTO_AGE}), 6) AS age,"
        " round(coalesce(mostly_null, (SELECT CASE WHEN abs(skewness(mostly_null)) < 0.5 THEN avg(mostly_null)"
        " ELSE median(mostly_null) END FROM dirty)), 6) AS mostly_null,"
        " coalesce(note, (SELECT note FROM (SELECT CASE WHEN order_id % 6 = 0 THEN NULL ELSE status END AS note FROM dirty)"
        " WHERE note IS NOT NULL GROUP BY note ORDER BY count(*) DESC, note LIMIT 1)) AS note"
        " FROM (SELECT *, CASE WHEN order_id % 6 = 0 THEN NULL ELSE status END AS note FROM dirty) x"
    ),
)
def fill_auto_all(spark, sf):
    df = dirty(spark, sf).select(
        "_row_id", "age", "mostly_null", F.when(F.col("order_id") % 6 != 0, F.col("status")).alias("note")
    )
    return fill_missing(df).withColumns({"age": F.round("age", 6), "mostly_null": F.round("mostly_null", 6)})


def _carry(name: str, method: str, pick: str, frame: str):
    @query(
        name,
        with_dirty(
            f"SELECT row_id AS _row_id, {pick}(mostly_null IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN {frame}) AS mostly_null FROM dirty"
        ),
    )
    def run(spark, sf):
        return fill_missing(dirty(spark, sf).select("_row_id", "mostly_null"), "mostly_null", method)

    return run


_carry("ffill", "ffill", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW")
_carry("bfill", "bfill", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")


@query(
    "ffill_by_group",
    with_dirty(
        "SELECT row_id AS _row_id, status, last_value(mostly_null IGNORE NULLS) OVER (PARTITION BY status ORDER BY row_id"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mostly_null FROM dirty"
    ),
)
def ffill_by_group(spark, sf):
    df = dirty(spark, sf).select("_row_id", "status", "mostly_null")
    return fill_missing(df, "mostly_null", "ffill", partition_by=["status"])




# --- exact filters on BIGINT above 2^53 ------------------------------------------------------------
_SHIFT = 9007199254740992


def _shifted(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_orderkey") + _SHIFT).alias("big"), "o_custkey")


@query("filter_bigint_eq", f"SELECT o_orderkey + {_SHIFT} AS big, o_custkey FROM orders WHERE o_orderkey = 1")
def filter_bigint_eq(spark, sf):
    return steps.filter_rows(_shifted(spark, sf), "big", "==", str(_SHIFT + 1))


@query("filter_bigint_ge", f"SELECT o_orderkey + {_SHIFT} AS big, o_custkey FROM orders WHERE o_orderkey >= 1001")
def filter_bigint_ge(spark, sf):
    return steps.filter_rows(_shifted(spark, sf), "big", ">=", _SHIFT + 1001)
