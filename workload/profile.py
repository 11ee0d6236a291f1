"""Profiles: counts, statistics, frequent values, types, distribution figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.operators import diff, facts, infer, stats, steps
from millrace.sources import scan

from .base import DIRTY_COLUMNS, bare, day, dirty, num, query, table, with_dirty, word


def per_column(template: str, columns=DIRTY_COLUMNS) -> str:
    """One SELECT per column, joined by UNION ALL."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query("null_counts", with_dirty(per_column("SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS null_count FROM dirty")))
def null_counts(spark, sf):
    return facts.null_counts(dirty(spark, sf))


_STATS = (
    "SELECT '{c}' AS column, '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count,"
    " CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean,"
    " round(stddev_samp({c}), 6) AS std, CAST(median({c}) AS DOUBLE) AS median FROM dirty"
)
_STATS_TEXT = (
    "SELECT '{c}' AS column, 'string' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count,"
    " NULL AS min, NULL AS max, NULL AS mean, NULL AS std, NULL AS median FROM dirty"
)


@query(
    "column_stats",
    with_dirty(
        " UNION ALL ".join(
            [_STATS.replace("{c}", c).replace("{t}", t) for c, t in (("order_id", "bigint"), ("cust_id", "bigint"), ("mostly_null", "double"))]
            + [_STATS_TEXT.replace("{c}", c) for c in ("price", "age", "status", "order_date")]
        )
    ),
)
def column_stats(spark, sf):
    return facts.column_stats(dirty(spark, sf)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_LINE_NUMBERS = (
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
    ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
)


@query(
    "column_stats_lineitem",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{t}' AS dtype, 0 AS null_count, count(DISTINCT {c}) AS unique_count, CAST(min({c}) AS DOUBLE) AS min,"
        f" CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 6) AS std,"
        f" CAST(median({c}) AS DOUBLE) AS median FROM lineitem"
        for c, t in _LINE_NUMBERS
    ),
)
def column_stats_lineitem(spark, sf):
    df = table(spark, sf, "lineitem").select(*[c for c, _ in _LINE_NUMBERS])
    return facts.column_stats(df).withColumns({"mean": F.round("mean", 9), "std": F.round("std", 6)})


_TEXTS = ("price", "age", "status", "order_date")


@query(
    "top_values",
    with_dirty(
        'SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n FROM ('
        + per_column("SELECT '{c}' AS column, {c} AS value, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}", _TEXTS)
        + ') QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 5'
    ),
)
def top_values(spark, sf):
    return stats.top_values(dirty(spark, sf))


def _number_of(c: str) -> str:
    return num(c) if c in _TEXTS else f"CAST({c} AS DOUBLE)"


def _profile_sql(c: str) -> str:
    x, is_text = _number_of(c), c in _TEXTS
    s = c if is_text else "NULL::VARCHAR"
    return (
        f"SELECT '{c}' AS column, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count,"
        f" round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS unique_count,"
        f" min({x}) AS num_min, max({x}) AS num_max, round(avg({x}), 6) AS num_mean, median({x}) AS num_median,"
        f" round(stddev_samp({x}), 6) AS num_std, CASE WHEN count({x}) > 0 THEN count(*) FILTER ({x} < 0) END AS negative_count,"
        f" count(*) FILTER ({s} <> trim({s})) > 0 AS has_padding, count(DISTINCT {s}) <> count(DISTINCT lower({s})) AS has_mixed_case,"
        f" coalesce(max(length({s})), 0) AS max_length, coalesce(min(length({s})), 0) AS min_length,"
        f" count(*) FILTER (regexp_matches({s}, '[£$€¥₹]')) > 0 AS has_currency_symbols,"
        f" count(*) FILTER ({word(s) if is_text else 'NULL'} IS NOT NULL) > 0 AS has_word_numbers,"
        f" (SELECT string_agg(v, '|' ORDER BY row_id) FROM (SELECT row_id, CAST({c} AS VARCHAR) AS v FROM dirty WHERE {c} IS NOT NULL"
        " ORDER BY row_id LIMIT 5)) AS samples FROM dirty"
    )


@query("column_profile", with_dirty(" UNION ALL ".join(_profile_sql(c) for c in DIRTY_COLUMNS)))
def column_profile(spark, sf):
    p = facts.column_profile(dirty(spark, sf))
    n, s = F.col("numeric_stats"), F.col("string_stats")
    return p.select(
        "column", "row_count", "null_count", "null_pct", "unique_count", n["min"].alias("num_min"), n["max"].alias("num_max"),
        F.round(n["mean"], 6).alias("num_mean"), n["median"].alias("num_median"), F.round(n["std"], 6).alias("num_std"),
        n["negative_count"].alias("negative_count"), s["has_padding"].alias("has_padding"),
        s["has_mixed_case"].alias("has_mixed_case"), s["max_length"].alias("max_length"), s["min_length"].alias("min_length"),
        "has_currency_symbols", "has_word_numbers", F.array_join("sample_values", "|").alias("samples"),
    )


_TAGS = (
    "SELECT '{c}' AS column, count(*) FILTER (regexp_full_match(trim({c}), '[+-]?\\d{1,18}')) AS int_cells,"
    " count(*) FILTER ({n} IS NOT NULL AND NOT regexp_full_match(trim({c}), '[+-]?\\d{1,18}')) AS float_cells,"
    " 0 AS bool_cells, count(*) FILTER ({c} IS NOT NULL AND {n} IS NULL) AS str_cells, 0 AS other_cells FROM dirty"
)


@query(
    "cell_type_histogram",
    with_dirty(
        " UNION ALL ".join(
            [_TAGS.replace("{n}", num(c)).replace("{c}", c) for c in _TEXTS]
            + [f"SELECT '{c}', count({c}), 0, 0, 0, 0 FROM dirty" for c in ("order_id", "cust_id")]
            + ["SELECT 'mostly_null', 0, count(mostly_null), 0, 0, 0 FROM dirty"]
        )
    ),
)
def cell_type_histogram(spark, sf):
    return facts.cell_types(dirty(spark, sf))


_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in DIRTY_COLUMNS)
_COLS = ", ".join(DIRTY_COLUMNS)


@query(
    "table_totals",
    with_dirty(
        f"SELECT count(*) AS rows, 7 AS cols, {_NULLS} AS total_nulls, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_COLS}"
        " FROM dirty)) AS duplicate_rows FROM dirty"
    ),
)
def table_totals(spark, sf):
    return facts.table_totals(dirty(spark, sf))


@query("duplicate_count", with_dirty(f"SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_COLS} FROM dirty)) AS duplicate_rows FROM dirty"))
def duplicate_count(spark, sf):
    return facts.duplicate_count(dirty(spark, sf))


@query(
    "duplicate_ids",
    with_dirty(
        'SELECT "column", CAST(sum(n - 1) AS BIGINT) AS beyond_first, CAST(sum(n) AS BIGINT) AS member_rows, count(*) AS repeated_ids,'
        " array_to_string((list(value ORDER BY value))[1:3], '|') AS examples FROM ("
        + per_column("SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}", ("order_id", "cust_id"))
        + ') WHERE n > 1 GROUP BY "column"'
    ),
)
def duplicate_ids(spark, sf):
    out = steps.duplicate_ids(dirty(spark, sf), ["order_id", "cust_id"])
    return out.withColumn("examples", F.array_join("examples", "|"))


@query(
    "corrected_skewness",
    "SELECT l_returnflag, round(skewness(l_extendedprice * l_discount), 6) AS skew FROM lineitem GROUP BY l_returnflag",
)
def corrected_skewness(spark, sf):
    x = F.col("l_extendedprice") * F.col("l_discount")
    g = table(spark, sf, "lineitem").groupBy("l_returnflag")
    return g.agg(F.round(numbers.corrected_skewness(F.count(x), F.skewness(x)), 6).alias("skew"))


@query(
    "mode_value",
    with_dirty(
        'SELECT "column", value FROM ('
        + per_column("SELECT '{c}' AS column, {c} AS value, count(*) AS n FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}", _TEXTS)
        + ') QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) = 1'
    ),
)
def mode_value(spark, sf):
    found = stats.modes(dirty(spark, sf), list(_TEXTS))
    return spark.createDataFrame(list(found.items()), "column string, value string")


@query(
    "median_date",
    with_dirty(
        f"SELECT strftime(d, '%Y-%m-%d') AS median_date FROM (SELECT {day('order_date')} AS d FROM dirty) WHERE d IS NOT NULL"
        f" QUALIFY row_number() OVER (ORDER BY d) = (SELECT count({day('order_date')}) // 2 + 1 FROM dirty)"
    ),
)
def median_date(spark, sf):
    from millrace.functions import dates

    d = dirty(spark, sf).select(F.unix_date(dates.first_date(F.col("order_date"))).cast("double").alias("d"))
    n = d.agg(F.count("d").alias("n")).first()["n"]
    found = stats.order_statistics(d, [stats.Ranks("d", F.col("d"), n, (n // 2 + 1,))])["d"][0]
    return spark.range(1).select(dates.iso_text(F.date_from_unix_date(F.lit(int(found)))).alias("median_date"))


@query(
    "top_null_columns",
    with_dirty(
        'SELECT "column", null_count, round(100.0 * null_count / (SELECT count(*) FROM dirty), 1) AS null_pct,'
        " CASE WHEN round(100.0 * null_count / (SELECT count(*) FROM dirty), 1) > 50 THEN 'red'"
        " WHEN round(100.0 * null_count / (SELECT count(*) FROM dirty), 1) > 20 THEN 'amber' ELSE 'green' END AS band FROM ("
        + per_column("SELECT '{c}' AS column, count(*) FILTER ({c} IS NULL) AS null_count FROM dirty")
        + ') WHERE null_count > 0 ORDER BY null_count DESC, "column" LIMIT 10'
    ),
)
def top_null_columns(spark, sf):
    df = dirty(spark, sf)
    return diff.top_null_columns(facts.null_counts(df), df.count())


# --- inference ------------------------------------------------------------------------------
# Shares per column decide the types; names give the semantic type.
def _shares(c: str) -> str:
    is_text = c in _TEXTS
    stripped = num(bare(c)) if is_text else f"CAST({c} AS DOUBLE)"
    days = day(c) if is_text else "NULL"
    length = f"avg(length({c}))" if is_text else "0"
    return (
        f"SELECT '{c}' AS col, {is_text} AS is_text, count({_number_of(c)}) / count({c}) AS num_share,"
        f" count({stripped}) / count({c}) AS fnum_share, count({days}) / count({c}) AS day_share,"
        f" count(DISTINCT {c}) / count({c}) AS uniq, {length} AS len FROM dirty"
    )


_SHARES = ", shares AS (" + " UNION ALL ".join(_shares(c) for c in DIRTY_COLUMNS) + ")"
_NAMED = (
    "CASE col WHEN 'order_id' THEN 'id' WHEN 'cust_id' THEN 'id' WHEN 'price' THEN 'money' WHEN 'age' THEN 'age'"
    " WHEN 'order_date' THEN 'date' ELSE 'unknown' END"
)


@query(
    "infer_schema",
    with_dirty(
        f"{_SHARES} SELECT col AS \"column\", {_NAMED} AS semantic_type, CASE WHEN num_share > 0.7 THEN 'numeric'"
        f" WHEN day_share > 0.5 THEN 'date' ELSE 'text' END AS storage_type, CASE {_NAMED} WHEN 'unknown' THEN 'low'"
        f" ELSE 'high' END AS confidence, CASE {_NAMED} WHEN 'unknown' THEN CASE WHEN num_share > 0.7 THEN 'numeric_columns'"
        f" ELSE 'categorical_columns' END ELSE {_NAMED} || '_columns' END AS bucket FROM shares"
    ),
)
def infer_schema(spark, sf):
    return infer.infer_schema(dirty(spark, sf))


@query(
    "infer_report_types",
    with_dirty(
        f"{_SHARES} SELECT col AS \"column\", CASE WHEN NOT is_text AND col LIKE '%_id' THEN 'id' WHEN NOT is_text THEN 'numeric'"
        " WHEN col = 'order_date' AND day_share > 0.5 THEN 'date' WHEN fnum_share > 0.7 THEN 'numeric'"
        " WHEN uniq > 0.6 OR len > 60 THEN 'text' ELSE 'categorical' END AS column_type FROM shares"
    ),
)
def infer_report_types(spark, sf):
    return infer.column_types(dirty(spark, sf), "report")


@query(
    "infer_auto_types",
    with_dirty(
        f"{_SHARES} SELECT col AS \"column\", CASE WHEN NOT is_text THEN 'numeric' WHEN day_share > 0.7 THEN 'datetime'"
        " WHEN fnum_share > 0.7 THEN 'numeric' WHEN uniq > 0.5 OR len > 50 THEN 'text' ELSE 'categorical' END AS column_type FROM shares"
    ),
)
def infer_auto_types(spark, sf):
    return infer.column_types(dirty(spark, sf), "auto")


_SIGNS = "(SELECT count(*) FILTER (regexp_matches({c}, '[£$€¥₹]')) / count({c}) FROM dirty)"


def _roles(sign_share: float, date_rule: str) -> str:
    text_roles = " UNION ALL ".join(
        f"SELECT 'currency_columns', '{c}' WHERE {'TRUE' if c == 'price' else _SIGNS.replace('{c}', c) + f' > {sign_share}'}"
        for c in _TEXTS
    )
    return with_dirty(
        f"{_SHARES} SELECT 'age_columns' AS role, col AS \"column\" FROM shares WHERE col = 'age' UNION ALL {text_roles}"
        f" UNION ALL SELECT 'date_columns', col FROM shares WHERE is_text AND {date_rule}"
    )


@query("detect_roles", _roles(0.1, "(day_share > 0.7 OR (day_share > 0.4 AND col = 'order_date'))"))
def detect_roles(spark, sf):
    return infer.role_table(dirty(spark, sf), "smart")


@query("suggest_roles", _roles(0.05, "col = 'order_date' AND day_share > 0.5"))
def suggest_roles(spark, sf):
    return infer.role_table(dirty(spark, sf), "report")


# --- the engine's own scans ----------------------------------------------------------------------
@query("scan_parquet_ids", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey FROM orders")
def scan_parquet_ids(spark, sf):
    """Row ids of a Parquet scan; the table lies in the order of its key."""
    orders = scan.read_parquet(spark, f"{sf}/orders.parquet")
    return orders.select(F.col("_row_id").alias("place"), "o_orderkey")


@query(
    "scan_narrow_types",
    "SELECT l_orderkey, l_orderkey + 1000000000000000000 AS wide, CAST(l_orderkey AS DECIMAL(38,0)) + 10000000000000000000 AS wider, l_extendedprice AS price FROM lineitem",
)
def scan_narrow_types(spark, sf):
    """Texts back to their types: BIGINT, 19 digits, 20 digits, DOUBLE."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        (F.col("l_orderkey") + 1000000000000000000).cast("string").alias("wide"),
        (F.col("l_orderkey").cast("decimal(38,0)") + F.expr("CAST('10000000000000000000' AS DECIMAL(38,0))")).cast("decimal(38,0)").cast("string").alias("wider"),
        F.col("l_extendedprice").cast("string").alias("price"),
    )
    return scan.narrow_types(lines)
