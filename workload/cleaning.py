"""The three cleaners on the dirty table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import facts, infer
from millrace.plans import clean_layers as layers
from millrace.plans.clean_auto import auto_clean
from millrace.plans.clean_smart import preview_clean, smart_clean

from .base import DIRTY_COLUMNS, day, day_text, dirty, fnum, null_like, num, query, with_dirty, word
from .quality import layer_parts, pair_of, score_of

_TEXTS = ("price", "age", "status", "order_date")


def filled(table: str, column: str, skewed: str | None = None) -> str:
    """Mean or median of a column by the skewness rule."""
    return (
        f"(SELECT CASE WHEN abs(coalesce(skewness({column}), 0)) < 0.5 THEN avg({column}) ELSE median({column}) END FROM {table})"
    )


def most_frequent(table: str, column: str) -> str:
    return f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"


# --- automatic cleaner -----------------------------------------------------------------------
_AUTO = with_dirty(
    f", c AS (SELECT row_id, order_id, cust_id, {fnum('price')} AS price, {fnum('age')} AS age, trim(status) AS status,"
    f" {day('order_date')} AS order_date, mostly_null FROM dirty), f AS (SELECT row_id AS _row_id, order_id, round(coalesce(cust_id, {filled('c', 'cust_id')}), 6) AS cust_id,"
    f" round(coalesce(price, {filled('c', 'price')}), 6) AS price, round(coalesce(age, {filled('c', 'age')}), 6) AS age, status,"
    " strftime(coalesce(order_date, (SELECT order_date FROM c WHERE order_date IS NOT NULL ORDER BY order_date LIMIT 1 OFFSET"
    " (SELECT count(order_date) // 2 FROM c))), '%Y-%m-%d') AS order_date, mostly_null FROM c) SELECT * FROM f"
)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("clean_auto", _AUTO)
def clean_auto(spark, sf):
    """The 60 % empty column stays: its values are nearly unique."""
    return _rounded(auto_clean(dirty(spark, sf)).df, "cust_id", "price", "age")


@query(
    "clean_auto_keep",
    with_dirty(
        "SELECT row_id AS _row_id, order_id, mostly_null, coalesce(note, 'Unknown') AS note, coalesce(label, 'Unknown') AS label FROM"
        " (SELECT *, CASE WHEN order_id % 2 = 0 THEN trim(status) END AS note, CASE WHEN order_id % 9 > 0 THEN 'L' || (order_id % 31) END AS label FROM dirty)"
        " WHERE (CASE WHEN mostly_null IS NULL THEN 1 ELSE 0 END) / 4.0 < 0.5"
    ),
)
def clean_auto_keep(spark, sf):
    """Columns may stay; text with many gaps or many values gets 'Unknown'."""
    k = F.col("order_id")
    df = dirty(spark, sf).select(
        "_row_id", "order_id", "mostly_null", F.when(k % 2 == 0, F.col("status")).alias("note"),
        F.when(k % 9 > 0, F.concat(F.lit(" L"), (k % 31).cast("string"))).alias("label"),
    )
    return auto_clean(df, drop_columns_above_threshold=False).df




@query(
    "clean_auto_explanations",
    with_dirty(
        "SELECT * FROM (SELECT 'order_id' AS \"column\", 'NONE' AS decision, 'numeric' AS detected_type UNION ALL SELECT 'cust_id',"
        f" {'CASE WHEN abs(skewness(cust_id)) < 0.5 THEN {0} ELSE {1} END'.format(chr(39) + 'MEAN' + chr(39), chr(39) + 'MEDIAN' + chr(39))}, 'numeric' FROM dirty"
        f" UNION ALL SELECT 'price', CASE WHEN abs(skewness({fnum('price')})) < 0.5 THEN 'MEAN' ELSE 'MEDIAN' END, 'numeric' FROM dirty"
        f" UNION ALL SELECT 'age', CASE WHEN abs(skewness({fnum('age')})) < 0.5 THEN 'MEAN' ELSE 'MEDIAN' END, 'numeric' FROM dirty"
        " UNION ALL SELECT 'status', CASE WHEN count(*) FILTER (status <> trim(status)) > 0 THEN 'FORMAT' ELSE 'NONE' END, 'categorical' FROM dirty"
        f" UNION ALL SELECT 'order_date', CASE WHEN count(*) FILTER ({day('order_date')} IS NULL) > 0 THEN 'MEDIAN_DATE' ELSE 'NONE' END, 'datetime' FROM dirty"
        " UNION ALL SELECT 'mostly_null', CASE WHEN count(*) FILTER (mostly_null IS NULL) > 0.4 * count(*) AND count(DISTINCT mostly_null)"
        " < 0.9 * count(mostly_null) THEN 'DROP_COLUMN' ELSE 'KEEP_AS_NAN' END, 'numeric' FROM dirty)"
    ),
)
def clean_auto_explanations(spark, sf):
    return auto_clean(dirty(spark, sf)).explanations().select("column", "decision", "detected_type")


# --- smart cleaner --------------------------------------------------------------------------------
_SMART_CTES = (
    f", n AS (SELECT row_id, order_id, cust_id, CASE WHEN NOT {null_like('price')} THEN price END AS price,"
    f" CASE WHEN age IS NOT NULL AND NOT {null_like('age')} THEN age END AS age, CASE WHEN NOT {null_like('status')} THEN status END AS status,"
    " order_date, mostly_null FROM dirty),"
    f" t AS (SELECT row_id, order_id, cust_id, {num(chr(112) + 'rice')} AS plain, {fnum('price')} AS price, coalesce({word('age')}, {num('age')}) AS age, status,"
    f" {day_text('order_date')} AS order_date, mostly_null FROM n),"
    " ok AS (SELECT *, (CAST(order_id IS NULL AS INT) + CAST(cust_id IS NULL AS INT) + CAST(price IS NULL AS INT) + CAST(age IS NULL AS INT)"
    " + CAST(status IS NULL AS INT) + CAST(order_date IS NULL AS INT) + CAST(mostly_null IS NULL AS INT)) / 7.0 AS gap,"
    " coalesce(age < 0 OR age > 120, FALSE) AS bad FROM t),"
    " kept AS (SELECT * FROM ok WHERE NOT bad AND gap < 0.5),"
    f" f AS (SELECT row_id, order_id, coalesce(CAST(cust_id AS DOUBLE), (SELECT median(cust_id) FROM kept)) AS cust_id, coalesce(price, (SELECT median(price) FROM kept)) AS price,"
    f" coalesce(age, (SELECT median(age) FROM kept)) AS age, status, coalesce(order_date, {most_frequent('kept', 'order_date')}) AS order_date FROM kept)"
)
_SMART_COLS = "order_id, cust_id, price, age, status, order_date"


@query(
    "clean_smart",
    with_dirty(
        f"{_SMART_CTES} SELECT min(row_id) AS _row_id, {_SMART_COLS} FROM f GROUP BY ALL"
    ),
)
def clean_smart(spark, sf):
    return smart_clean(dirty(spark, sf)).df


@query(
    "clean_smart_summary",
    with_dirty(
        f"{_SMART_CTES}, d AS (SELECT DISTINCT {_SMART_COLS} FROM f) SELECT (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM d) AS rows_after,"
        " (SELECT count(*) FROM dirty) - (SELECT count(*) FROM d) AS rows_removed,"
        " (SELECT " + " + ".join(f"count(*) FILTER ({null_like(c)})" for c in _TEXTS) + " FROM dirty) AS null_strings_replaced,"
        " (SELECT count(*) FILTER (price LIKE '%$%') FROM n) AS currency_stripped,"
        f" (SELECT count(*) FILTER ({word('age')} IS NOT NULL) FROM n) AS word_nums_converted,"
        " (SELECT count(*) FROM n JOIN t USING (row_id) WHERE t.order_date IS NOT NULL AND t.order_date <> n.order_date) AS dates_normalized,"
        " (SELECT count(*) FROM ok WHERE NOT bad AND gap >= 0.5) AS sparse_rows_removed,"
        " (SELECT count(*) FILTER (cust_id IS NULL) + count(*) FILTER (price IS NULL) + count(*) FILTER (age IS NULL) + count(*) FILTER (order_date IS NULL) FROM kept) AS nulls_filled,"
        " 1 AS cols_dropped, (SELECT count(*) FROM f) - (SELECT count(*) FROM d) AS dupes_removed"
    ),
)
def clean_smart_summary(spark, sf):
    return smart_clean(dirty(spark, sf)).summary()


@query(
    "clean_smart_log",
    with_dirty(
        f"{_SMART_CTES}, log AS ("
        + " UNION ALL ".join(f"SELECT 'null_tokens' AS stage, '{c}' AS col, count(*) FILTER ({null_like(c)}) AS cells FROM dirty" for c in _TEXTS)
        + " UNION ALL SELECT 'currency', 'price', count(*) FILTER (price LIKE '%$%') FROM n"
        f" UNION ALL SELECT 'word_numbers', 'age', count(*) FILTER ({word('age')} IS NOT NULL) FROM n"
        " UNION ALL SELECT 'coerced_to_null', 'price', count(*) FROM n JOIN t USING (row_id) WHERE n.price IS NOT NULL AND t.price IS NULL"
        " UNION ALL SELECT 'coerced_to_null', 'age', count(*) FROM n JOIN t USING (row_id) WHERE n.age IS NOT NULL AND t.age IS NULL"
        " UNION ALL SELECT 'dates', 'order_date', count(*) FROM n JOIN t USING (row_id) WHERE t.order_date IS NOT NULL AND t.order_date <> n.order_date"
        " UNION ALL SELECT 'impossible_values', 'age', count(*) FILTER (bad) FROM ok"
        " UNION ALL SELECT 'impossible_rows', NULL, count(*) FILTER (bad) FROM ok"
        " UNION ALL SELECT 'sparse_rows', NULL, count(*) FILTER (NOT bad AND gap >= 0.5) FROM ok"
        + "".join(f" UNION ALL SELECT 'fill', '{c}', count(*) FILTER ({c} IS NULL) FROM kept" for c in ("cust_id", "price", "age", "order_date"))
        + " UNION ALL SELECT 'drop_columns', 'mostly_null', count(*) FILTER (mostly_null IS NULL) FROM kept)"
        " SELECT stage, col AS \"column\", cells FROM log WHERE cells > 0"
    ),
)
def clean_smart_log(spark, sf):
    return smart_clean(dirty(spark, sf)).log_table()


_DIRTY_COLS = ", ".join(DIRTY_COLUMNS)


@query(
    "clean_smart_preview_totals",
    with_dirty(
        f"{_SMART_CTES}, d AS (SELECT DISTINCT {_SMART_COLS} FROM f) SELECT 'before' AS version, count(*) AS rows, 7 AS cols, "
        + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in DIRTY_COLUMNS)
        + f" AS total_nulls, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_DIRTY_COLS} FROM dirty)) AS duplicate_rows FROM dirty"
        " UNION ALL SELECT 'after', count(*), 6, 0, 0 FROM d"
    ),
)
def clean_smart_preview_totals(spark, sf):
    return preview_clean(dirty(spark, sf))["totals"]


@query(
    "clean_smart_explanations",
    with_dirty(
        f"{_SMART_CTES}, x AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS col, 'info' AS severity, count(*) FILTER ({null_like(c)}) AS k FROM dirty" for c in _TEXTS)
        + " UNION ALL SELECT 'price', 'info', count(*) FILTER (price LIKE '%$%') FROM n"
        f" UNION ALL SELECT 'age', 'warning', count(*) FILTER ({word('age')} IS NOT NULL) FROM n"
        " UNION ALL SELECT 'order_date', 'warning', count(*) FROM n JOIN t USING (row_id) WHERE t.order_date <> n.order_date"
        " UNION ALL SELECT 'age', 'critical', count(*) FILTER (bad) FROM ok"
        " UNION ALL SELECT NULL, 'warning', count(*) FILTER (NOT bad AND gap >= 0.5) FROM ok"
        + "".join(f" UNION ALL SELECT '{c}', 'info', count(*) FILTER ({c} IS NULL) FROM kept" for c in ("cust_id", "price", "age", "order_date"))
        + " UNION ALL SELECT 'mostly_null', 'warning', 1) SELECT col AS \"column\", severity FROM x WHERE k > 0"
    ),
)
def clean_smart_explanations(spark, sf):
    return smart_clean(dirty(spark, sf)).explanations().select("column", "severity")


# --- layers -------------------------------------------------------------------------------------------
def _schema(df):
    held = facts.collect_facts(facts.column_facts(df, parts=frozenset({facts.TEXT, facts.DATES})))
    return infer.semantic_schema(held), held


_MONEY = f"CASE WHEN regexp_matches(price, '[£$€¥₹]') THEN CAST({fnum('price')} AS VARCHAR) ELSE trim(price) END"
_A = "TRY_CAST(substr(order_date, 1, 2) AS INT)"
_CAREFUL = (
    "CASE WHEN order_date LIKE '____/%' THEN replace(order_date, '/', '-')"
    f" WHEN order_date LIKE '__/%' AND {_A} > 12 THEN {day_text('order_date')} ELSE order_date END"
)
_NORMAL = (
    f", l4 AS (SELECT row_id, order_id, cust_id, {_MONEY} AS price, CASE WHEN age = 'thirty' THEN '30' ELSE age END AS age,"
    f" lower(trim(status)) AS status, {_CAREFUL} AS order_date, mostly_null FROM dirty)"
)
_VALID = (
    f", l5 AS (SELECT row_id, order_id, cust_id, {num('price')} AS price, CASE WHEN {num('age')} BETWEEN 0 AND 120 THEN {num('age')} END AS age,"
    " status, CASE WHEN order_date LIKE '____-%' AND try_strptime(order_date, '%Y-%m-%d') IS NOT NULL THEN order_date END AS order_date, mostly_null FROM l4)"
)
_REPAIRED = (
    f", l6 AS (SELECT row_id, order_id, cust_id, round(coalesce(price, {filled('l5', 'price')}), 6) AS price,"
    f" round(coalesce(age, {filled('l5', 'age')}), 6) AS age, status, order_date, round(coalesce(mostly_null, {filled('l5', 'mostly_null')}), 6) AS mostly_null FROM l5)"
)


@query("clean_layers_normalise", with_dirty(f"{_NORMAL} SELECT row_id AS _row_id, * EXCLUDE (row_id, price), {num('price')} AS price FROM l4"))
def clean_layers_normalise(spark, sf):
    df = dirty(spark, sf)
    out = layers.normalise(df, _schema(df)[0])
    from millrace.functions.numbers import parse_number

    return out.withColumn("price", parse_number(F.col("price")))


@query("clean_layers_validate", with_dirty(f"{_NORMAL}{_VALID} SELECT row_id AS _row_id, * EXCLUDE (row_id) FROM l5"))
def clean_layers_validate(spark, sf):
    df = dirty(spark, sf)
    schema, _ = _schema(df)
    return layers.validate(layers.normalise(df, schema), schema)


def _percent(held):
    return {c: 100 * f["null_count"] / f["row_count"] for c, f in held.items()}


@query("repair_layer", with_dirty(f"{_NORMAL}{_VALID}{_REPAIRED} SELECT row_id AS _row_id, * EXCLUDE (row_id) FROM l6"))
def repair_layer(spark, sf):
    df = dirty(spark, sf)
    schema, held = _schema(df)
    out = layers.repair(layers.validate(layers.normalise(df, schema), schema), schema, _percent(held))
    return _rounded(out, "price", "age", "mostly_null")


@query(
    "clean_layers_full",
    with_dirty(f"{_NORMAL}{_VALID}{_REPAIRED} SELECT min(row_id) AS _row_id, {_DIRTY_COLS} FROM l6 GROUP BY ALL"),
)
def clean_layers_full(spark, sf):
    chosen = [layer for layer in layers.LAYERS if layer != "quality_scoring"]
    result = layers.run_layers(dirty(spark, sf), layers=chosen, strict=True)
    if result.errors:
        raise RuntimeError(result.errors)
    return _rounded(result.df, "price", "age", "mostly_null")


@query(
    "clean_layers_keep_none",
    with_dirty(f"{_NORMAL}{_VALID}{_REPAIRED} SELECT min(row_id) AS _row_id, {_DIRTY_COLS} FROM l6 GROUP BY ALL HAVING count(*) = 1"),
)
def clean_layers_keep_none(spark, sf):
    chosen = [layer for layer in layers.LAYERS if layer not in ("quality_scoring", "audit_logging")]
    result = layers.run_layers(dirty(spark, sf), {"duplicate_keep": "none"}, chosen, strict=True)
    return _rounded(result.df, "price", "age", "mostly_null")


@query(
    "clean_layers_custom_rules",
    with_dirty(
        f"{_NORMAL} SELECT row_id AS _row_id, CASE WHEN {num('age')} BETWEEN 21 AND 60 THEN {num('age')} END AS age,"
        f" CASE WHEN {num('price')} >= 50000 THEN {num('price')} END AS price FROM l4"
    ),
)
def clean_layers_custom_rules(spark, sf):
    df = dirty(spark, sf)
    schema, _ = _schema(df)
    rules = {"age_min": 21, "age_max": 60, "money_min": 50000}
    return layers.validate(layers.normalise(df, schema), schema, rules).select("_row_id", "age", "price")


def _entry(column: str, action: str, confidence: str, layer: str, where: str, source: str = "dirty") -> str:
    return f"SELECT row_id AS _row_id, '{column}' AS col, '{action}' AS action, '{confidence}' AS confidence, '{layer}' AS layer FROM {source} WHERE {where}"


_B = "TRY_CAST(substr(order_date, 4, 2) AS INT)"
_NORMAL_AUDIT = [
    _entry(c, "strip_whitespace", "high", "normalization", f"{c} <> trim({c})") for c in _TEXTS
] + [
    _entry("status", "normalise_case", "medium", "normalization", "trim(status) <> lower(trim(status))"),
    _entry("price", "strip_currency", "high", "normalization", "price LIKE '%$%'"),
    _entry("age", "convert_word_number", "high", "normalization", "age = 'thirty'"),
    _entry("order_date", "normalise_date", "high", "normalization", f"order_date <> {_CAREFUL}"),
    _entry("order_date", "date_format_ambiguous", "low", "normalization", f"order_date LIKE '__/%' AND {_A} <= 12 AND {_B} <= 12"),
]
_VALID_AUDIT = [
    _entry("age", "invalidate_age", "high", "validation", f"{num('age')} < 0 OR {num('age')} > 120", "l4"),
    _entry("order_date", "invalidate_date", "high", "validation", "NOT (order_date LIKE '____-%' AND try_strptime(order_date, '%Y-%m-%d') IS NOT NULL)", "l4"),
]
_REPAIR_AUDIT = [
    _entry(c, "X", t, "repair", f"{c} IS NULL", "l5").replace(
        "'X'", f"(SELECT CASE WHEN abs(skewness({c})) < 0.5 THEN 'impute_mean' ELSE 'impute_median' END FROM l5)"
    )
    for c, t in (("price", "high"), ("age", "high"), ("mostly_null", "low"))
]


@query(
    "audit_layers",
    with_dirty(f'{_NORMAL}{_VALID} SELECT _row_id, col AS "column", action, confidence, layer FROM (' + " UNION ALL ".join(_NORMAL_AUDIT + _VALID_AUDIT + _REPAIR_AUDIT) + ")"),
)
def audit_layers(spark, sf):
    """Every entry of the normalising, validating and repairing layers."""
    chosen = [layer for layer in layers.LAYERS if layer != "quality_scoring"]
    return layers.run_layers(dirty(spark, sf), layers=chosen, strict=True).audit.drop("from", "to")


@query(
    "audit_layers_summary",
    with_dirty(
        f"{_NORMAL}{_VALID}, e AS (" + " UNION ALL ".join(_NORMAL_AUDIT + _VALID_AUDIT + _REPAIR_AUDIT) + ")"
        " SELECT 'layer' AS \"grouping\", layer AS name, count(*) AS changes FROM e GROUP BY layer UNION ALL SELECT 'action', action, count(*) FROM e GROUP BY action"
        " UNION ALL SELECT 'column', col, count(*) FROM e GROUP BY col UNION ALL SELECT 'total', 'all', count(*) FROM e"
    ),
)
def audit_layers_summary(spark, sf):
    chosen = [layer for layer in layers.LAYERS if layer != "quality_scoring"]
    return layers.run_layers(dirty(spark, sf), layers=chosen, strict=True).audit_summary()


@query(
    "layers_quality",
    with_dirty(
        f"{_NORMAL}{_VALID}{_REPAIRED}, cleaned AS (SELECT {_DIRTY_COLS} FROM l6 GROUP BY ALL) "
        + pair_of(score_of("dirty", layer_parts()), score_of("cleaned", layer_parts("cleaned", typed=True)))
    ),
)
def layers_quality(spark, sf):
    """All nine layers; the scores before and after."""
    return layers.run_layers(dirty(spark, sf), strict=True).score


@query(
    "audit_layers_table",
    with_dirty(
        ", kept AS (SELECT DISTINCT order_id - order_id % 4 AS id, order_id % 4 AS part FROM dirty WHERE order_id % 8 <> 0)"
        " SELECT 'order_id' AS \"column\", 'flag_duplicate_ids' AS action, CAST(sum(n) AS BIGINT) AS rows, 'high' AS confidence, 'duplicate_handling' AS layer"
        " FROM (SELECT count(*) AS n FROM kept GROUP BY id HAVING count(*) > 1)"
        " UNION ALL SELECT '__all__', 'drop_empty_rows', count(*) FILTER (order_id % 8 = 0), 'high', 'duplicate_handling' FROM dirty"
    ),
)
def audit_layers_table(spark, sf):
    """Entries about the table: empty rows and repeated IDs; four orders share an ID here."""
    n = F.col("order_id")
    held = n % 8 > 0
    df = dirty(spark, sf).select(
        "_row_id", F.when(held, n - n % 4).alias("order_id"), F.when(held, F.concat(F.lit("part "), (n % 4).cast("string"))).alias("label")
    )
    chosen = [layer for layer in layers.LAYERS if layer != "quality_scoring"]
    entries = layers.run_layers(df, layers=chosen, strict=True).table_audit
    return entries.filter("action IN ('flag_duplicate_ids', 'drop_empty_rows')")
