"""Diffs, anomalies, explanations, audits and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import anomalies, audit, diff, infer, issues, score, steps
from millrace.plans.clean_layers import normalise, validate
from millrace.plans.runner import Step, build, run_steps
from millrace.rows import hold, settled
from millrace.sources.scan import preview

from .base import DIRTY_COLUMNS, dirty, keyed, null_like, num, query, table, with_dirty
from .cleaning import _NORMAL, _VALID
from .quality import layer_parts, pair_of, plain_parts, score_of

_COLS = ", ".join(DIRTY_COLUMNS)
_TEXTS = ("price", "age", "status", "order_date")
# The after side: age and price cast to numbers, cancelled rows gone, one new column.
_AFTER = (
    f", after AS (SELECT row_id, order_id, cust_id, {num('price')} AS price, {num('age')} AS age, status, order_date, mostly_null,"
    " mostly_null * 2 AS twice FROM dirty WHERE cust_id > 300)"
)


def _sides(spark, sf):
    before = dirty(spark, sf)
    after = steps.filter_rows(before, "cust_id", ">", 300)
    for c in ("price", "age"):
        after = steps.change_dtype(after, c, "float")
    after = steps.computed_column(after, "twice", "multiply", "mostly_null", constant_value=2)
    return before, after


_A_COLS = _COLS + ", twice"
_ROWS = (
    "(SELECT count(*) AS rb FROM dirty), (SELECT count(*) AS ra FROM after),"
    f" (SELECT count(*) AS db FROM (SELECT DISTINCT {_COLS} FROM dirty)), (SELECT count(*) AS da FROM (SELECT DISTINCT {_A_COLS} FROM after))"
)


@query(
    "diff_rows",
    with_dirty(
        f"{_AFTER} SELECT rb AS row_count_before, ra AS row_count_after, ra - rb AS row_delta, round((ra - rb) / rb * 100, 2) AS row_delta_pct,"
        f" 7 AS col_count_before, 8 AS col_count_after, rb - db AS duplicate_before, ra - da AS duplicate_after,"
        f" (ra - da) - (rb - db) AS duplicate_delta FROM {_ROWS}"
    ),
)
def diff_rows(spark, sf):
    return diff.diff_rows(*_sides(spark, sf))


@query(
    "diff_nulls",
    with_dirty(
        f"{_AFTER} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", b AS null_before, a AS null_after, a - b AS delta, round((a - b) / rb * 100, 2) AS delta_pct FROM"
            f" (SELECT count(*) FILTER ({c} IS NULL) AS b, count(*) AS rb FROM dirty), (SELECT count(*) FILTER ({c} IS NULL) AS a FROM after)"
            for c in DIRTY_COLUMNS
        )
        + " UNION ALL SELECT 'twice', NULL, count(*) FILTER (twice IS NULL), NULL, NULL FROM after"
    ),
)
def diff_nulls(spark, sf):
    return diff.diff_nulls(*_sides(spark, sf))


@query(
    "diff_columns",
    with_dirty(
        f"{_AFTER}, b AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE SELECT {_COLS} FROM dirty)),"
        f" a AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE SELECT {_A_COLS} FROM after)),"
        " n AS (SELECT * FROM (VALUES ('BIGINT', 'bigint'), ('VARCHAR', 'string'), ('DOUBLE', 'double')) v(t, s))"
        " SELECT coalesce(b.c, a.c) AS \"column\", CASE WHEN b.c IS NULL THEN 'added' WHEN a.c IS NULL THEN 'removed' WHEN a.t = b.t"
        " THEN 'same' ELSE 'type_changed' END AS state, (SELECT s FROM n WHERE n.t = b.t) AS type_before,"
        " (SELECT s FROM n WHERE n.t = a.t) AS type_after FROM b FULL JOIN a ON b.c = a.c"
    ),
)
def diff_columns(spark, sf):
    return diff.diff_columns(*_sides(spark, sf))


_NUMBERS = ("order_id", "cust_id", "mostly_null")


def _drift(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", round(mb, 6) AS mean_before, round(ma, 6) AS mean_after, round((ma - mb) / abs(mb) * 100, 2) AS drift_pct,"
        f" ib AS min_before, ia AS min_after, xb AS max_before, xa AS max_after FROM (SELECT avg({c}) AS mb, CAST(min({c}) AS DOUBLE) AS ib,"
        f" CAST(max({c}) AS DOUBLE) AS xb FROM dirty), (SELECT avg({c}) AS ma, CAST(min({c}) AS DOUBLE) AS ia, CAST(max({c}) AS DOUBLE) AS xa FROM after)"
    )


@query("diff_drift", with_dirty(f"{_AFTER} " + " UNION ALL ".join(map(_drift, _NUMBERS))))
def diff_drift(spark, sf):
    out = diff.diff_drift(*_sides(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


def _shift(c: str, before: str, after: str) -> str:
    one_side = lambda a, b: (
        f"SELECT DISTINCT {c} AS v FROM {a} WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM {b}"
    )
    return (
        f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM ({one_side(after, before)})) AS added_count,"
        f" (SELECT count(*) FROM ({one_side(before, after)})) AS removed_count,"
        f" coalesce((SELECT array_to_string((list(v ORDER BY v))[1:20], '|') FROM ({one_side(after, before)})), '') AS added_values,"
        f" coalesce((SELECT array_to_string((list(v ORDER BY v))[1:20], '|') FROM ({one_side(before, after)})), '') AS removed_values"
    )


@query(
    "category_shift",
    with_dirty(
        ", after AS (SELECT upper(trim(status)) AS status, age, order_date FROM dirty WHERE cust_id > 300) SELECT * FROM ("
        + " UNION ALL ".join(_shift(c, "dirty", "after") for c in ("status", "age", "order_date"))
        + ") WHERE added_count + removed_count > 0"
    ),
)
def category_shift(spark, sf):
    before = dirty(spark, sf).select("status", "age", "order_date", "cust_id")
    after = before.filter("cust_id > 300").withColumn("status", F.upper(F.trim("status")))
    out = diff.diff_categories(before.drop("cust_id"), after.drop("cust_id"))
    return out.withColumns({c: F.array_join(c, "|") for c in ("added_values", "removed_values")})


def _ks(c: str, of: str = "lineitem", kept: str = "l_quantity * l_discount > 0.9") -> str:
    """Statistic of a column before and after a filter; d is not rounded."""
    return (
        f"SELECT '{c}' AS \"column\", any_value(nb) AS n_before, any_value(na) AS n_after, max(abs(cb / nb - ca / na)) AS d FROM ("
        f"SELECT sum(b) OVER (ORDER BY x) AS cb, sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER ()::BIGINT AS nb, sum(a) OVER ()::BIGINT AS na FROM ("
        f"SELECT x, sum(b) AS b, sum(a) AS a FROM (SELECT {c} AS x, 1 AS b, 0 AS a FROM {of} UNION ALL"
        f" SELECT {c}, 0, 1 FROM {of} WHERE {kept}) GROUP BY x))"
    )


_KS_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_KS_SERIES = (
    "least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k:"
    " CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp(-2.0 * k * k * d * d * n_before * n_after / (n_before + n_after))))))"
)
_KS_LIMIT = f"CASE WHEN d * sqrt(n_before * n_after / (n_before + n_after)) < 0.2 THEN 1.0 ELSE {_KS_SERIES} END"


@query(
    "diff_ks",
    f"SELECT \"column\", n_before, n_after, round(d, 4) AS ks_stat, round({_KS_LIMIT}, 4) AS ks_pvalue FROM ("
    + " UNION ALL ".join(map(_ks, _KS_COLUMNS)) + ")",
)
def diff_ks(spark, sf):
    before = table(spark, sf, "lineitem").select(*_KS_COLUMNS)
    after = before.filter("l_quantity * l_discount > 0.9")
    return diff.diff_distribution(before, after)


# Points (i of the smaller sample, j of the larger) of lattice paths, a step at a time.
_KS_PATHS = f"""
WITH RECURSIVE stat AS (
  SELECT *, least(n_before, n_after)::DOUBLE AS s, greatest(n_before, n_after)::DOUBLE AS l, round(d * n_before * n_after) AS h,
    (n_before + n_after) * (least(n_before, n_after) + 1) <= {diff.EXACT_CELLS} AS exact FROM ({{stats}})),
path AS (
  SELECT "column", s, l, h, exact, 0 AS t, list_transform(range(0, CAST(s AS BIGINT) + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS q FROM stat
  UNION ALL
  SELECT "column", s, l, h, exact, t + 1, list_transform(q, lambda v, k: CASE WHEN t + 2 - k BETWEEN 0 AND l AND abs((k - 1) * l - (t + 2 - k) * s) < h - 0.5
    THEN (v * (l - (t + 2 - k) + 1) + coalesce(q[k - 1], 0.0::DOUBLE) * (s - (k - 1) + 1)) / (s + l - t) ELSE 0.0::DOUBLE END)
  FROM path WHERE exact AND t < s + l)
SELECT stat."column", n_before, n_after, round(d, 4) AS ks_stat,
  round(CASE WHEN NOT stat.exact THEN {_KS_LIMIT} WHEN stat.h < 1 THEN 1.0 ELSE greatest(0.0, 1 - q[CAST(stat.s AS BIGINT) + 1]) END, 4) AS ks_pvalue
FROM stat JOIN path ON path."column" = stat."column" AND t = CASE WHEN stat.exact THEN stat.s + stat.l ELSE 0 END
"""


@query(
    "diff_ks_exact",
    _KS_PATHS.replace("{stats}", _ks("s_acctbal", "supplier", "s_nationkey > 11") + " UNION ALL " + _ks("s_nationkey", "supplier", "s_nationkey > 11")),
)
def diff_ks_exact(spark, sf):
    before = table(spark, sf, "supplier").select("s_acctbal", "s_nationkey")
    return diff.diff_distribution(before, before.filter("s_nationkey > 11"))


@query(
    "top_drift_columns",
    with_dirty(
        f"{_AFTER} SELECT \"column\", drift_pct FROM (" + " UNION ALL ".join(map(_drift, _NUMBERS))
        + ") WHERE abs(drift_pct) > 1 ORDER BY abs(drift_pct) DESC LIMIT 8"
    ),
)
def top_drift_columns(spark, sf):
    return diff.largest_drifts(diff.diff_drift(*_sides(spark, sf))).select("column", "drift_pct")


@query(
    "top_null_changes",
    with_dirty(
        f"{_AFTER} SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", (SELECT count(*) FILTER ({c} IS NULL) FROM after) - (SELECT count(*) FILTER ({c} IS NULL) FROM dirty) AS delta"
            for c in DIRTY_COLUMNS
        ) + ") WHERE delta <> 0 ORDER BY abs(delta) DESC, \"column\" LIMIT 10"
    ),
)
def top_null_changes(spark, sf):
    return diff.largest_null_changes(diff.diff_nulls(*_sides(spark, sf))).select("column", "delta")


# --- anomalies ------------------------------------------------------------------------------
# A step that casts, drops two thirds of the rows and moves the mean of prices.
_BROKEN = (
    ", after AS (SELECT row_id, order_id, CASE WHEN order_id % 10 < 9 THEN NULL ELSE status END AS status,"
    " CASE WHEN order_id % 4 = 0 THEN NULL ELSE price END AS price, coalesce(mostly_null, 50000.0) AS mostly_null,"
    f" {num('age')} AS age FROM dirty WHERE cust_id < 900 AND age <> 'thirty')"
)


def _broken(spark, sf):
    before = dirty(spark, sf).select("_row_id", "order_id", "status", "price", "mostly_null", "age")
    k = F.col("order_id")
    kept = dirty(spark, sf).filter("cust_id < 900").filter("age <> 'thirty'")
    after = steps.change_dtype(kept, "age", "float").select(
        "_row_id", "order_id", F.when(k % 10 >= 9, F.col("status")).alias("status"),
        F.when(k % 4 != 0, F.col("price")).alias("price"), F.coalesce("mostly_null", F.lit(50000.0)).alias("mostly_null"), "age",
    )
    return before, after


_BROKEN_COLUMNS = ("order_id", "status", "price", "mostly_null", "age")


def _anomaly_sql() -> str:
    sizes = "(SELECT count(*) AS rb FROM dirty), (SELECT count(*) AS ra FROM after)"
    parts = [
        "SELECT 'large_row_drop' AS type, CASE WHEN p <= -70 THEN 'critical' ELSE 'warning' END AS severity, NULL::VARCHAR AS col,"
        f" p AS value FROM (SELECT round((ra - rb) / rb * 100, 2) AS p FROM {sizes}) WHERE p <= -30",
        "SELECT 'type_change', 'info', 'age', NULL",
    ]
    for c in _BROKEN_COLUMNS:
        pct = f"(SELECT 100.0 * a / ra AS now, 100.0 * (a - b) / rb AS gain, a, b FROM (SELECT count(*) FILTER ({c} IS NULL) AS b, count(*) AS rb FROM dirty), (SELECT count(*) FILTER ({c} IS NULL) AS a, count(*) AS ra FROM after))"
        parts.append(f"SELECT 'column_mostly_null', 'critical', '{c}', now::DOUBLE FROM {pct} WHERE now >= 80 AND a > b")
        parts.append(f"SELECT 'null_increase', 'warning', '{c}', gain::DOUBLE FROM {pct} WHERE NOT (now >= 80 AND a > b) AND gain >= 20")
    for c in ("order_id", "mostly_null"):
        parts.append(
            f"SELECT 'stat_drift', 'warning', '{c}', p FROM (SELECT round((ma - mb) / abs(mb) * 100, 2) AS p FROM (SELECT avg({c}) AS mb FROM dirty),"
            f" (SELECT avg({c}) AS ma FROM after)) WHERE abs(p) >= 50"
        )
        parts.append(
            f"SELECT 'distribution_shift', 'warning', '{c}', d FROM (SELECT round(max(abs(cb / nb - ca / na)), 4) AS d FROM (SELECT sum(b) OVER (ORDER BY x) AS cb,"
            " sum(a) OVER (ORDER BY x) AS ca, sum(b) OVER () AS nb, sum(a) OVER () AS na FROM (SELECT x, sum(b) AS b, sum(a) AS a FROM"
            f" (SELECT {c} AS x, 1 AS b, 0 AS a FROM dirty UNION ALL SELECT {c}, 0, 1 FROM after) WHERE x IS NOT NULL GROUP BY x))) WHERE d >= 0.3"
        )
    for c in ("status", "price"):
        gone = f"(SELECT count(*) AS n FROM (SELECT {c} FROM dirty WHERE {c} IS NOT NULL EXCEPT SELECT {c} FROM after))"
        parts.append(f"SELECT 'category_disappear', 'warning', '{c}', n::DOUBLE FROM {gone} WHERE n >= 3")
    # age is text before and a number after, so every text is compared with nothing numeric
    parts.append(
        "SELECT 'category_disappear', 'warning', 'age', n::DOUBLE FROM (SELECT count(*) AS n FROM (SELECT age FROM dirty WHERE age IS NOT NULL"
        " EXCEPT SELECT CAST(age AS VARCHAR) FROM after)) WHERE n >= 3"
    )
    return " UNION ALL ".join(parts)


@query("anomalies", with_dirty(f'{_BROKEN} SELECT type, severity, col AS "column", round(value, 6) AS value FROM ({_anomaly_sql()})'))
def anomalies_of_step(spark, sf):
    found = anomalies.detect_anomalies(anomalies.compute_diff(*_broken(spark, sf)), "broken step")
    return found.select("type", "severity", "column", F.round("value", 6).alias("value"))


@query(
    "duplicate_anomalies",
    with_dirty(
        f", after AS (SELECT {_COLS} FROM dirty UNION ALL SELECT {_COLS} FROM dirty WHERE upper(trim(status)) = 'O')"
        " SELECT 'duplicate_spike' AS type, round(((ra - da) - (rb - db)) / (rb - db) * 100, 6) AS value FROM"
        " (SELECT count(*) AS rb FROM dirty), (SELECT count(*) AS ra FROM after),"
        f" (SELECT count(*) AS db FROM (SELECT DISTINCT {_COLS} FROM dirty)), (SELECT count(*) AS da FROM (SELECT DISTINCT {_COLS} FROM after))"
        " UNION ALL SELECT 'row_explosion', round((ra - rb) / rb * 100, 2) FROM (SELECT count(*) AS rb FROM dirty), (SELECT count(*) AS ra FROM after)"
    ),
)
def duplicate_anomalies(spark, sf):
    """The open orders copied: more duplicates and more rows."""
    before = dirty(spark, sf)
    after = before.unionByName(before.filter("upper(trim(status)) = 'O'"))
    limits = anomalies.Thresholds(row_increase_pct=20)
    found = anomalies.detect_anomalies(anomalies.compute_diff(before, after, full=False), "copy", limits)
    return found.filter(F.col("column").isNull()).select("type", F.round("value", 6).alias("value"))


_SURE = ", ".join(f"('{k}', '{c}')" for k, c in anomalies.confidence("filter_rows").items())


@query(
    "explanations",
    with_dirty(
        f"{_BROKEN}, found AS (SELECT type, severity, col FROM ({_anomaly_sql()}) x(type, severity, col, value)), rules AS (SELECT * FROM (VALUES {_SURE}) r(k, confidence))"
        " SELECT type AS anomaly_type, severity, col AS \"column\", confidence, CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1"
        " ELSE 2 END AS severity_rank FROM found JOIN rules ON type = k"
    ),
)
def explanations(spark, sf):
    d = anomalies.compute_diff(*_broken(spark, sf))
    found = anomalies.detect_anomalies(d, "broken step")
    return anomalies.explain_anomalies(found, "filter_rows", d).select("anomaly_type", "severity", "column", "confidence", "severity_rank")


# --- audit ---------------------------------------------------------------------------------------
_CLEAN = (
    f", clean AS (SELECT row_id, trim(upper(status)) AS status, {num('age')} AS age, CASE WHEN NOT {null_like('price')} THEN price END AS price,"
    " coalesce(cust_id, -1) AS cust_id FROM dirty WHERE upper(trim(status)) <> 'P')"
)


def _cleaned(spark, sf):
    before = dirty(spark, sf).select("_row_id", "status", "age", "price", "cust_id")
    from millrace.functions import text

    after = steps.change_dtype(dirty(spark, sf).filter("upper(trim(status)) <> 'P'"), "age", "int")
    return before, after.select(
        "_row_id", F.upper(text.trimmed(F.col("status"))).alias("status"), F.col("age").cast("string").alias("age"),
        text.null_tokens_to_null(F.col("price")).alias("price"), F.coalesce("cust_id", F.lit(-1)).alias("cust_id"),
    )


def _cell_audit(c: str) -> str:
    a = "CAST(CAST(a.age AS BIGINT) AS VARCHAR)" if c == "age" else f"CAST(a.{c} AS VARCHAR)"
    b = f"CAST(b.{c} AS VARCHAR)"
    return (
        f"SELECT b.row_id AS _row_id, '{c}' AS col, CASE WHEN {b} IS NULL THEN 'fill_null' WHEN {a} IS NULL THEN 'set_null' ELSE"
        f" 'value_changed' END AS action, {b} AS old, {a} AS new FROM dirty b JOIN clean a ON a.row_id = b.row_id WHERE {b} IS DISTINCT FROM {a}"
    )


_CELLS = " UNION ALL ".join(_cell_audit(c) for c in ("status", "age", "price", "cust_id"))


@query("audit_cells", with_dirty(f'{_CLEAN} SELECT _row_id, col AS "column", action, old AS "from", new AS "to" FROM ({_CELLS})'))
def audit_cells(spark, sf):
    return audit.audit_cells(*_cleaned(spark, sf)).select("_row_id", "column", "action", "from", "to")


@query(
    "audit_rows_changed",
    with_dirty(
        f"{_CLEAN} SELECT '__all__' AS \"column\", 'rows_changed' AS action, CAST((SELECT count(*) FROM dirty) AS VARCHAR) AS \"from\","
        " CAST((SELECT count(*) FROM clean) AS VARCHAR) AS \"to\""
    ),
)
def audit_rows_changed(spark, sf):
    return audit.rows_changed(*_cleaned(spark, sf)).select("column", "action", "from", "to")


@query(
    "audit_summary",
    with_dirty(
        f"{_CLEAN}, e AS ({_CELLS}) SELECT 'layer' AS \"grouping\", 'step_execution' AS name, count(*) AS changes FROM e UNION ALL"
        " SELECT 'action', action, count(*) FROM e GROUP BY action UNION ALL SELECT 'column', col, count(*) FROM e GROUP BY col"
        " UNION ALL SELECT 'total', 'all', count(*) FROM e"
    ),
)
def audit_summary(spark, sf):
    return audit.audit_summary(audit.audit_cells(*_cleaned(spark, sf)))


@query("audit_filter", with_dirty(f"{_CLEAN} SELECT _row_id, old AS \"from\", new AS \"to\" FROM ({_CELLS}) WHERE col = 'price' AND action = 'set_null'"))
def audit_filter(spark, sf):
    entries = audit.audit_cells(*_cleaned(spark, sf))
    return audit.filter_audit(entries, column="price", action="set_null").select("_row_id", "from", "to")


# --- scores ------------------------------------------------------------------------------------------
@query(
    "quality_pair",
    with_dirty(f"{_NORMAL}{_VALID} " + pair_of(score_of("dirty", layer_parts()), score_of("l5", layer_parts("l5", typed=True)))),
)
def quality_pair(spark, sf):
    """Before and after normalising and validating; the issue counts come from the data."""
    before = dirty(spark, sf)
    found = issues.gather(before)
    schema = infer.semantic_schema(found.held)
    after = hold(validate(normalise(before, schema), schema))
    tables = [issues.issue_table(spark, issues.layer_issues(d, found=f)) for d, f in ((before, found), (after, None))]
    out = settled(score.quality_pair(before, after, *tables))
    after.unpersist()
    return out


# --- runs ----------------------------------------------------------------------------------------------
def _plan(customers):
    return [
        Step("filter_rows", {"column": "o_orderstatus", "operator": "==", "value": "F"}, "finished only"),
        Step("join", {"right_dataset": customers, "on": "o_custkey", "how": "inner"}, "add customers"),
        Step("add_computed_column", {"new_column": "gap", "operation": "subtract", "col_a": "o_totalprice", "col_b": "c_acctbal"}, "gap"),
        Step("sort_values", {"columns": ["gap"], "ascending": False}, "largest gap first"),
    ]


def _scenario(spark, sf):
    orders = keyed(spark, sf, "orders", "o_orderkey").select("_row_id", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return orders, customers


_JOINED = (
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, c_name, c_acctbal, round(o_totalprice - c_acctbal, 4) AS gap"
    " FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'"
)


@query("scenario_result", _JOINED)
def scenario_result(spark, sf):
    orders, customers = _scenario(spark, sf)
    return build(orders, _plan(customers)).drop("_row_id").withColumn("gap", F.round("gap", 4))


_STEP_COUNTS = (
    "(SELECT 0 AS step_index, count(*) AS row_count FROM orders UNION ALL SELECT 1, count(*) FROM orders WHERE o_orderstatus = 'F'"
    f" UNION ALL SELECT 2, count(*) FROM ({_JOINED}) UNION ALL SELECT 3, count(*) FROM ({_JOINED}) UNION ALL SELECT 4, count(*) FROM ({_JOINED}))"
)
_TREND = (
    "SELECT step_index, row_count, row_count - lag(row_count) OVER (ORDER BY step_index) AS row_delta,"
    " round((row_count - lag(row_count) OVER (ORDER BY step_index)) / lag(row_count) OVER (ORDER BY step_index) * 100, 2) AS row_delta_pct"
    f" FROM {_STEP_COUNTS}"
)


@query("step_trend", f"SELECT CAST(step_index AS BIGINT) AS step_index, row_count, row_delta, row_delta_pct FROM ({_TREND})")
def step_trend_query(spark, sf):
    orders, customers = _scenario(spark, sf)
    run = run_steps(orders, _plan(customers), report="counts")
    return run.row_trend().select("step_index", "row_count", "row_delta", "row_delta_pct")


@query("scenario_anomalies", (
    "SELECT CAST(step_index AS BIGINT) AS step_index, 'large_row_drop' AS type, CASE WHEN row_delta_pct <= -70 THEN 'critical' ELSE 'warning' END AS severity,"
    f" row_delta_pct AS value FROM ({_TREND}) WHERE row_delta_pct <= -30"
))
def scenario_anomalies(spark, sf):
    """The flagship run: every step compared with the one before."""
    orders, customers = _scenario(spark, sf)
    run = run_steps(orders, _plan(customers), report="counts")
    if run.status != "success":
        raise RuntimeError(run.error)
    return run.anomalies().filter(F.col("column").isNull()).select("step_index", "type", "severity", "value")


@query("badge_counts", (
    "SELECT CAST(step_index AS BIGINT) AS step_index, count(*) FILTER (p <= -70) AS critical, count(*) FILTER (p > -70) AS warning,"
    f" 0 AS info, count(*) AS total FROM (SELECT step_index, row_delta_pct AS p FROM ({_TREND}) WHERE row_delta_pct <= -30) GROUP BY step_index"
))
def badge_counts(spark, sf):
    orders, customers = _scenario(spark, sf)
    run = run_steps(orders, _plan(customers), report="counts")
    return anomalies.badge_counts(run.anomalies())


_RUN_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
_RUN_VERSIONS = {
    "r0": _RUN_COLUMNS, "r1": _RUN_COLUMNS, "r2": (*_RUN_COLUMNS, "c_name", "c_acctbal"),
    "r3": (*_RUN_COLUMNS, "c_name", "c_acctbal", "gap"), "r4": (*_RUN_COLUMNS, "c_name", "c_acctbal", "gap"),
}


def _run_score(k: int) -> str:
    before, after = (
        score_of(t, plain_parts(t, _RUN_VERSIONS[t], tuple(c for c in _RUN_VERSIONS[t] if c in ("o_orderstatus", "c_name"))), _RUN_VERSIONS[t])
        for t in (f"r{k - 1}", f"r{k}")
    )
    fixed = f"SELECT greatest(0, b.issues - a.issues) AS issues_fixed FROM ({before}) b, ({after}) a"
    return f"SELECT {k} AS step_index, CAST(issues_fixed AS INTEGER) AS issues_fixed, p.* FROM ({pair_of(before, after)}) p, ({fixed})"


@query(
    "run_report",
    f"WITH r0 AS (SELECT {', '.join(_RUN_COLUMNS)} FROM orders), r1 AS (SELECT * FROM r0 WHERE o_orderstatus = 'F'),"
    " r2 AS (SELECT r1.*, c_name, c_acctbal FROM r1 JOIN customer ON c_custkey = o_custkey),"
    " r3 AS (SELECT *, o_totalprice - c_acctbal AS gap FROM r2), r4 AS (SELECT * FROM r3) "
    + " UNION ALL ".join(map(_run_score, (1, 2, 3, 4))),
)
def run_report(spark, sf):
    """A run with all reports: issues fixed and score per step."""
    orders, customers = _scenario(spark, sf)
    run = run_steps(orders, _plan(customers), report="full")
    if run.status != "success":
        raise RuntimeError(run.error)
    out = None
    for r in run.reports[1:]:
        one = r.score.select(F.lit(r.step_index).alias("step_index"), F.lit(r.issues_fixed).alias("issues_fixed"), "*")
        out = one if out is None else out.unionByName(one)
    return out




# --- rows after a join 1:N -------------------------------------------------------------------------------
def _lines(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("_row_id"), F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey"
    )
    return keyed(spark, sf, "orders", "o_orderkey").select("_row_id", "o_orderkey", "o_custkey"), lines


@query("audit_after_join", "SELECT 0 AS entries")
def audit_after_join(spark, sf):
    """Orders joined with their lines, then sorted: a sort changes no cell."""
    orders, lines = _lines(spark, sf)
    plan = [
        Step("join", {"right_dataset": lines, "on": "o_orderkey", "how": "inner"}),
        Step("sort_values", {"columns": ["l_suppkey"], "ascending": True}),
    ]
    run = run_steps(orders, plan, report="full")
    if run.status != "success":
        raise RuntimeError(run.error)
    return run.reports[-1].audit.agg(F.count(F.lit(1)).cast("int").alias("entries"))


@query(
    "join_then_first",
    "SELECT o_orderkey, o_custkey, l_linenumber, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
    " QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) = 1",
)
def join_then_first(spark, sf):
    """The first line of every order, in the order of the right table."""
    orders, lines = _lines(spark, sf)
    plan = [
        Step("join", {"right_dataset": lines, "on": "o_orderkey", "how": "inner"}),
        Step("remove_duplicates", {"columns": ["o_orderkey"], "keep": "first"}),
    ]
    return build(orders, plan).drop("_row_id")


@query(
    "preview_after_sort",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
def preview_after_sort(spark, sf):
    orders = keyed(spark, sf, "orders", "o_orderkey").select("_row_id", "o_orderkey", "o_totalprice")
    done = build(orders, [Step("sort_values", {"columns": ["o_totalprice"], "ascending": False})])
    return preview(done).drop("_row_id")


@query(
    "anomalies_gaps_and_copies",
    "WITH after AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS c FROM orders UNION ALL"
    " SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END FROM orders WHERE o_orderkey % 50 = 0)"
    " SELECT 'null_increase' AS type, 'warning' AS severity, 'o_custkey' AS \"column\","
    " round(count(*) FILTER (c IS NULL) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS value FROM after"
    " UNION ALL SELECT 'duplicates_appeared', 'info', NULL, CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderkey % 50 = 0",
)
def anomalies_gaps_and_copies(spark, sf):
    """A third of a column goes missing, and copies appear where there were none."""
    before = keyed(spark, sf, "orders", "o_orderkey").select("_row_id", "o_orderkey", "o_custkey")
    after = before.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")))
    after = after.unionByName(after.filter("o_orderkey % 50 = 0"))
    found = anomalies.detect_anomalies(anomalies.compute_diff(before, after), "gaps")
    return found.select("type", "severity", "column", F.round("value", 6).alias("value"))


@query(
    "export_order",
    "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey FROM orders",
)
def export_order(spark, sf):
    """The row order after a sort and a dropped sort column, as an ordered export uses it."""
    orders = keyed(spark, sf, "orders", "o_orderkey").select("_row_id", "o_orderkey", "o_totalprice")
    plan = [Step("sort_values", {"columns": ["o_totalprice"], "ascending": False}), Step("select_columns", {"columns": ["o_orderkey"]})]
    return build(orders, plan).select(F.col("_row_id").alias("place"), "o_orderkey")
