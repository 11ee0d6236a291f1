"""Quality issues, advice and scores on the dirty table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import issues, score
from millrace.plans.clean_auto import auto_clean

from .base import DIRTY_COLUMNS, bare, day, dirty, fnum, null_like, null_like_wide, num, query, table, with_dirty, word

_TEXTS = ("price", "age", "status", "order_date")
_COLS = ", ".join(DIRTY_COLUMNS)
_N = "(SELECT count(*) FROM dirty)"
_DUPES = f"({_N} - (SELECT count(*) FROM (SELECT DISTINCT {_COLS} FROM dirty)))"


def issue(column: str | None, kind: str, severity: str, count: str, where: str = "TRUE") -> str:
    """One candidate row: severity and count are SQL expressions, ``n`` the count."""
    name = "NULL::VARCHAR" if column is None else f"'{column}'"
    return f"SELECT {name} AS col, '{kind}' AS issue_type, {severity} AS severity, n FROM (SELECT {count} AS n FROM dirty) WHERE n > 0 AND {where}"


def graded(critical: float, warning: float, op: str = ">=") -> str:
    pct = f"100.0 * n / {_N}"
    return f"CASE WHEN {pct} {op} {critical} THEN 'critical' WHEN {pct} > {warning} THEN 'warning' ELSE 'info' END"


def hits(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def repeated(column: str, members: bool = False) -> str:
    part = "n" if members else "n - 1"
    return (
        f"(SELECT CAST(sum({part}) AS BIGINT) FROM (SELECT count(*) AS n FROM dirty WHERE {column} IS NOT NULL"
        f" GROUP BY {column} HAVING count(*) > 1))"
    )


def union(parts: list[str]) -> str:
    return with_dirty('SELECT col AS "column", issue_type, severity, CAST(n AS BIGINT) AS "count" FROM (' + " UNION ALL ".join(parts) + ")")


_FORMATS = "CASE WHEN order_date LIKE '____-%' THEN 1 WHEN order_date LIKE '____/%' THEN 2 ELSE 3 END"
_MINOR_FORMATS = (
    f"(SELECT CAST(sum(k) - max(k) AS BIGINT) FROM (SELECT count(*) AS k FROM dirty WHERE {day('order_date')} IS NOT NULL GROUP BY {_FORMATS}))"
)
_VARIANTS = (
    "(SELECT CAST(sum(k) AS BIGINT) FROM (SELECT count(DISTINCT trim(status)) AS k FROM dirty GROUP BY lower(trim(status)) HAVING count(DISTINCT trim(status)) > 1))"
)
_BAD_DATES = hits(f"order_date IS NOT NULL AND {day('order_date')} IS NULL")


def _report_parts() -> list[str]:
    parts = [
        issue(None, "duplicate_rows", f"CASE WHEN 100.0 * n / {_N} > 10 THEN 'critical' ELSE 'warning' END", f"any_value({_DUPES})"),
        issue("order_id", "duplicate_ids", "'critical'", f"any_value({repeated('order_id')})"),
        issue("cust_id", "duplicate_ids", "'critical'", f"any_value({repeated('cust_id')})"),
    ]
    for c in DIRTY_COLUMNS:
        parts.append(issue(c, "missing_values", graded(40, 10), hits(f"{c} IS NULL")))
    for c in _TEXTS:
        parts.append(issue(c, "null_like_strings", "'warning'", hits(null_like_wide(c))))
        parts.append(issue(c, "whitespace", "'info'", hits(f"{c} <> trim({c})")))
    for c in ("price", "age"):
        parts.append(issue(c, "word_numbers", "'warning'", hits(f"{word(c)} IS NOT NULL")))
        parts.append(issue(c, "currency_symbols", "'warning'", hits(f"regexp_matches({c}, '[£$€¥₹]')")))
        parts.append(issue(c, "mixed_types", "'warning'", hits(f"{c} IS NOT NULL AND {fnum(c)} IS NULL AND {word(c)} IS NULL")))
    parts.append(issue("age", "negative_values", "'critical'", hits(f"{fnum('age')} < 0")))
    parts.append(issue("age", "impossible_range_high", "'critical'", hits(f"{fnum('age')} > 120")))
    for c in ("order_id", "cust_id", "mostly_null"):
        parts.append(issue(c, "outliers", "'warning'", f"(SELECT count(*) FROM dirty, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM dirty) WHERE abs({c} - m) / s > 3)").replace("SELECT (SELECT", "SELECT any_value((SELECT").replace(" > 3) AS n", " > 3)) AS n"))
    parts.append(issue("order_date", "mixed_date_formats", "'warning'", f"any_value({_MINOR_FORMATS})"))
    parts.append(issue("order_date", "invalid_dates", "'critical'", _BAD_DATES))
    parts.append(issue("status", "case_inconsistency", "'warning'", f"any_value({_VARIANTS})"))
    return parts


def _columns(df):
    return df.select("column", "issue_type", "severity", "count")


@query("issues_report", union(_report_parts()))
def issues_report(spark, sf):
    return _columns(issues.issue_table(spark, issues.report_issues(dirty(spark, sf))))


@query(
    "issues_report_summary",
    with_dirty(
        f"SELECT {_N} AS total_rows, 7 AS total_columns, count(*) AS total_issues, count(*) FILTER (severity = 'critical') AS critical,"
        " count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,"
        f" count(DISTINCT col) AS columns_with_issues, {_DUPES} AS duplicate_rows FROM (" + " UNION ALL ".join(_report_parts()) + ")"
    ),
)
def issues_report_summary(spark, sf):
    df = dirty(spark, sf)
    found = issues.gather(df)
    return issues.report_summary(spark, found, issues.report_issues(df, found=found))


def layer_parts(t: str = "dirty", typed: bool = False) -> list[str]:
    """Issues of the layered cleaner over a table ``t``; ``typed`` if price and age are numbers there."""
    texts, age = (("status", "order_date"), "age") if typed else (_TEXTS, num("age"))
    return [p.replace("FROM dirty", f"FROM {t}") for p in _layer_parts(texts, age)]


def plain_parts(t: str, columns: tuple[str, ...], texts: tuple[str, ...]) -> list[str]:
    """The issues that any table can have: copies, gaps, and in texts white space, currency and case."""
    rows = f"(SELECT count(*) FROM {t})"
    parts = [issue("__all__", "duplicate_rows", "'warning'", f"any_value({rows} - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {t})))")]
    parts += [issue(c, "missing_values", f"CASE WHEN round(100.0 * n / {rows}, 2) > 30 THEN 'critical' ELSE 'warning' END", hits(f"{c} IS NULL")) for c in columns]
    for c in texts:
        parts.append(issue(c, "whitespace", "'info'", hits(f"{c} <> trim({c})")))
        parts.append(issue(c, "currency_string", "'warning'", hits(f"regexp_matches({c}, '[£$€¥₹]')")))
        parts.append(issue(c, "mixed_case", "'info'", f"count(DISTINCT {c}) - count(DISTINCT lower({c}))"))
    return [p.replace("FROM dirty", f"FROM {t}") for p in parts]


def score_of(t: str, parts: list[str], columns: tuple[str, ...] = DIRTY_COLUMNS) -> str:
    """Score, rows and number of issues of a table, one row."""
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)
    points = "CASE severity WHEN 'critical' THEN 5.0 WHEN 'warning' THEN 2.0 ELSE 0.5 END"
    return (
        "SELECT round(greatest(0, least(100, 100 - least(30, pct * 0.6) - points)), 1)::DOUBLE AS score, n, issues FROM"
        f" (SELECT count(*) AS n, 100.0 * ({nulls}) / (count(*) * {len(columns)}) AS pct FROM {t}),"
        f" (SELECT coalesce(sum({points}), 0) AS points, count(*) AS issues FROM ({' UNION ALL '.join(parts)}))"
    )


def pair_of(before: str, after: str) -> str:
    """Scores of both versions and the improvement, from two texts of ``score_of``."""
    confidence = "CASE WHEN b.n >= 50 THEN 'high' WHEN b.n >= 10 THEN 'medium' ELSE 'low' END"
    return (
        f"SELECT b.score AS before_cleaning, a.score AS after_cleaning, round(a.score - b.score, 1) AS improvement, {confidence} AS confidence"
        f" FROM ({before}) b, ({after}) a"
    )


def _layer_parts(texts=_TEXTS, age=num("age")) -> list[str]:
    int_like = "regexp_full_match(trim({c}), '[+-]?\\d{1,18}')"
    parts = [
        issue("__all__", "duplicate_rows", "'warning'", f"any_value({_DUPES})"),
        issue("order_id", "duplicate_ids", "'critical'", f"any_value({repeated('order_id', True)})"),
        issue("cust_id", "duplicate_ids", "'critical'", f"any_value({repeated('cust_id', True)}) + {hits('cust_id IS NULL')}"),
    ]
    for c in DIRTY_COLUMNS:
        parts.append(issue(c, "missing_values", f"CASE WHEN round(100.0 * n / {_N}, 2) > 30 THEN 'critical' ELSE 'warning' END", hits(f"{c} IS NULL")))
    for c in texts:
        ints = hits(int_like.replace("{c}", c))
        floats = hits(f"{num(c)} IS NOT NULL AND NOT {int_like.replace('{c}', c)}")
        rest = hits(f"{c} IS NOT NULL AND {num(c)} IS NULL")
        parts.append(issue(c, "mixed_types", "'warning'", f"{ints} + {floats} + {rest} - greatest({ints}, {floats}, {rest})"))
        parts.append(issue(c, "whitespace", "'info'", hits(f"{c} <> trim({c})")))
        parts.append(issue(c, "word_numbers", "'warning'", hits(f"{word(c)} IS NOT NULL")))
        parts.append(issue(c, "currency_string", "'warning'", hits(f"regexp_matches({c}, '[£$€¥₹]')")))
    parts.append(issue("status", "mixed_case", "'info'", "count(DISTINCT status) - count(DISTINCT lower(status))"))
    parts.append(issue("age", "negative_age", "'critical'", hits(f"{age} < 0")))
    parts.append(issue("age", "impossible_age", "'critical'", hits(f"{age} > 120")))
    parts.append(issue("order_date", "invalid_date", "'critical'", _BAD_DATES))
    kinds = " + ".join(
        f"CAST(count(try_strptime(order_date, '{f}')) > 0 AS INT)" for f in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y")
    )
    parts.append(issue("order_date", "mixed_date_formats", "'warning'", kinds, "n > 1"))
    return parts


@query("issues_layer3", union(_layer_parts()))
def issues_layer3(spark, sf):
    return _columns(issues.issue_table(spark, issues.layer_issues(dirty(spark, sf))))


_CONVERTED = {"price": fnum("price"), "age": fnum("age"), "order_date": day("order_date")}


@query(
    "issues_auto",
    union(
        [
            issue(c, "missing_values", graded(40, 10, ">"), hits(f"{_CONVERTED.get(c, c)} IS NULL"))
            for c in DIRTY_COLUMNS
        ]
        + [issue(c, "negative_values", "'warning'", hits(f"{fnum(c)} < 0")) for c in ("price", "age")]
    ),
)
def issues_auto(spark, sf):
    return _columns(issues.issue_table(spark, auto_clean(dirty(spark, sf)).issues))


_NULLS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in DIRTY_COLUMNS)


def _smart_parts() -> list[str]:
    parts = [
        issue(None, "duplicate_rows", f"CASE WHEN 1.0 * n / {_N} > 0.1 THEN 'critical' ELSE 'warning' END", f"any_value({_DUPES})"),
        issue(None, "mostly_empty_rows", "'critical'", hits(f"({_NULLS}) / 7.0 > 0.5")),
        issue("order_date", "mixed_date_formats", "'warning'", hits("order_date IS NOT NULL AND NOT regexp_full_match(order_date, '\\d{4}-\\d{2}-\\d{2}')")),
    ]
    for c in DIRTY_COLUMNS:
        parts.append(issue(c, "missing_values", graded(50, 10), hits(f"{c} IS NULL")))
    for c in _TEXTS:
        parts.append(issue(c, "null_like_strings", f"CASE WHEN 1.0 * n / {_N} >= 0.3 THEN 'critical' ELSE 'warning' END", hits(null_like(c))))
        parts.append(issue(c, "currency_symbols", "'warning'", hits(f"regexp_matches({c}, '[£$€¥₹]')")))
        parts.append(issue(c, "word_numbers", "'warning'", hits(f"{word(c)} IS NOT NULL")))
    return parts


@query("issues_smart", union(_smart_parts()))
def issues_smart(spark, sf):
    return _columns(issues.issue_table(spark, issues.smart_issues(dirty(spark, sf))))


@query(
    "issue_severity_counts",
    with_dirty(
        "SELECT 'report' AS family, severity, count(*) AS issues, count(DISTINCT col) AS columns FROM ("
        + " UNION ALL ".join(_report_parts()) + ") GROUP BY severity"
    ),
)
def issue_severity_counts(spark, sf):
    return issues.severity_counts(issues.issue_table(spark, issues.report_issues(dirty(spark, sf))))


def _examples(c: str, kind: str, condition: str) -> str:
    return (
        f"SELECT '{c}' AS col, '{kind}' AS issue_type, array_to_string((list(DISTINCT {c} ORDER BY {c}))[1:5], '|') AS examples"
        f" FROM dirty WHERE {condition} HAVING count(*) > 0"
    )


@query(
    "issue_examples",
    with_dirty(
        'SELECT col AS "column", issue_type, examples FROM (' + " UNION ALL ".join(
            p for c in _TEXTS for p in (
                _examples(c, "null_like_strings", null_like_wide(c)), _examples(c, "word_numbers", f"{word(c)} IS NOT NULL"),
                _examples(c, "currency_symbols", f"regexp_matches({c}, '[£$€¥₹]')"), _examples(c, "whitespace", f"{c} <> trim({c})"),
                _examples(c, "mixed_types", f"{c} IS NOT NULL AND {num(bare(c))} IS NULL AND {word(c)} IS NULL"),
                _examples(c, "invalid_dates", f"{c} IS NOT NULL AND {day(c)} IS NULL"),
            )
        ) + ")"
    ),
)
def issue_examples(spark, sf):
    return issues.issue_examples(dirty(spark, sf)).withColumn("examples", F.array_join("examples", "|"))


_STEP = (
    "CASE WHEN issue_type IN ('null_like_strings', 'word_numbers', 'mixed_types') AND col IN ('price', 'age') THEN 'change_dtype'"
    " WHEN issue_type IN ('negative_values', 'impossible_range_high') THEN 'filter_rows' WHEN issue_type = 'currency_symbols'"
    " THEN 'auto_clean' WHEN issue_type IN ('mixed_date_formats', 'invalid_dates') THEN 'change_dtype' WHEN issue_type ="
    f" 'duplicate_rows' THEN 'remove_duplicates' WHEN issue_type = 'missing_values' THEN CASE WHEN 1.0 * n / {_N} > 0.3"
    " THEN 'drop_missing' ELSE 'fill_missing' END END"
)
_CONFIG = (
    "CASE step_type WHEN 'auto_clean' THEN '{}' WHEN 'remove_duplicates' THEN '{\"keep\": \"first\"}'"
    " WHEN 'drop_missing' THEN '{\"columns\": [\"' || col || '\"], \"how\": \"any\"}'"
    " WHEN 'fill_missing' THEN '{\"column\": \"' || col || '\", \"method\": \"' || CASE WHEN col = 'order_date' OR col = 'status' OR col LIKE '%_id'"
    " THEN 'mode' ELSE 'median' END || '\"}'"
    " WHEN 'change_dtype' THEN '{\"column\": \"' || col || '\", \"dtype\": \"' || CASE WHEN col = 'order_date' THEN 'datetime' ELSE 'float' END || '\"}'"
    " ELSE '{\"column\": \"' || col || '\", \"operator\": \"' || CASE issue_type WHEN 'negative_values' THEN '>=\", \"value\": 0}' ELSE '<=\", \"value\": 120}' END END"
)


@query(
    "suggest_steps",
    with_dirty(
        f'SELECT col AS "column", issue_type, severity, CAST(n AS BIGINT) AS "count", step_type, {_CONFIG} AS config FROM'
        f" (SELECT *, {_STEP} AS step_type FROM (" + " UNION ALL ".join(_report_parts()) + ")) WHERE step_type IS NOT NULL"
    ),
)
def suggest_steps(spark, sf):
    return issues.recommend_steps(dirty(spark, sf)).drop("reasoning")


_CELL_NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in DIRTY_COLUMNS)


@query(
    "quality_score",
    with_dirty(
        "SELECT 'before' AS label, round(greatest(0, least(100, 100 - np - ip)), 1) AS score, CASE WHEN rows >= 50 THEN 'high'"
        " WHEN rows >= 10 THEN 'medium' ELSE 'low' END AS confidence, round(np, 2) AS null_penalty, ip AS issue_penalty, k AS issues FROM"
        f" (SELECT count(*) AS rows, least(30.0::DOUBLE, ({_CELL_NULLS}) / (count(*) * 7) * 100 * 0.6) AS np FROM dirty),"
        " (SELECT sum(CASE severity WHEN 'critical' THEN 5 WHEN 'warning' THEN 2 ELSE 0.5::DOUBLE END) AS ip, count(*) AS k FROM ("
        + " UNION ALL ".join(_report_parts()) + "))"
    ),
)
def quality_score(spark, sf):
    df = dirty(spark, sf)
    return score.quality_score(df, issues.issue_table(spark, issues.report_issues(df)))


# --- a second table with faults that the first one lacks ------------------------------------------
_ROUGH = (
    "rough AS (SELECT c_custkey AS k, c_custkey % 29 = 0 AS bare FROM customer)"
)


def rough(spark, sf):
    """Numeric ages and scores out of bounds, spikes, spellings, bad addresses, empty rows."""
    k = F.col("c_custkey")
    value = {
        "age": F.when(k % 11 == 0, 150).when(k % 13 == 0, -1).otherwise((20 + k % 60).cast("int")),
        "score": (k % 101 + F.when(k % 17 == 0, 101).otherwise(0)).cast("int"),
        "reading": F.when(k % 50 == 0, 1e6).otherwise((k % 10).cast("double")),
        "label": F.when(k % 4 == 0, "Red").when(k % 4 == 1, "red").when(k % 4 == 2, "blue").otherwise("Green"),
        "email": F.when(k % 7 == 0, "nobody").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com"))),
    }
    held = {n: F.when(k % 29 != 0, v).alias(n) for n, v in value.items()}
    return table(spark, sf, "customer").select(k.alias("_row_id"), k.alias("cust_id"), *held.values())


@query(
    "issues_rough",
    f"WITH {_ROUGH} SELECT * FROM ("
    " SELECT 'smart' AS family, 'age' AS \"column\", 'impossible_values' AS issue_type, count(*) FILTER (NOT bare AND (k % 11 = 0 OR k % 13 = 0)) AS \"count\" FROM rough"
    " UNION ALL SELECT 'smart', 'score', 'impossible_values', count(*) FILTER (NOT bare AND k % 17 = 0) FROM rough"
    " UNION ALL SELECT 'smart', NULL, 'mostly_empty_rows', count(*) FILTER (bare) FROM rough"
    " UNION ALL SELECT 'report', 'reading', 'outliers', count(*) FILTER (NOT bare AND k % 50 = 0) FROM rough"
    " UNION ALL SELECT 'report', 'label', 'case_inconsistency', 2"
    " UNION ALL SELECT 'layers', 'label', 'mixed_case', 1"
    " UNION ALL SELECT 'layers', '__all__', 'empty_rows', count(*) FILTER (bare) FROM rough"
    " UNION ALL SELECT 'auto', 'email', 'invalid_email', count(*) FILTER (NOT bare AND k % 7 = 0) FROM rough)",
)
def issues_rough(spark, sf):
    df = rough(spark, sf)
    found = issues.gather(df)
    every = issues.smart_issues(df, found=found) + issues.report_issues(df, found=found) + issues.layer_issues(df, found) + auto_clean(df).issues
    wanted = {
        ("age", "impossible_values"), ("score", "impossible_values"), (None, "mostly_empty_rows"), ("reading", "outliers"),
        ("label", "case_inconsistency"), ("label", "mixed_case"), ("__all__", "empty_rows"), ("email", "invalid_email"),
    }
    chosen = [i for i in every if (i.column, i.issue_type) in wanted]
    return issues.issue_table(spark, chosen).select("family", "column", "issue_type", F.col("count").cast("bigint").alias("count"))
