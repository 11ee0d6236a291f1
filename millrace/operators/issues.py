"""Quality issues: four families of detectors over column facts.

The counting happens in Spark over the whole table; the rules below only read the
resulting record of each column. Every family returns the same issue table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, fixed, numbers, text
from ..rows import as_double, data_columns, local_table, quoted, together
from . import facts as facts_
from . import infer, stats
from .cells import split
from .steps import duplicate_ids, empty_row, meaningful_columns, null_share

ISSUE_SCHEMA = (
    "family string, column string, issue_type string, severity string, count bigint, detail string,"
    " recommended_action string, confidence string, layer string"
)
WHOLE_TABLE = "__all__"


@dataclass(frozen=True)
class Issue:
    family: str
    column: str | None
    issue_type: str
    severity: str
    count: int
    detail: str
    recommended_action: str
    confidence: str = "high"
    layer: str = "issue_detection"

    def row(self) -> tuple:
        return (
            self.family, self.column, self.issue_type, self.severity, int(self.count), self.detail,
            self.recommended_action, self.confidence, self.layer,
        )


def issue_table(spark: SparkSession, issues: list[Issue]) -> DataFrame:
    return local_table(spark, [i.row() for i in issues], ISSUE_SCHEMA)


@dataclass
class Evidence:
    """What the rules look at: one record per column plus a few table counts."""

    rows: int
    held: dict[str, dict]
    unique: dict[str, int] = field(default_factory=dict)
    folded: dict[str, int] = field(default_factory=dict)
    duplicate_rows: int = 0
    null_cells: int = 0
    exact: bool = True  # whether distinct values were counted one by one


def gather(
    df: DataFrame, unique: bool = True, duplicates: bool = True, exact: bool = True, known: Evidence | None = None, kept: tuple[str, ...] = ()
) -> Evidence:
    """Facts, distinct values and copies, counted by jobs that run side by side.

    ``known`` is the evidence of a table with as many rows and the same cells in the columns
    ``kept``: these are not counted again."""
    df = split(df)
    columns = data_columns(df)
    fresh = [c for c in columns if not known or c not in kept]
    held, counts, copies = together(
        lambda: facts_.collect_facts(facts_.column_facts(df, fresh, facts_.ALL)) if fresh or not columns else {},
        lambda: stats.distinct_counts(df, fresh, exact).collect() if unique and (fresh or not columns) else [],
        lambda: facts_.duplicate_count(df, columns).first()["duplicate_rows"] if duplicates else 0,
    )
    if known:
        held = {c: {**(held[c] if c in fresh else known.held[c]), "position": i} for i, c in enumerate(columns)}
        counts = counts + [{"column": c, "unique_count": known.unique[c], "unique_folded": known.folded[c]} for c in kept if c in known.unique]
    return Evidence(
        rows=max((f["row_count"] for f in held.values()), default=0),
        held=held,
        unique={r["column"]: r["unique_count"] for r in counts},
        folded={r["column"]: r["unique_folded"] for r in counts},
        duplicate_rows=copies,
        null_cells=sum(f["null_count"] for f in held.values()),
        exact=exact,
    )


def _held(f: dict) -> int:
    return f["row_count"] - f["null_count"]


def _graded(pct: float, critical: float, warning: float, inclusive: bool = True) -> str:
    if pct >= critical if inclusive else pct > critical:
        return "critical"
    return "warning" if pct > warning else "info"


# --- counts that need a second look at the data --------------------------------------------
def outlier_counts(df: DataFrame, held: dict[str, dict], limit: float = 3.0) -> dict[str, int]:
    """Numbers more than ``limit`` standard deviations from the mean, per column."""
    names = [
        c for c, f in held.items() if f["kind"] == "number" and f["num_count"] >= 10 and f["num_std"]
    ]
    if not names:
        return {}
    row = df.agg(
        *[
            F.count_if(
                F.coalesce(
                    numbers.z_score(as_double(df, c), F.lit(held[c]["num_mean"]), F.lit(held[c]["num_std"])) > limit,
                    F.lit(False),
                )
            ).alias(f"z{i}")
            for i, c in enumerate(names)
        ]
    ).first()
    return {c: row[f"z{i}"] for i, c in enumerate(names)}


def case_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spellings per column that differ only in case from another spelling."""
    long = stats.cells(df, columns, value=lambda c: text.trimmed(quoted(c).cast("string")))
    spellings = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    forms = spellings.groupBy("column", F.lower("value").alias("low")).agg(F.count("*").alias("k"))
    return forms.filter(F.col("k") > 1).groupBy("column").agg(F.sum("k").cast("bigint").alias("variants"))


# --- family "report" --------------------------------------------------------------------------
def report_issues(df: DataFrame, match: str = "token", found: Evidence | None = None) -> list[Issue]:
    """Full quality report: table checks first, then every column."""
    found = found or gather(df)
    columns = data_columns(df)
    types = {c: infer.report_type(c, found.held[c], found.unique.get(c, 0), match) for c in columns}
    out: list[Issue] = []

    def add(column, kind, severity, count, detail, action):
        if count:
            out.append(Issue("report", column, kind, severity, count, detail, action))

    share = 100 * found.duplicate_rows / found.rows if found.rows else 0
    add(None, "duplicate_rows", "critical" if share > 10 else "warning", found.duplicate_rows,
        f"{found.duplicate_rows} copies of other rows ({share:.1f}%)", "remove duplicates, keep the first")
    id_columns = [c for c in columns if infer.name_has(c, fixed.ID_WORDS, match)]
    categorical = [c for c in columns if types[c] == "categorical"]
    repeated, outliers, variants = together(
        lambda: {r["column"]: r["beyond_first"] for r in duplicate_ids(df, id_columns).collect()} if id_columns else {},
        lambda: outlier_counts(df, found.held),
        lambda: {r["column"]: r["variants"] for r in case_variants(df, categorical).collect()} if categorical else {},
    )
    for c in id_columns:
        n = repeated.get(c, 0)
        add(c, "duplicate_ids", "critical", n, f"{n} repeated values in an ID column", "deduplicate or re-key")

    for c in columns:
        f, kind = found.held[c], types[c]
        pct = 100 * f["null_count"] / f["row_count"] if f["row_count"] else 0
        add(c, "missing_values", _graded(pct, 40, 10), f["null_count"], f"{f['null_count']} missing ({pct:.1f}%)",
            "fill after the other fixes, or drop the column if half is missing")
        is_text = f["kind"] == "text"
        if is_text:
            add(c, "null_like_strings", "warning", f["null_like_wide"],
                f"{f['null_like_wide']} placeholders for missing values", "turn placeholders into NULL")
            add(c, "whitespace", "info", f["padded"], f"{f['padded']} values with outer white space", "trim")
        if is_text and kind in ("numeric", "id"):
            add(c, "word_numbers", "warning", f["word_whole"], f"{f['word_whole']} numbers in words", "convert to digits")
            add(c, "currency_symbols", "warning", f["currency"], f"{f['currency']} values with a currency sign",
                "remove the sign and cast to float")
            if f["fnum_count"] and f["fnum_count"] < _held(f):
                add(c, "mixed_types", "warning", f["leftover_text"],
                    f"{f['fnum_count']} numbers mixed with {f['leftover_text']} other texts", "coerce to numbers, then fill")
        prefix = None
        if f["kind"] == "number":
            prefix = ""
        elif kind == "numeric" and f["fnum_count"] > 0.5 * f["row_count"]:
            prefix = "fnum_"
        if prefix is not None:
            age = infer.name_has(c, fixed.AGE_WORDS, match)
            score = infer.name_has(c, fixed.REPORT_SCORE_WORDS, match)
            if age or score or infer.name_has(c, fixed.REPORT_SALARY_WORDS, match):
                n = f[prefix + "negative"]
                add(c, "negative_values", "critical", n, f"{n} negative values where none can be", "set to NULL, then fill")
            for applies, key, limit in ((age, "over_age", fixed.AGE_RANGE[1]), (score, "over_score", fixed.SCORE_RANGE[1])):
                if applies:
                    n = f[prefix + key]
                    add(c, "impossible_range_high", "critical", n, f"{n} values above {limit:g}", f"set values above {limit:g} to NULL")
        if f["kind"] == "number":
            n = outliers.get(c, 0)
            add(c, "outliers", "warning", n, f"{n} values beyond three standard deviations", "review before analysis")
        if is_text:
            hits = [n for n in f["format_counts"] if n]
            if len(hits) > 1:
                add(c, "mixed_date_formats", "warning", sum(hits) - max(hits),
                    f"{len(hits)} date formats in use", "bring all dates to YYYY-MM-DD")
            n = _held(f)
            if n and f["date_any"] / n >= 0.3:
                add(c, "invalid_dates", "critical", n - f["date_any"], f"{n - f['date_any']} texts are no real dates",
                    "set invalid dates to NULL")
        if kind == "categorical":
            n = variants.get(c, 0)
            add(c, "case_inconsistency", "warning", n, f"{n} spellings differ only in case", "use one case")
    return out


def report_summary(spark: SparkSession, found: Evidence, issues: list[Issue]) -> DataFrame:
    """Table size, issue counts by severity, columns concerned."""
    table = issue_table(spark, issues)
    counts = table.agg(
        F.count("*").alias("total_issues"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")],
        F.count_distinct("column").alias("columns_with_issues"),
    )
    return counts.select(
        F.lit(found.rows).cast("bigint").alias("total_rows"), F.lit(len(found.held)).cast("bigint").alias("total_columns"),
        "*", F.lit(found.duplicate_rows).cast("bigint").alias("duplicate_rows"),
    )


# --- family "layers" ----------------------------------------------------------------------------
def layer_issues(
    df: DataFrame, found: Evidence | None = None, schema: dict[str, dict] | None = None, tag_text: bool = True
) -> list[Issue]:
    """Issues of the layered cleaner, judged by semantic type.

    Cells of a text column that read as numbers or booleans count as such for the
    mixed-type rule, unless ``tag_text`` is off. VARIANT cells are read as their text.
    """
    df = split(df)
    found = found or gather(df)
    schema = schema or infer.semantic_schema(found.held)
    columns = data_columns(df)
    out: list[Issue] = []

    def add(column, kind, severity, count, detail, action, confidence="high"):
        if count:
            out.append(Issue("layers", column, kind, severity, count, detail, action, confidence))

    id_columns = [c for c in columns if schema[c]["semantic"] == "id"]
    # a column with as many distinct values as cells repeats none, and one that is never missing leaves no row empty
    searched = [c for c in id_columns if not found.exact or found.unique.get(c) != _held(found.held[c])]
    filled = any(found.held[c]["kind"] != "text" and not found.held[c]["null_count"] for c in meaningful_columns(columns))
    n, repeated = together(
        lambda: 0 if filled else df.filter(empty_row(df)).count(),
        lambda: {r["column"]: r["member_rows"] for r in duplicate_ids(df, searched).collect()} if searched else {},
    )
    add(WHOLE_TABLE, "empty_rows", "critical", n, f"{n} rows without content", "drop empty rows")
    add(WHOLE_TABLE, "duplicate_rows", "warning", found.duplicate_rows, f"{found.duplicate_rows} copies of other rows",
        "drop duplicates, keep the first")
    for c in id_columns:
        nulls = found.held[c]["null_count"]
        n = repeated.get(c, 0) + (nulls if nulls > 1 else 0)
        add(c, "duplicate_ids", "critical", n, f"{n} rows share an ID", "investigate, deduplicate or reassign")
    for c in columns:
        f, semantic = found.held[c], schema[c]["semantic"]
        is_text = f["kind"] == "text"
        pct = round(100 * f["null_count"] / f["row_count"], 2) if f["row_count"] else 0
        add(c, "missing_values", "critical" if pct > 30 else "warning", f["null_count"],
            f"{f['null_count']} missing ({pct}%)", "fill with the median or the most frequent value")
        if is_text and tag_text:
            tags = {
                "int": f["int_like"], "float": f["num_count"] - f["int_like"], "bool": f["bool_like"],
                "str": _held(f) - f["num_count"] - f["bool_like"],
            }
            if sum(1 for v in tags.values() if v) > 1:
                add(c, "mixed_types", "warning", _held(f) - max(tags.values()),
                    ", ".join(f"{k}={v}" for k, v in tags.items() if v), "coerce to the main type")
        add(c, "whitespace", "info", f["padded"], f"{f['padded']} values with outer white space", "trim")
        if is_text and semantic in ("unknown", "name", "country", "gender"):
            n = found.unique.get(c, 0) - found.folded.get(c, 0)
            add(c, "mixed_case", "info", n, "spellings differ in case", "use one case", "medium")
        add(c, "word_numbers", "warning", f["word_any"], f"{f['word_any']} values with number words", "convert to numbers")
        add(c, "currency_string", "warning", f["currency"], f"{f['currency']} values with a currency sign",
            "remove the sign and cast to float")
        if semantic == "age":
            add(c, "negative_age", "critical", f["negative"], f"{f['negative']} negative ages", "set to NULL")
            add(c, "impossible_age", "critical", f["over_age"], f"{f['over_age']} ages above 120", "set to NULL")
        if semantic == "date" and is_text:
            n = _held(f) - f["date_any"]
            add(c, "invalid_date", "critical", n, f"{n} texts are no dates", "set to NULL")
            hits = [h for h in f["layer_format_counts"] if h]
            if len(hits) > 1:
                add(c, "mixed_date_formats", "warning", len(hits), f"{len(hits)} date formats fit some value",
                    "bring all dates to YYYY-MM-DD", "medium")
    return out


# --- family "auto" --------------------------------------------------------------------------------
def auto_column_issues(held: dict[str, dict], types: dict[str, str], match: str = "token") -> list[Issue]:
    """Issues the automatic cleaner notes per column after its format fixes."""
    out: list[Issue] = []
    for c, kind in types.items():
        f = held[c]
        n = _held(f)
        pct = 100 * f["null_count"] / f["row_count"] if f["row_count"] else 0
        if f["null_count"]:
            out.append(Issue("auto", c, "missing_values", _graded(pct, 40, 10, inclusive=False), f["null_count"],
                             f"{f['null_count']} missing ({pct:.1f}%)", "fill or drop"))
        if kind == "numeric" and f["negative"] and infer.name_has(c, fixed.POSITIVE_WORDS, match):
            out.append(Issue("auto", c, "negative_values", "warning", f["negative"],
                             f"{f['negative']} negative values in a column expected to be positive", "review the entries"))
        if kind in ("categorical", "text"):
            bad = n - f["email_loose"]
            if bad and infer.name_has(c, fixed.EMAIL_WORDS, match):
                out.append(Issue("auto", c, "invalid_email", "warning", bad, f"{bad} malformed addresses", "correct the addresses"))
            if f["kind"] == "text" and 0.1 * n < f["num_count"] < 0.9 * n:
                out.append(Issue("auto", c, "mixed_types", "warning", f["num_count"],
                                 f"{f['num_count']} of {n} texts read as numbers", "check the source of the column"))
    return out


def auto_table_issues(rows: int, duplicates: int, nulls: dict[str, int]) -> list[Issue]:
    out = []
    if duplicates:
        pct = 100 * duplicates / rows
        out.append(Issue("auto", None, "duplicate_rows", "critical" if pct > 10 else "warning", duplicates,
                         f"{duplicates} copies of other rows ({pct:.1f}%)", "remove duplicates"))
    for c, n in nulls.items():
        if rows and n / rows > 0.8:
            out.append(Issue("auto", c, "mostly_null_column", "critical", n, f"{100 * n / rows:.1f}% missing", "inspect the source"))
    return out


# --- family "smart" --------------------------------------------------------------------------------
def smart_issues(df: DataFrame, match: str = "token", found: Evidence | None = None) -> list[Issue]:
    """Quick scan before the smart cleaner runs."""
    found = found or gather(df)
    roles = infer.detect_roles(found.held, match)
    out: list[Issue] = []

    def add(column, kind, severity, count, detail, action):
        if count:
            out.append(Issue("smart", column, kind, severity, count, detail, action))

    for c, f in found.held.items():
        total = f["row_count"]
        if f["kind"] == "text":
            n = f["null_like"]
            add(c, "null_like_strings", "critical" if total and n / total >= 0.3 else "warning", n, f"{n} placeholders", "turn into NULL")
            add(c, "currency_symbols", "warning", f["currency"], f"{f['currency']} values with a currency sign", "strip")
            add(c, "word_numbers", "warning", f["word_whole"], f"{f['word_whole']} numbers in words", "convert")
        pct = 100 * f["null_count"] / total if total else 0
        add(c, "missing_values", _graded(pct, 50, 10), f["null_count"], f"{f['null_count']} missing ({pct:.1f}%)", "fill or drop")
        if f["kind"] == "number":
            if c in roles["age_columns"]:
                n = f["negative"] + f["over_age"]
                add(c, "impossible_values", "critical", n, f"{n} ages outside 0-120", "drop the rows")
            if c in roles["score_columns"]:
                n = f["negative"] + f["over_score"]
                add(c, "impossible_values", "critical", n, f"{n} scores outside 0-100", "drop the rows")
        if c in roles["date_columns"]:
            n = _held(f) - f["iso_shaped"]
            add(c, "mixed_date_formats", "warning", n, f"{n} dates not written YYYY-MM-DD", "standardise")
    share = found.duplicate_rows / found.rows if found.rows else 0
    add(None, "duplicate_rows", "critical" if share > 0.1 else "warning", found.duplicate_rows, f"{found.duplicate_rows} copies", "drop")
    n = df.filter(null_share(df) > fixed.SPARSE_ROW_SHARE).count()
    add(None, "mostly_empty_rows", "critical", n, f"{n} rows with more than half of the cells missing", "drop the rows")
    return out


# --- summaries, examples, advice -----------------------------------------------------------------------
def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("family", "severity").agg(
        F.count("*").alias("issues"), F.count_distinct("column").alias("columns")
    )


def issue_examples(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """Up to k smallest offending texts per column and kind of issue."""
    columns = [c for c in data_columns(df) if facts_.kind_of(df, c) == "text"] if columns is None else columns
    s = F.col("s")
    tests = {
        "null_like_strings": text.is_null_like(s, fixed.REPORT_NULL_TOKENS),
        "word_numbers": numbers.parse_number_words(s).isNotNull(),
        "currency_symbols": text.has_currency(s),
        "whitespace": text.is_padded(s),
        "mixed_types": numbers.parse_formatted_number(s).isNull() & numbers.parse_number_words(s).isNull(),
        "invalid_dates": dates.first_date(s, extra=True).isNull(),
    }
    long = stats.cells(df, columns, s=lambda c: quoted(c)).filter(s.isNotNull()).groupBy("column", "s").agg(F.count("*").alias("n"))
    flags = F.filter(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())
    tagged = long.select("column", "s", F.explode(flags).alias("issue_type"))
    ranked = tagged.withColumn("k", F.row_number().over(W.partitionBy("column", "issue_type").orderBy("s")))
    few = ranked.filter(F.col("k") <= k)
    return few.groupBy("column", "issue_type").agg(F.array_sort(F.collect_list("s")).alias("examples"))


def recommend_steps(df: DataFrame, match: str = "token", found: Evidence | None = None) -> DataFrame:
    """One proposed step per issue of the report, by fixed rules."""
    found = found or gather(df)
    rows = []
    for i in report_issues(df, match, found):
        f = found.held.get(i.column) if i.column else None
        numeric = bool(f) and infer.report_type(i.column, f, found.unique.get(i.column, 0), match) == "numeric"
        step = config = None
        if i.issue_type in ("null_like_strings", "word_numbers", "mixed_types") and numeric:
            step, config = "change_dtype", {"column": i.column, "dtype": "float"}
        elif i.issue_type == "negative_values":
            step, config = "filter_rows", {"column": i.column, "operator": ">=", "value": 0}
        elif i.issue_type == "impossible_range_high":
            age = infer.name_has(i.column, fixed.AGE_WORDS, match)
            limit = fixed.AGE_RANGE[1] if age else fixed.SCORE_RANGE[1]
            step, config = "filter_rows", {"column": i.column, "operator": "<=", "value": int(limit)}
        elif i.issue_type == "currency_symbols":
            step, config = "auto_clean", {}
        elif i.issue_type in ("mixed_date_formats", "invalid_dates"):
            step, config = "change_dtype", {"column": i.column, "dtype": "datetime"}
        elif i.issue_type == "duplicate_rows":
            step, config = "remove_duplicates", {"keep": "first"}
        elif i.issue_type == "missing_values":
            if f["null_count"] / f["row_count"] > 0.3:
                step, config = "drop_missing", {"columns": [i.column], "how": "any"}
            else:
                step, config = "fill_missing", {"column": i.column, "method": "median" if numeric else "mode"}
        if step:
            rows.append((i.column, i.issue_type, i.severity, i.count, step, json.dumps(config), i.recommended_action))
    return local_table(df.sparkSession, 
        rows, "column string, issue_type string, severity string, count bigint, step_type string, config string, reasoning string"
    )
