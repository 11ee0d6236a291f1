"""Layered cleaning: profile, infer, detect, normalise, validate, repair, deduplicate, audit, score."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fixed, numbers, text
from ..operators import audit as audit_
from ..operators import cells
from ..operators import facts as facts_
from ..operators import infer, issues, score, stats
from ..operators.fill import Fill, apply_fills, number_view
from ..operators.steps import drop_empty_rows, duplicate_ids, empty_row, remove_duplicates
from ..rows import ROW_ID, data_columns, dtype_of, hold, is_text, local_table, quoted, together

LAYERS = (
    "profiling", "schema_inference", "issue_detection", "normalization", "validation", "repair",
    "duplicate_handling", "audit_logging", "quality_scoring",
)
# Default validation bounds.
RULES = {"age_min": 0, "age_max": 120, "money_min": 0}
Schema = dict[str, dict]


def _cols(schema: Schema, *buckets: str) -> list[str]:
    return [c for c, s in schema.items() if s["bucket"] in buckets]


# --- layer 4 ---------------------------------------------------------------------------------
def _trail(df: DataFrame, schema: Schema, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, list[tuple]]]:
    """Each text column after every normalising step, kept side by side.

    Step values are real columns, so a later step reads them instead of repeating
    the work, and the audit compares neighbours in the same row.
    """
    trail: dict[str, list[tuple]] = {}
    frame = df
    for c in data_columns(df):
        if not is_text(dtype_of(df, c)):
            continue
        s = schema.get(c, {"semantic": "unknown", "storage": "text", "bucket": ""})
        steps: list[tuple] = [("strip_whitespace", text.trimmed, "high")]
        if s["semantic"] not in exclude and (
            s["storage"] == "text" or s["semantic"] in ("country", "gender", "unknown", "categorical", "name")
        ):
            case = text.title_case if s["semantic"] in ("name", "country") else F.lower
            steps.append(("normalise_case", case, "medium"))
        if s["bucket"] in ("money_columns", "age_columns"):
            steps.append(("strip_currency", _money_text, "high"))
        steps.append(("convert_word_number", _word_text, "high"))
        if s["semantic"] == "date" or s["bucket"] == "date_columns":
            steps.append(("normalise_date", dates.careful_date, "high"))
        last = c
        stages = []
        for k, (action, make, confidence) in enumerate(steps):
            name = f"_{k}_{c}"
            frame = frame.withColumn(name, make(quoted(last)))
            stages.append((action, last, name, confidence))
            last = name
        trail[c] = stages
    return frame, trail


def _money_text(c: Column) -> Column:
    return F.coalesce(numbers.parse_currency(c).cast("string"), c)


def _word_text(c: Column) -> Column:
    word = numbers.parse_number_words(c, hyphens=False, allow_zero=False)
    return F.coalesce(word.cast("bigint").cast("string"), c)


def normalise(df: DataFrame, schema: Schema, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Trim, case, currency, number words, dates; values only, no row is lost."""
    frame, trail = _trail(df, schema, exclude)
    return _trail_end(frame, trail, df.columns)


def _trail_end(frame: DataFrame, trail: dict[str, list[tuple]], columns: list[str]) -> DataFrame:
    return frame.select(*[quoted(trail[c][-1][2]).alias(c) if c in trail else quoted(c) for c in columns])


def normalise_audit(df: DataFrame, schema: Schema, exclude: tuple[str, ...] = ()) -> DataFrame:
    """One entry per changed cell and step, and a flag for dates with two readings."""
    return _trail_audit(*_trail(df, schema, exclude))


def _trail_audit(frame: DataFrame, trail: dict[str, list[tuple]]) -> DataFrame:
    entries = []
    for c, stages in trail.items():
        for action, a, b, confidence in stages:
            x, y = quoted(a), quoted(b)
            entries.append(audit_.audit_entry(c, F.lit(action), x, y, confidence, "normalization", ~x.eqNullSafe(y)))
            if action == "normalise_date":
                entries.append(
                    audit_.audit_entry(c, F.lit("date_format_ambiguous"), x, x, "low", "normalization", dates.is_ambiguous_date(x))
                )
    return _entries_or_none(frame, entries)


def _entries_or_none(frame: DataFrame, entries: list[Column]) -> DataFrame:
    if entries:
        return audit_.explode_audit(frame, entries)
    return local_table(frame.sparkSession, 
        [], f"{ROW_ID} bigint, column string, action string, from string, to string, confidence string, layer string"
    )


# --- layer 5 ---------------------------------------------------------------------------------
def _validated(df: DataFrame, schema: Schema, rules: dict | None) -> dict[str, tuple[Column, str]]:
    """New value and audit action per checked column."""
    r = {**RULES, **(rules or {})}
    out: dict[str, tuple[Column, str]] = {}
    for c in data_columns(df):
        s = schema.get(c, {"semantic": "unknown", "bucket": ""})
        if s["semantic"] == "age":
            x = number_view(df, c)
            out[c] = (F.when(x.between(r["age_min"], r["age_max"]), x), "invalidate_age")
        elif s["semantic"] == "date" and is_text(dtype_of(df, c)):
            out[c] = (F.when(dates.is_real_iso_date(quoted(c)), quoted(c)), "invalidate_date")
        elif s["semantic"] == "money":
            x = number_view(df, c)
            out[c] = (F.when(x >= r["money_min"], x), "invalidate_money")
        elif s["bucket"] == "numeric_columns":
            out[c] = (number_view(df, c), "coerce_numeric_failed")
    return out


def validate(df: DataFrame, schema: Schema, rules: dict | None = None) -> DataFrame:
    """Values that break a rule of their semantic type become NULL."""
    new = _validated(df, schema, rules)
    return df.withColumns({c: v for c, (v, _) in new.items()}) if new else df


def validate_audit(df: DataFrame, schema: Schema, rules: dict | None = None) -> DataFrame:
    """One entry per cell a rule rejected; text that is no number at all is only
    logged for plain number columns."""
    entries = []
    for c, (v, action) in _validated(df, schema, rules).items():
        held = quoted(c).isNotNull() if action in ("coerce_numeric_failed", "invalidate_date") else number_view(df, c).isNotNull()
        entries.append(audit_.audit_entry(c, F.lit(action), quoted(c), F.lit(None), "high", "validation", held & v.isNull()))
    return _entries_or_none(df, entries)


# --- layer 6 ---------------------------------------------------------------------------------
def decide_repairs(df: DataFrame, schema: Schema, null_pct: dict[str, float]) -> list[tuple[Fill, str]]:
    """Fill value and trust per column with gaps; IDs and dates are left alone."""
    columns = data_columns(df)
    held = facts_.collect_facts(facts_.column_facts(df, columns, frozenset({facts_.NUMBERS, facts_.BRACKET})))
    gaps = [c for c in columns if held[c]["null_count"] and schema.get(c, {}).get("semantic") not in ("id", "date")]
    buckets = ("numeric_columns", "age_columns", "money_columns")
    numeric = [c for c in gaps if schema.get(c, {}).get("bucket") in buckets and held[c]["num_count"]]
    by_median = [
        c for c in numeric if held[c]["num_count"] < 3 or abs(held[c]["num_skew"] or 0.0) >= fixed.SYMMETRIC_SKEW
    ]
    words = [c for c in gaps if schema.get(c, {}).get("bucket") not in buckets]
    middle, common = together(
        lambda: stats.medians(df, held, by_median, lambda c: number_view(df, c)), lambda: stats.modes(df, words)
    )
    out = []
    for c in gaps:
        pct = null_pct.get(c, 0.0)
        trust = "high" if pct < 5 else "medium" if pct <= 20 else "low"
        if c in by_median:
            out.append((Fill(c, "impute_median", middle.get(c), held[c]["null_count"], pct, numeric=True), trust))
        elif c in numeric:
            out.append((Fill(c, "impute_mean", held[c]["num_mean"], held[c]["null_count"], pct, numeric=True), trust))
        elif c in common:
            value = common[c]
            out.append((Fill(c, "impute_mode", value, held[c]["null_count"], pct), trust))
    return out


def _typed_fills(df: DataFrame, repairs: list[tuple[Fill, str]]) -> list[Fill]:
    fills = []
    for f, _ in repairs:
        if f.method == "impute_mode" and not is_text(dtype_of(df, f.column)):
            f = Fill(f.column, f.method, stats.mode_of(df, f.column), f.missing, f.missing_pct)
        fills.append(f)
    return fills


def repair(df: DataFrame, schema: Schema, null_pct: dict[str, float]) -> DataFrame:
    return apply_fills(df, _typed_fills(df, decide_repairs(df, schema, null_pct)))


def repair_audit(df: DataFrame, repairs: list[tuple[Fill, str]]) -> DataFrame:
    """One entry per filled cell."""
    entries = [
        audit_.audit_entry(
            f.column, F.lit(f.method), F.lit(None), F.lit(round(f.value, 4) if isinstance(f.value, float) else f.value),
            trust, "repair", (number_view(df, f.column) if f.numeric else quoted(f.column)).isNull(),
        )
        for f, trust in repairs
    ]
    return _entries_or_none(df, entries)


# --- layer 7 ---------------------------------------------------------------------------------
def handle_duplicates(df: DataFrame, keep: str = "first") -> DataFrame:
    """Drop empty rows, then copies; repeated IDs are reported, never dropped."""
    return remove_duplicates(drop_empty_rows(df), keep=False if keep == "none" else keep)


def _table_entry(counted: DataFrame, column, action: str, layer: str) -> DataFrame:
    """Entries about a column or the table as a whole from a frame with ``rows``."""
    name = F.lit(column) if isinstance(column, str) else column
    return counted.filter("rows > 0").select(
        name.alias("column"), F.lit(action).alias("action"), F.col("rows").cast("bigint").alias("rows"),
        F.lit("high").alias("confidence"), F.lit(layer).alias("layer"),
    )


def duplicates_audit(with_empty: DataFrame, before: DataFrame, after: DataFrame, schema: Schema) -> DataFrame:
    """Table-level entries of layer 7: empty rows, dropped copies and rows with repeated IDs."""
    empty = with_empty.filter(empty_row(with_empty)).agg(F.count(F.lit(1)).alias("rows"))
    sizes = before.agg(F.count(F.lit(1)).alias("n")).unionByName(after.agg((-F.count(F.lit(1))).alias("n")))
    out = _table_entry(empty, "__all__", "drop_empty_rows", "duplicate_handling").unionByName(
        _table_entry(sizes.agg(F.sum("n").alias("rows")), "__all__", "drop_duplicate_rows", "duplicate_handling")
    )
    ids = [c for c, s in schema.items() if s["semantic"] == "id" and c in after.columns]
    if ids:
        repeated = duplicate_ids(after, ids).withColumnRenamed("member_rows", "rows")
        out = out.unionByName(_table_entry(repeated, F.col("column"), "flag_duplicate_ids", "duplicate_handling"))
    return out


def skipped_audit(df: DataFrame, schema: Schema, held: dict[str, dict]) -> DataFrame:
    """An entry for every ID or date column with gaps: they are never filled."""
    rows = [
        (c, "skip_imputation", held[c]["null_count"], "high", "repair")
        for c in data_columns(df) if c in held and held[c]["null_count"] and schema.get(c, {}).get("semantic") in ("id", "date")
    ]
    return local_table(df.sparkSession, rows, "column string, action string, rows bigint, confidence string, layer string")


# --- all layers --------------------------------------------------------------------------------
@dataclass
class LayersResult:
    df: DataFrame
    schema: Schema = field(default_factory=dict)
    issues: list[issues.Issue] = field(default_factory=list)
    repairs: list[tuple[Fill, str]] = field(default_factory=list)
    audit: DataFrame | None = None
    table_audit: DataFrame | None = None
    score: DataFrame | None = None
    layers_run: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Free the stages kept for the jobs; call it when the result is written."""
        for df in self.held:
            df.unpersist()

    def issue_table(self) -> DataFrame:
        return issues.issue_table(self.df.sparkSession, self.issues)

    def schema_table(self) -> DataFrame:
        return infer.schema_table(self.df.sparkSession, self.schema)

    def audit_summary(self) -> DataFrame | None:
        return audit_.audit_summary(self.audit) if self.audit is not None else None


def run_layers(df: DataFrame, config: dict | None = None, layers: list[str] | None = None, strict: bool = False) -> LayersResult:
    """Run the chosen layers in order.

    A layer that fails is noted in ``errors`` and left out; the others still run. With
    ``strict`` it ends the run. VARIANT columns are cleaned as text; their cells keep their types.
    Schema, issues and repair need the profile. Every layer is a lazy plan on the
    one before; jobs run for the profile, the repair decisions and the score only.
    The normalised and the validated rows are kept, as several jobs read them.
    """
    config = config or {}
    mixed = cells.mixed_columns(df)
    df = cells.split(df)
    chosen = set(layers or LAYERS)
    out = LayersResult(df)
    audits: list[DataFrame] = []
    about_table: list[DataFrame] = []
    with_empty = df
    found: issues.Evidence | None = None
    keep = config.get("duplicate_keep", "first")
    rules = config.get("validation_rules") or {}

    def run(layer: str, work) -> None:
        if layer not in chosen:
            return
        try:
            work()
            out.layers_run.append(layer)
        except Exception as error:  # one layer must not stop the others
            if strict:
                raise
            out.errors.append(f"{layer}: {error}")

    def profiling():
        nonlocal found
        found = issues.gather(df)

    def schema_inference():
        out.schema = infer.semantic_schema(found.held)

    def issue_detection():
        out.issues = issues.layer_issues(df, found, out.schema)

    def normalization():
        # All later layers read the normalised text, and the audit its steps.
        frame, trail = _trail(df, out.schema)
        frame = hold(frame)
        out.held.append(frame)
        audits.append(_trail_audit(frame, trail))
        out.df = _trail_end(frame, trail, df.columns)

    def early_empty_rows():
        nonlocal with_empty
        with_empty = out.df
        out.df = drop_empty_rows(out.df)

    def validation():
        audits.append(validate_audit(out.df, out.schema, rules))
        out.df = hold(validate(out.df, out.schema, rules))
        out.held.append(out.df)

    def repairing():
        pct = {c: 100 * f["null_count"] / f["row_count"] if f["row_count"] else 0.0 for c, f in found.held.items()}
        out.repairs = decide_repairs(out.df, out.schema, pct)
        fills = _typed_fills(out.df, out.repairs)
        audits.append(repair_audit(out.df, out.repairs))
        about_table.append(skipped_audit(out.df, out.schema, found.held))
        out.df = apply_fills(out.df, fills)

    def duplicate_handling():
        before = out.df
        out.df = hold(handle_duplicates(before, keep))
        out.held.append(out.df)
        about_table.append(duplicates_audit(with_empty, before, out.df, out.schema))

    def audit_logging():
        out.audit = reduce(DataFrame.unionByName, audits) if audits else None
        out.table_audit = reduce(DataFrame.unionByName, about_table) if about_table else None

    def quality_scoring():
        spark = df.sparkSession
        after, counted = [], (None, None)
        if found is not None:
            cleaned = issues.gather(out.df)
            after = issues.layer_issues(out.df, cleaned)
            counted = tuple((e.rows, e.null_cells) for e in (found, cleaned))
        out.score = score.quality_pair(
            df, out.df, issues.issue_table(spark, out.issues), issues.issue_table(spark, after), counted
        )

    run("profiling", profiling)
    if found is not None:
        run("schema_inference", schema_inference)
        run("issue_detection", issue_detection)
    run("normalization", normalization)
    if "duplicate_handling" in chosen:
        try:
            early_empty_rows()
        except Exception as error:
            if strict:
                raise
            out.errors.append(f"empty_row_removal: {error}")
    run("validation", validation)
    if found is not None:
        run("repair", repairing)
    run("duplicate_handling", duplicate_handling)
    run("audit_logging", audit_logging)
    run("quality_scoring", quality_scoring)
    out.df = cells.joined(out.df, mixed) if mixed else out.df
    return out
