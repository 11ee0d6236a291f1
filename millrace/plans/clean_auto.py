"""Automatic cleaning: detect types, fix formats, fill or drop, all by rule."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fixed, numbers, text
from ..operators import facts as facts_
from ..operators import cells, infer, issues, stats
from ..operators.fill import Fill, apply_fills, number_view
from ..operators.steps import null_share
from ..rows import data_columns, dtype_of, hold, is_text, local_table, quoted, together


@dataclass
class AutoResult:
    """The cleaned table and the record of what was decided."""

    df: DataFrame
    types: dict[str, str]
    notes: dict[str, list[str]] = field(default_factory=dict)
    fills: list[Fill] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    kept_missing: list[str] = field(default_factory=list)
    issues: list[issues.Issue] = field(default_factory=list)
    held: DataFrame | None = None

    def release(self) -> None:
        """Free the stage kept for the jobs; call it when the result is written."""
        if self.held is not None:
            self.held.unpersist()

    def table_issues(self) -> list[issues.Issue]:
        """Issues of the cleaned table as a whole (runs over the result)."""
        names = data_columns(self.df)
        row = self.df.agg(
            F.count("*").alias("n"), *[(F.count("*") - F.count(quoted(c))).alias(f"g{i}") for i, c in enumerate(names)]
        ).first()
        copies = facts_.duplicate_count(self.df).first()["duplicate_rows"]
        return issues.auto_table_issues(row["n"], copies, {c: row[f"g{i}"] for i, c in enumerate(names)})

    def explanations(self) -> DataFrame:
        """One line per column: what was done, why, and what to check."""
        filled = {f.column: f for f in self.fills}
        rows = []
        for c, kind in self.types.items():
            mine = [i for i in self.issues if i.column == c]
            severity = "warning" if c in self.dropped or any(i.severity == "critical" for i in mine) else "info"
            if c in self.kept_missing:
                severity = "info"
            if c in self.dropped:
                decision, summary = "DROP_COLUMN", f"{c}: dropped, too much missing"
            elif c in self.kept_missing:
                decision, summary = "KEEP_AS_NAN", f"{c}: important, kept with its gaps"
            elif c in filled:
                f = filled[c]
                decision = f.method.upper()
                summary = f"{c}: {f.missing} missing ({f.missing_pct}%) filled by {f.method}"
            elif self.notes.get(c):
                decision, summary = "FORMAT", f"{c}: {len(self.notes[c])} format fix(es)"
            else:
                decision, summary = "NONE", f"{c}: no change needed"
            value = str(filled[c].value) if c in filled else None
            checks = [f"review: {i.detail}" for i in mine if i.issue_type != "missing_values"]
            rows.append(("auto_clean", severity, c, decision, kind, summary, value, checks + self.notes.get(c, []), "high"))
        return local_table(self.df.sparkSession, 
            rows,
            "anomaly_type string, severity string, column string, decision string, detected_type string,"
            " summary string, fill_value string, recommended_checks array<string>, confidence string",
        )


def _clean_formats(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Numbers without signs, real dates, trimmed text."""
    changed = {}
    for c, kind in types.items():
        if not is_text(dtype_of(df, c)):
            if kind == "datetime":
                changed[c] = quoted(c).cast("date")
            continue
        if kind == "numeric":
            changed[c] = numbers.parse_formatted_number(quoted(c))
        elif kind == "datetime":
            changed[c] = dates.first_date(quoted(c), extra=True)
        else:
            changed[c] = text.trimmed(quoted(c))
    return df.withColumns(changed) if changed else df


def _date_fills(df: DataFrame, names: list[str], held: dict[str, dict]) -> list[Fill]:
    """The middle date (element n // 2 of the sorted dates) of each date column."""
    wanted = []
    for c in names:
        n = held[c]["row_count"] - held[c]["null_count"]
        wanted.append(stats.Ranks(c, F.unix_date(quoted(c)).cast("double"), n, (n // 2 + 1,)))
    found = stats.order_statistics(df, wanted)
    import datetime

    out = []
    for c in names:
        if c in found:
            day = datetime.date(1970, 1, 1) + datetime.timedelta(days=int(found[c][0]))
            f = held[c]
            out.append(Fill(c, "median_date", day, f["null_count"], round(100 * f["null_count"] / f["row_count"], 2)))
    return out


def auto_clean(
    df: DataFrame,
    columns: list[str] | None = None,
    drop_columns_above_threshold: bool = True,
    match: str = "token",
) -> AutoResult:
    """Clean without user decisions. Cells of mixed columns keep their types (operators/cells.py).

    Jobs: facts of the raw columns, facts of the converted columns, then the
    medians, most frequent values and middle dates that a fill really needs.
    """
    mixed = cells.mixed_columns(df)
    df = cells.split(df)
    target = [c for c in (columns or data_columns(df)) if c in df.columns]
    texts = [c for c in target if is_text(dtype_of(df, c))]
    raw, unique_raw = together(
        lambda: facts_.collect_facts(facts_.column_facts(df, target, frozenset({facts_.TEXT, facts_.DATES}))),
        lambda: infer.unique_counts(df, texts) if texts else {},
    )
    types = {c: infer.auto_type(raw[c], unique_raw.get(c, 0)) for c in target}
    notes = {c: _notes(raw[c], types[c]) for c in target}

    clean = hold(_clean_formats(df, types))
    held = facts_.collect_facts(facts_.column_facts(clean, target, frozenset({facts_.TEXT, facts_.NUMBERS, facts_.BRACKET})))
    found = issues.auto_column_issues(held, types, match)
    gap = {c: held[c]["null_count"] / held[c]["row_count"] if held[c]["row_count"] else 0 for c in target}
    want_unique = [
        c for c in target
        if (types[c] in ("categorical", "text") and gap[c] > 0) or (types[c] == "numeric" and gap[c] > fixed.AUTO_DROP_SHARE)
    ]
    unique = infer.unique_counts(clean, want_unique) if want_unique else {}

    weak = [c for c in target if types[c] == "numeric" and gap[c] > fixed.AUTO_DROP_SHARE]
    kept = [c for c in weak if infer.is_important(c, held[c]["num_count"], unique.get(c, 0), match)]
    dropped = [c for c in weak if c not in kept] if drop_columns_above_threshold else []
    numeric = [c for c in target if types[c] == "numeric" and c not in weak and gap[c] > 0]
    skewed = [c for c in numeric if abs(held[c]["num_skew"] or 0.0) >= fixed.SYMMETRIC_SKEW]
    words = [c for c in target if types[c] in ("categorical", "text") and gap[c] > 0]
    by_mode = [c for c in words if gap[c] <= fixed.AUTO_DROP_SHARE and unique.get(c, 0) <= fixed.LOW_CARDINALITY]
    middle, common, days = together(
        lambda: stats.medians(clean, held, skewed, lambda c: number_view(clean, c)),
        lambda: stats.modes(clean, by_mode),
        lambda: _date_fills(clean, [c for c in target if types[c] == "datetime" and gap[c] > 0], held),
    )
    info = lambda c: dict(missing=held[c]["null_count"], missing_pct=round(100 * gap[c], 2))
    fills = [
        Fill(c, "median", middle.get(c), skewness=held[c]["num_skew"], numeric=True, **info(c)) if c in skewed
        else Fill(c, "mean", held[c]["num_mean"], skewness=held[c]["num_skew"], numeric=True, **info(c))
        for c in numeric
    ]
    for c in words:
        fills.append(Fill(c, "mode" if c in common else "constant", common.get(c, "Unknown"), **info(c)))
    fills += days

    filled = apply_fills(clean, fills).drop(*dropped)
    out = filled.filter(null_share(filled) < fixed.SPARSE_ROW_SHARE)
    as_text = {c: dates.iso_text(quoted(c)) for c, k in types.items() if k == "datetime"}
    out = out.withColumns(as_text) if as_text else out
    return AutoResult(cells.joined(out, mixed) if mixed else out, types, notes, fills, dropped, kept, found, clean)


def _notes(f: dict, kind: str) -> list[str]:
    if f["kind"] != "text":
        return []
    n = f["row_count"] - f["null_count"]
    if kind == "numeric":
        lost = n - f["fnum_count"]
        out = [f"removed signs from {f['currency']} value(s)"] if f["currency"] else []
        return out + ([f"{lost} text(s) are no numbers and became NULL"] if lost else [])
    if kind == "datetime":
        lost = n - f["date_any"]
        return [f"{lost} text(s) are no dates and became NULL" if lost else "dates brought to one format"]
    return [f"trimmed {f['padded']} value(s)"] if f["padded"] else []
