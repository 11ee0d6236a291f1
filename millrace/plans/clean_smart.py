"""Smart cleaning by column roles, in nine fixed stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, fixed, numbers, text
from ..operators import facts as facts_
from ..operators import cells, infer, stats
from ..operators.fill import Fill, apply_fills, number_view
from ..operators.steps import impossible_value, null_share, remove_duplicates
from ..rows import data_columns, dtype_of, hold, is_text, local_table, quoted, together

STAGES = (
    "null_tokens", "currency", "word_numbers", "types", "impossible_rows", "sparse_rows", "fill", "drop_columns",
    "duplicates",
)


@dataclass
class SmartResult:
    df: DataFrame
    roles: dict[str, list[str]]
    log: list[tuple[str, str | None, int]] = field(default_factory=list)
    fills: list[Fill] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    before_dedup: DataFrame | None = None
    rows_in: int = 0
    rows_kept: int = 0
    held: DataFrame | None = None

    def release(self) -> None:
        """Free the stage kept for the jobs; call it when the result is written."""
        if self.held is not None:
            self.held.unpersist()

    def log_table(self) -> DataFrame:
        """``(stage, column, cells)``: what each stage changed; zero entries are left out."""
        rows = [(s, c, n) for s, c, n in self.log if n]
        return local_table(self.df.sparkSession, rows, "stage string, column string, cells bigint")

    def summary(self) -> DataFrame:
        """One row of totals; counts the result, so it runs the cleaned plan once."""
        total = lambda s: sum(n for st, _, n in self.log if st == s)
        rows_after = self.df.count()
        values = (
            self.rows_in, rows_after, self.rows_in - rows_after, total("null_tokens"), total("currency"),
            total("word_numbers"), total("dates"), total("sparse_rows"), sum(f.missing for f in self.fills),
            len(self.dropped), self.rows_kept - rows_after,
        )
        names = (
            "rows_before", "rows_after", "rows_removed", "null_strings_replaced", "currency_stripped",
            "word_nums_converted", "dates_normalized", "sparse_rows_removed", "nulls_filled", "cols_dropped", "dupes_removed",
        )
        return local_table(self.df.sparkSession, [values], ", ".join(f"{n} bigint" for n in names))

    def explanations(self) -> DataFrame:
        """One line per stage and column that changed something."""
        severity = {
            "null_tokens": "info", "currency": "info", "word_numbers": "warning", "dates": "warning",
            "impossible_values": "critical", "sparse_rows": "warning", "coerced_to_null": "info",
        }
        text_of = {
            "null_tokens": "placeholder(s) turned into NULL", "currency": "currency sign(s) removed",
            "word_numbers": "number word(s) converted", "dates": "date(s) rewritten as YYYY-MM-DD",
            "impossible_values": "row(s) with an impossible value removed", "sparse_rows": "sparse row(s) removed",
            "coerced_to_null": "text(s) that are no numbers became NULL",
        }
        rows = [
            ("smart_clean", severity[s], c, f"{c or 'table'}: {n} {text_of[s]}", "high")
            for s, c, n in self.log if n and s in severity
        ]
        rows += [
            ("smart_clean", "info", f.column, f"{f.column}: {f.missing} gap(s) filled by {f.method} = {f.value}", "high")
            for f in self.fills
        ]
        rows += [("smart_clean", "warning", c, f"{c}: dropped, half or more missing", "high") for c in self.dropped]
        return local_table(self.df.sparkSession, 
            rows, "anomaly_type string, severity string, column string, summary string, confidence string"
        )


def _role(config: dict, detected: dict[str, list[str]], key: str) -> list[str]:
    """A role list from the config; None means detect, an empty list means none."""
    value = config.get(key)
    return detected[key] if value is None else list(value)


def smart_clean(df: DataFrame, config: dict | None = None, match: str = "token") -> SmartResult:
    """Clean by roles: ages, scores, currency, salaries and dates.

    Two aggregates decide everything: facts of the raw columns, and facts of the
    rows left after the row filters. The typed stage is kept for the jobs on it.
    """
    config = config or {}
    mixed = cells.mixed_columns(df)
    df = cells.split(df)
    columns = data_columns(df)
    # Roles look at the table as it came, so the placeholder stage comes after.
    raw = facts_.collect_facts(facts_.column_facts(df, columns, frozenset({facts_.TEXT, facts_.DATES})))
    detected = infer.detect_roles(raw, match)
    roles = {r: [c for c in _role(config, detected, r) if c in columns] for r in infer.ROLES}
    hints = [c for c in columns if any(c in roles[r] for r in infer.ROLES if r != "date_columns")]

    # Stages 1-4 as one projection, with a flag per counted change.
    typed: dict[str, Column] = {}
    flags: list[tuple[str, str, Column]] = []
    for c in columns:
        if not is_text(dtype_of(df, c)):
            continue
        s = text.null_tokens_to_null(quoted(c))
        flags.append(("null_tokens", c, quoted(c).isNotNull() & s.isNull()))
        value = s
        if c in roles["currency_columns"] and raw[c]["currency"]:
            value = F.coalesce(numbers.parse_currency(s), numbers.parse_number(s))
            flags.append(("currency", c, text.has_currency(s)))
            flags.append(("coerced_to_null", c, s.isNotNull() & value.isNull()))
        elif c in hints:
            word = numbers.parse_number_words(s)
            value = F.coalesce(word, numbers.parse_number(s))
            flags.append(("word_numbers", c, word.isNotNull()))
            flags.append(("coerced_to_null", c, s.isNotNull() & value.isNull()))
        if c in roles["date_columns"]:
            day = dates.iso_text(dates.first_date(value.cast("string"), extra=True))
            flags.append(("dates", c, day.isNotNull() & ~day.eqNullSafe(value.cast("string"))))
            value = day
        typed[c] = value
    flagged = hold(df.select(
        *[typed[c].alias(c) if c in typed else quoted(c) for c in df.columns],
        *[F.coalesce(cond, F.lit(False)).alias(f"_f{i}") for i, (_, _, cond) in enumerate(flags)],
    ))
    stage4 = flagged.select(*map(quoted, df.columns))

    bad = impossible_value(stage4, roles["age_columns"], roles["score_columns"], roles["salary_columns"])
    any_bad = F.lit(False)
    for cond in bad.values():
        any_bad = any_bad | cond
    sparse = null_share(stage4) >= fixed.SPARSE_ROW_SHARE
    row = flagged.agg(
        F.count("*").alias("n"),
        F.count_if(any_bad).alias("bad"),
        F.count_if(~any_bad & sparse).alias("sparse"),
        *[F.count_if(F.col(f"_f{i}")).alias(f"f{i}") for i in range(len(flags))],
        *[F.count_if(cond).alias(f"b{i}") for i, cond in enumerate(bad.values())],
    ).first()
    log = [(stage, c, row[f"f{i}"]) for i, (stage, c, _) in enumerate(flags)]
    log += [("impossible_values", c, row[f"b{i}"]) for i, c in enumerate(bad)]
    log += [("impossible_rows", None, row["bad"]), ("sparse_rows", None, row["sparse"])]

    kept = stage4.filter(~any_bad & ~sparse)
    held = facts_.collect_facts(facts_.column_facts(kept, columns, frozenset({facts_.NUMBERS, facts_.BRACKET})))
    gap = {c: held[c]["null_count"] / held[c]["row_count"] if held[c]["row_count"] else 0.0 for c in columns}
    fillable = [c for c in columns if 0 < gap[c] < fixed.NULL_COLUMN_SHARE]
    numeric = [c for c in fillable if held[c]["kind"] == "number"]
    middle, common = together(
        lambda: stats.medians(kept, held, numeric, lambda c: number_view(kept, c)),
        lambda: stats.modes(kept, [c for c in fillable if c not in numeric]),
    )
    fills = []
    for c in fillable:
        info = dict(missing=held[c]["null_count"], missing_pct=round(100 * gap[c], 1))
        if c in numeric:
            fills.append(Fill(c, "median", middle.get(c), numeric=True, **info))
        else:
            fills.append(Fill(c, "mode", common.get(c, "Unknown"), **info))
    dropped = [c for c in columns if gap[c] >= fixed.NULL_COLUMN_SHARE]
    filled = apply_fills(kept, fills).drop(*dropped)
    rows_kept = next(iter(held.values()))["row_count"] if held else 0
    log += [("fill", f.column, f.missing) for f in fills] + [("drop_columns", c, held[c]["null_count"]) for c in dropped]
    unique = remove_duplicates(filled)
    return SmartResult(cells.joined(unique, mixed) if mixed else unique, roles, log, fills, dropped, filled, row["n"], rows_kept, flagged)


def preview_clean(df: DataFrame, config: dict | None = None, rows: int = 50, match: str = "token") -> dict[str, DataFrame]:
    """Totals before and after, the stage log and the first rows of the result."""
    from ..sources.scan import preview

    result = smart_clean(df, config, match)
    totals = facts_.table_totals(df).withColumn("version", F.lit("before")).unionByName(
        facts_.table_totals(result.df).withColumn("version", F.lit("after"))
    )
    return {"totals": totals, "changes": result.log_table(), "preview": preview(result.df, rows)}


