"""Declarative runs: a list of steps, applied in order, with reports after each one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import anomalies as anomalies_
from ..operators import audit as audit_
from ..operators import causes, cells
from ..operators import facts as facts_
from ..operators import infer, issues, score, steps
from ..operators.fill import fill_missing
from ..operators.digests import table_digest
from ..operators.joins import join_tables
from ..rows import RIGHT_ID, ROW_ID, data_columns, estimated_bytes, hold, number_rows, quoted, settled
from ..session import checkpointed
from .clean_auto import AutoResult, auto_clean
from .clean_smart import SmartResult, smart_clean


@dataclass(frozen=True)
class Step:
    """One step: plain data, so a list of steps is stored and edited as JSON."""

    step_type: str
    config: dict = field(default_factory=dict)
    name: str = ""
    enabled: bool = True
    step_id: str = field(default_factory=lambda: uuid.uuid4().hex[:8])

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def from_json(text: str) -> Step:
        return Step(**json.loads(text))


# --- editing a list of steps -------------------------------------------------------------
def add_step(plan: list[Step], step: Step, at: int | None = None) -> list[Step]:
    return plan + [step] if at is None else plan[:at] + [step] + plan[at:]


def edit_step(plan: list[Step], step_id: str, **changes) -> list[Step]:
    return [replace(s, **changes) if s.step_id == step_id else s for s in plan]


def delete_step(plan: list[Step], step_id: str) -> list[Step]:
    return [s for s in plan if s.step_id != step_id]


def reorder_steps(plan: list[Step], step_ids: list[str]) -> list[Step]:
    by_id = {s.step_id: s for s in plan}
    return [by_id[i] for i in step_ids] + [s for s in plan if s.step_id not in step_ids]


# --- step types --------------------------------------------------------------------------
Lookup = Callable[[str], DataFrame]


def _join(df: DataFrame, c: dict, lookup: Lookup | None) -> DataFrame:
    right, on = c.get("right_dataset") or c.get("right_dataset_path"), c.get("on")
    if not right or not on:
        raise ValueError("join needs right_dataset and on")
    other = right if isinstance(right, DataFrame) else lookup(right) if lookup else None
    if other is None:
        raise ValueError(f"right dataset not found: {right}")
    df = df.drop(RIGHT_ID)
    other = other.withColumnRenamed(ROW_ID, RIGHT_ID) if ROW_ID in other.columns else other.withColumn(RIGHT_ID, _content_order(other))
    return join_tables(df, other, on, c.get("how", "inner"), c.get("null_keys_match", True))


def _content_order(df: DataFrame):
    """A stand-in for the row order of a table that has none: the same on every run."""
    return F.xxhash64(*[quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.VariantType)])


CLEANERS: dict[str, Callable[[DataFrame, dict], AutoResult | SmartResult]] = {
    "auto_clean": lambda df, c: auto_clean(df, c.get("columns"), c.get("drop_columns_above_threshold", True)),
    "smart_clean": lambda df, c: smart_clean(df, c),
}
STEPS: dict[str, Callable[[DataFrame, dict, Lookup | None], DataFrame]] = {
    **{name: lambda df, c, _, clean=clean: clean(df, c).df for name, clean in CLEANERS.items()},
    "drop_missing": lambda df, c, _: steps.drop_missing(df, c.get("columns"), c.get("how", "any"), c.get("thresh")),
    "fill_missing": lambda df, c, _: fill_missing(
        df, c.get("column"), c.get("method", "auto"), c.get("value", ""), c.get("partition_by")
    ),
    "rename_column": lambda df, c, _: steps.rename_columns(df, c.get("mappings") or {}),
    "change_dtype": lambda df, c, _: steps.change_dtype(df, _need(c, "column"), _need(c, "dtype"), c.get("truthy", False)),
    "filter_rows": lambda df, c, _: steps.filter_rows(
        df, c.get("column"), c.get("operator", "=="), c.get("value"), c.get("literal", False)
    ),
    "select_columns": lambda df, c, _: steps.select_columns(df, c.get("columns") or []),
    "sort_values": lambda df, c, _: steps.sort_values(df, c.get("columns") or [], c.get("ascending", True)),
    "remove_duplicates": lambda df, c, _: steps.remove_duplicates(df, c.get("columns"), c.get("keep", "first")),
    "add_computed_column": lambda df, c, _: steps.computed_column(
        df, c.get("new_column"), c.get("operation", "add"), c.get("col_a"), c.get("col_b"), c.get("constant_value")
    ),
    "join": _join,
    "group_aggregate": lambda df, c, _: steps.group_aggregate(
        df, c.get("group_by") or [], c.get("aggregations") or {}, c.get("keep_null_keys", False), c.get("null_sum", False)
    ),
}


# Steps that work on the texts of mixed cells, which keep their types.
ON_TEXTS = ("drop_missing", "fill_missing", "change_dtype", "filter_rows", "remove_duplicates", "add_computed_column")


def _need(config: dict, key: str):
    if not config.get(key):
        raise ValueError(f"the step needs {key!r}")
    return config[key]


def _needs_order(step: Step) -> bool:
    c = step.config
    return (
        (step.step_type == "fill_missing" and c.get("method") in ("ffill", "bfill"))
        or (step.step_type == "remove_duplicates" and bool(c.get("columns")))
        or (step.step_type == "group_aggregate" and any(h in ("first", "last") for h in (c.get("aggregations") or {}).values()))
    )


def _order_after(step: Step) -> Callable[[DataFrame], list] | None:
    """How to order the rows anew after a step that changed their order or number."""
    c = step.config
    if step.step_type == "sort_values":
        return lambda d: steps.sort_order(d, c["columns"], c.get("ascending", True))
    if step.step_type == "group_aggregate":
        return lambda d: [quoted(k).asc() for k in c["group_by"]]
    if step.step_type == "join":
        keys = [c["on"]] if isinstance(c["on"], str) else list(c["on"])
        return lambda d: [quoted(k).asc_nulls_last() for k in [ROW_ID] * (ROW_ID in d.columns) + [*keys, RIGHT_ID]]
    return None


def apply_step(df: DataFrame, step: Step, lookup: Lookup | None = None, stages: list | None = None) -> DataFrame:
    """The table after one step. Config errors are raised before any job starts.

    The cleaners hold a stage for their jobs: their results are added to ``stages``, and
    ``release()`` of each frees it once the table is written.
    """
    if step.step_type not in STEPS:
        raise ValueError(f"unknown step type {step.step_type!r}; use one of {sorted(STEPS)}")
    if step.step_type in CLEANERS:
        cleaned = CLEANERS[step.step_type](df, step.config)
        if stages is not None:
            stages.append(cleaned)
        return cleaned.df
    if step.step_type in ON_TEXTS:
        retyped = (step.config["column"],) if step.step_type == "change_dtype" and step.config.get("column") else ()
        return cells.typed(df, lambda d: STEPS[step.step_type](d, step.config, lookup), retyped)
    return STEPS[step.step_type](df, step.config, lookup)


def build(df: DataFrame, plan: list[Step], lookup: Lookup | None = None, stages: list | None = None) -> DataFrame:
    """All enabled steps as one plan without reports (the export path).

    Rows are numbered anew right after a sort, a join or a grouping if a later step depends
    on the order, if a second join follows, or after a last sort, so that previews and
    ordered exports show the new order. Otherwise the plan stays lazy. Cleaners add what they
    hold to ``stages``.
    """
    active = [s for s in plan if s.enabled]
    for i, step in enumerate(active):
        df = apply_step(df, step, lookup, stages)
        df = renumbered(df, step, active[i + 1 :])
    return df.drop(RIGHT_ID)


def renumbered(df: DataFrame, step: Step, later: list[Step], always: bool = False) -> DataFrame:
    """The rows numbered in the order that the step gave them, if anything depends on it."""
    order = _order_after(step)
    if order is None or not (ROW_ID in df.columns or step.step_type == "group_aggregate"):
        return df
    shown = step.step_type == "sort_values" and not any(_order_after(s) for s in later)
    joined_again = RIGHT_ID in df.columns and any(s.step_type == "join" for s in later)
    if always or shown or joined_again or any(_needs_order(s) for s in later):
        return number_rows(df, order(df))
    return df


# --- runs with reports ----------------------------------------------------------------------
AFFECTED_ALL = ("auto_clean", "smart_clean", "drop_missing", "remove_duplicates", "join", "group_aggregate")


def affected_columns(step: Step, df: DataFrame) -> list[str]:
    """Columns a step works on."""
    c, every = step.config, data_columns(df)
    if step.step_type in AFFECTED_ALL:
        return every
    if step.step_type == "rename_column":
        return [n for n in (c.get("mappings") or {}) if n in every]
    if step.step_type == "add_computed_column":
        names = [c.get(k) for k in ("col_a", "col_b") if c.get(k) in every]
        return names + ([c["new_column"]] if c.get("new_column") else []) or every
    if step.step_type in ("select_columns", "sort_values"):
        return [n for n in c.get("columns") or every if n in every] or every
    return [c["column"]] if c.get("column") in every else every


@dataclass
class StepReport:
    """Reports of one step. All are DataFrames; jobs run when they are read."""

    step_index: int
    name: str
    step_type: str
    df: DataFrame
    stats: DataFrame | None = None
    diff: anomalies_.Diff | None = None
    anomalies: DataFrame | None = None
    explanations: DataFrame | None = None
    issues_before: DataFrame | None = None
    issues_after: DataFrame | None = None
    issues_fixed: int = 0
    table_issues: DataFrame | None = None
    audit: DataFrame | None = None
    score: DataFrame | None = None
    schema: DataFrame | None = None
    errors: list[str] = field(default_factory=list)


@dataclass
class Run:
    run_id: str
    status: str
    reports: list[StepReport]
    error: str | None = None
    cause: Exception | None = None
    started_at: datetime | None = None
    finished_at: datetime | None = None
    held: list[DataFrame] = field(default_factory=list)
    stages: list = field(default_factory=list)

    def keep(self, held: list[DataFrame], current: DataFrame) -> None:
        """Free the tables before the last two versions."""
        versions = [r.df for r in self.reports[-2:]]
        for df in [d for d in held[:-4] if d is not current and not any(d is v for v in versions)]:
            held.remove(df)
            df.unpersist()

    def release(self) -> None:
        """Free all tables that the run still holds; reports that were not read yet run anew."""
        for df in self.held:
            df.unpersist()
        for stage in self.stages:
            stage.release()
        self.held, self.stages = [], []

    @property
    def result(self) -> DataFrame:
        return self.reports[-1].df

    def anomalies(self) -> DataFrame | None:
        """Anomalies of all steps with their step index."""
        parts = [
            r.anomalies.select(F.lit(r.step_index).cast("bigint").alias("step_index"), F.lit(r.name).alias("step_name"), "*")
            for r in self.reports if r.anomalies is not None
        ]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def row_trend(self) -> DataFrame:
        """Row count per step with the change against the step before."""
        counts = None
        for r in self.reports:
            one = r.df.agg(F.count("*").alias("row_count")).select(
                F.lit(self.run_id).alias("run_id"), F.lit(r.step_index).cast("bigint").alias("step_index"),
                F.lit(r.name).alias("step_name"), "row_count",
            )
            counts = one if counts is None else counts.unionByName(one)
        return step_trend(counts)


def step_trend(counts: DataFrame) -> DataFrame:
    """Row deltas from one step to the next inside each run (a few rows per run)."""
    from pyspark.sql import Window as W

    prior = F.lag("row_count").over(W.partitionBy("run_id").orderBy("step_index"))
    return counts.withColumn("row_delta", F.col("row_count") - prior).withColumn(
        "row_delta_pct", F.round(F.try_divide((F.col("row_count") - prior).cast("double"), prior.cast("double")) * 100, 2)
    )


def run_steps(
    df: DataFrame,
    plan: list[Step],
    lookup: Lookup | None = None,
    report: str = "full",
    limits: anomalies_.Thresholds = anomalies_.Thresholds(),
    checkpoint_every: int | None = None,
    on_step: Callable[[Run, StepReport], None] | None = None,
) -> Run:
    """Run the enabled steps and report on the source and on every step.

    ``report`` is ``"counts"`` (rows, nulls, drift), ``"diff"`` (plus values and
    distributions) or ``"full"`` (plus issues, audit and score). Each version is
    kept for the comparison with the next one and released after that. The profile
    after a step is reused as the profile before the next. A failing step ends the
    run; the reports made so far remain. ``on_step`` gets each report while its
    tables are still held, e.g. to write a snapshot.
    """
    run = Run(uuid.uuid4().hex[:12], "running", [], started_at=datetime.now(timezone.utc))
    current = hold(df)
    source = StepReport(0, "Source Dataset", "source", current)
    run.reports.append(source)
    held: list[DataFrame] = [current]
    known = totals = mark = None
    try:
        if report == "full":
            known = _know(current)
            source.stats = facts_.column_stats(current, held=known[0].held, unique=known[0].unique)
        if on_step:
            on_step(run, source)
        active = [s for s in plan if s.enabled]
        for index, step in enumerate(active, start=1):
            before = current
            auto: AutoResult | SmartResult | None = None
            if step.step_type in CLEANERS:
                auto = CLEANERS[step.step_type](before, step.config)
                current = auto.df
            else:
                current = apply_step(before, step, lookup)
            raw = current = hold(current)  # with the ids of the table before, for the audit
            held.append(raw)
            current = renumbered(current, step, active[index:], always=ROW_ID in current.columns)
            if current is not raw:
                current = hold(current)
                held.append(current)
            elif checkpoint_every and index % checkpoint_every == 0:
                current = hold(checkpointed(current))
                held.append(current)
            made = StepReport(index, step.name or step.step_type, step.step_type, current)
            kept, fresh = kept_columns(step, before, current), None
            if report == "full":
                fresh = _know_after(made, current, known, kept)
            fresh_mark = _mark(current) if fresh is None else None
            same = step.step_type == "sort_values" or fresh_mark is not None and fresh_mark == mark
            evidence = (known[0], fresh[0]) if known and fresh else None
            made.diff = anomalies_.compute_diff(before, current, report != "counts", totals, same and totals is not None, evidence, kept)
            totals, mark = anomalies_.totals_after(made.diff), fresh_mark
            made.anomalies = settled(anomalies_.detect_anomalies(made.diff, made.name, limits))
            if auto:
                made.explanations = auto.explanations()
            else:
                why = _causes(before, step, lookup) if not made.anomalies.isEmpty() else None
                made.explanations = anomalies_.explain_anomalies(made.anomalies, step.step_type, made.diff, step.config, why)
            if isinstance(auto, AutoResult):
                made.table_issues = issues.issue_table(current.sparkSession, auto.table_issues())
            if report == "full":
                known = _enrich(made, step, before, current, known, fresh, raw, run.reports[-1].stats, kept)
            run.reports.append(made)
            if on_step:
                on_step(run, made)
            run.keep(held, current)
            if auto:
                run.stages.append(auto)
        run.status = "success"
    except Exception as error:
        run.status, run.error, run.cause = "failed", str(error) or repr(error), error
    run.held = held
    run.finished_at = datetime.now(timezone.utc)
    return run


def _causes(before: DataFrame, step: Step, lookup: Lookup | None) -> DataFrame:
    """Which rows the step treated how, counted while the version before it is still held."""
    right = step.config.get("right_dataset") or step.config.get("right_dataset_path")
    if right is not None and not isinstance(right, DataFrame):
        right = lookup(right) if lookup else None
    return settled(causes.step_causes(before, step.step_type, step.config, right))


def _mark(df: DataFrame) -> tuple | None:
    """Digest of a large version's rows, which spares a pass over copies where nothing changed;
    none for columns that cannot be hashed."""
    size = estimated_bytes(df)
    if size is not None and size <= MARKED_BYTES:
        return None
    try:
        return table_digest(df)
    except ValueError:
        return None


MARKED_BYTES = 1 << 30


class _Noted(Exception):
    """What went wrong stands in the report already."""


_Known = tuple[issues.Evidence, list[issues.Issue]]


def kept_columns(step: Step, before: DataFrame, after: DataFrame) -> tuple[str, ...]:
    """Columns that hold the same cells before and after a step that keeps all rows."""
    if step.step_type not in ("sort_values", "select_columns", "add_computed_column") or cells.mixed_columns(before) or cells.mixed_columns(after):
        return ()
    new = step.config.get("new_column") if step.step_type == "add_computed_column" else None
    was = data_columns(before)
    return tuple(c for c in data_columns(after) if c in was and c != new)


def _know(df: DataFrame, known: _Known | None = None, kept: tuple[str, ...] = ()) -> _Known:
    found = issues.gather(df, known=known[0] if known else None, kept=kept)
    return found, issues.layer_issues(df, found)


def _know_after(made: StepReport, after: DataFrame, known: _Known | None, kept: tuple[str, ...]) -> _Known | None:
    """What is found after a step; an error is noted. Rows in another order are the same rows."""
    try:
        return known if known and made.step_type == "sort_values" and set(kept) == set(known[0].held) else _know(after, known, kept)
    except Exception as error:
        made.errors.append(f"issues: {error}")
        return None


def _enrich(
    made: StepReport, step: Step, before: DataFrame, after: DataFrame, known: _Known | None, fresh: _Known | None, raw: DataFrame,
    stats: DataFrame | None, kept: tuple[str, ...],
) -> _Known | None:
    """Issues before and after, cell audit, score and schema; errors are noted.

    Returns what was found after the step, which is what the next step starts from.
    """
    spark = after.sparkSession
    try:
        if fresh is None:  # noted already
            raise _Noted
        known = known or _know(before)
        old, new = known[1], fresh[1]
        middle = {r["column"]: r["median"] for r in stats.collect() if r["column"] in kept} if stats is not None else {}
        made.stats = facts_.column_stats(after, held=fresh[0].held, unique=fresh[0].unique, middle=middle)
        made.issues_before, made.issues_after = issues.issue_table(spark, old), issues.issue_table(spark, new)
        made.issues_fixed = max(0, len(old) - len(new))
        made.schema = infer.schema_table(spark, infer.semantic_schema(known[0].held))
        mixed = cells.mixed_columns(before) + cells.mixed_columns(after)
        counted = (None, None) if mixed else tuple((found.rows, found.null_cells) for found, _ in (known, fresh))
        made.score = settled(score.quality_pair(before, after, made.issues_before, made.issues_after, counted))
    except _Noted:
        pass
    except Exception as error:
        made.errors.append(f"issues: {error}")
    if ROW_ID in before.columns and ROW_ID in raw.columns:
        made.audit = audit_.audit_cells(before, raw, affected_columns(step, before), step.step_type)
    else:
        made.errors.append("audit: the step changes what a row is")
    return fresh


def load_steps(spark: SparkSession, path: str) -> list[Step]:
    """Steps from a JSON-lines file, in file order."""
    rows = spark.read.text(path).select("value").filter(F.trim("value") != "").collect()
    return [Step.from_json(r["value"]) for r in rows]
