"""Dataset registry and run history under one folder.

The tables of a snapshot are written under an attempt of their own and become visible by one
manifest record, a small file that is renamed into place. Readers take the last committed attempt
of a step, so a save that fails halfway shows nothing and a repeated save replaces itself.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import iso_text
from ..operators import facts as facts_
from ..rows import ROW_ID, data_columns, dtype_of, is_time, quoted
from . import scan

DATASETS = "name string, path string, format string, row_count bigint, col_count int, schema string, nulls string, registered_at timestamp"
RUNS = "run_id string, plan string, status string, error string, started_at timestamp, finished_at timestamp"
COMMITS = "run_id string, step_index int, step_name string, attempt string, tables array<string>, committed_at timestamp"


def read_any(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Read a table by format or file ending."""
    kind = format or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if kind in ("json", "jsonl", "ndjson"):
        return scan.read_json(spark, path)
    if kind == "csv":
        return scan.read_csv(spark, path)
    return scan.read_parquet(spark, path)


class Registry:
    """Names for tables, so that a join step finds its right side."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def register(self, name: str, path: str, format: str | None = None) -> DataFrame:
        """Scan a file, store its size, schema and null counts under a name."""
        df = scan.require_rows(read_any(self.spark, path, format))
        nulls = {r["column"]: r["null_count"] for r in facts_.null_counts(df).collect()}
        row = (
            name, path, format, df.count(), len(data_columns(df)),
            json.dumps({c: dtype_of(df, c).simpleString() for c in data_columns(df)}), json.dumps(nulls),
            datetime.now(timezone.utc),
        )
        self.spark.createDataFrame([row], DATASETS).coalesce(1).write.mode("append").parquet(f"{self.folder}/datasets")
        return df

    def datasets(self) -> DataFrame:
        """All registered tables, newest first."""
        return self._table("datasets", DATASETS).orderBy(F.desc("registered_at"), "name")

    def lookup(self, name: str) -> DataFrame:
        row = self.datasets().filter(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"right dataset not found: {name}")
        return read_any(self.spark, row["path"], row["format"])

    def _commit(self, kind: str, record: dict) -> None:
        """Make one record visible: written beside its place under a name that readers skip, then renamed."""
        context = self.spark.sparkContext
        path = lambda name: context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/{name}")
        name = f"{record['run_id']}-{uuid.uuid4().hex}.json"
        files = path(name).getFileSystem(context._jsc.hadoopConfiguration())
        out = files.create(path("_" + name))
        try:
            out.write(bytearray(json.dumps(record, default=str).encode()))
        finally:
            out.close()
        if not files.rename(path("_" + name), path(name)):
            raise OSError(f"could not commit {kind} of run {record['run_id']}")

    def _records(self, kind: str, schema: str, *key: str) -> DataFrame:
        """The last committed record of each key."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, saved_at timestamp, attempt_id string").json(f"{self.folder}/{kind}")
        last = W.partitionBy(*key).orderBy(F.desc("saved_at"), F.desc("attempt_id"))
        return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "saved_at", "attempt_id")

    def save_run(self, run, plan: list) -> None:
        """Add a run to the history; saved again, its record takes the place of the last one."""
        self._commit("runs", {
            "run_id": run.run_id, "plan": "\n".join(s.to_json() for s in plan), "status": run.status, "error": run.error,
            "started_at": _moment(run.started_at), "finished_at": _moment(run.finished_at), "saved_at": _now(), "attempt_id": uuid.uuid4().hex,
        })

    def runs(self) -> DataFrame:
        """Run history, newest first."""
        return self._records("runs", RUNS, "run_id").orderBy(F.desc("started_at"))

    def save_snapshot(self, run, report) -> None:
        """Store the reports of one step; pass as ``on_step`` to ``run_steps``."""
        tables = {
            "snapshots": report.df.agg(F.count("*").alias("row_count")).withColumn(
                "col_count", F.lit(len(data_columns(report.df)))
            ),
            "stats": report.stats,
            "nulls": facts_.null_counts(report.df),
            "samples": scan.preview(report.df).select(F.to_json(F.struct("*")).alias("row")),
            "anomalies": report.anomalies,
            "explanations": report.explanations,
            "diff_rows": report.diff.rows if report.diff else None,
            "diff_nulls": report.diff.nulls if report.diff else None,
            "diff_drift": report.diff.drift if report.diff else None,
            "issues": report.issues_after,
            "table_issues": report.table_issues,
            "audit": report.audit,
            "scores": report.score,
        }
        attempt, written = uuid.uuid4().hex, []
        for name, table in tables.items():
            if table is None:
                continue
            kind = report.step_type if name == "explanations" and report.step_type.endswith("_clean") else None
            name += f"_{kind}" if kind else ""
            (
                table.withColumn("run_id", F.lit(run.run_id))
                .withColumn("step_index", F.lit(report.step_index))
                .withColumn("step_name", F.lit(report.name))
                .write.parquet(f"{self.folder}/attempts/{attempt}/{name}")
            )
            written.append(name)
        self._commit("commits", {
            "run_id": run.run_id, "step_index": report.step_index, "step_name": report.name, "attempt": attempt,
            "tables": written, "committed_at": _now(), "saved_at": _now(), "attempt_id": attempt,
        })

    def commits(self, run_id: str | None = None) -> DataFrame:
        """The snapshot that counts for each step of a run, or of all runs."""
        every = self._records("commits", COMMITS, "run_id", "step_index")
        return every if run_id is None else every.filter(F.col("run_id") == run_id)

    def snapshots(self, run_id: str, table: str = "snapshots") -> DataFrame:
        """One stored report of a run in step order; only its committed attempts are read."""
        found = self.commits(run_id).filter(F.array_contains("tables", table)).select("attempt").collect()
        if not found:
            raise ValueError(f"run {run_id!r} has no stored {table}")
        return self.spark.read.parquet(*[f"{self.folder}/attempts/{r['attempt']}/{table}" for r in found]).orderBy("step_index")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def _moment(at: datetime | None) -> str | None:
    return None if at is None else at.astimezone(timezone.utc).isoformat(timespec="microseconds")


# --- sinks ---------------------------------------------------------------------------------
def with_date_text(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ``YYYY-MM-DD`` text, without the row id."""
    return df.select(
        *[(iso_text(quoted(c)) if is_time(dtype_of(df, c)) else quoted(c)).alias(c) for c in data_columns(df)]
    )


def export(df: DataFrame, path: str, format: str = "csv", ordered: bool = False) -> None:
    """Write the result as CSV (with header) or Parquet, in many files at once.

    ``ordered`` sorts by row id first; the order runs on from file to file.
    """
    if ordered and ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    writer = with_date_text(df).write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).csv(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("format must be csv or parquet")


def export_anomalies(run, path: str) -> None:
    """One JSON record per step: row and column counts, anomalies, explanations. Steps
    without any are there too."""
    out = None
    for r in run.reports:
        one = r.df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(r.step_index).cast("bigint").alias("step_index"), F.lit(r.name).alias("step_name"), F.lit(r.step_type).alias("step_type"),
            "row_count", F.lit(len(data_columns(r.df))).alias("col_count"),
        )
        out = one if out is None else out.unionByName(one)
    why = None
    for r in run.reports:
        if r.explanations is not None and "anomaly_type" in r.explanations.columns:
            one = r.explanations.withColumn("step_index", F.lit(r.step_index).cast("bigint"))
            why = one if why is None else why.unionByName(one)
    found = run.anomalies()
    for table, name, columns in (
        (found, "anomalies", ("type", "severity", "column", "value", "threshold", "message")),
        (why, "explanations", ("anomaly_type", "column", "summary", "likely_cause", "confidence", "recommended_checks", "suggested_fix")),
    ):
        if table is not None:
            out = out.join(table.groupBy("step_index").agg(F.collect_list(F.struct(*columns)).alias(name)), "step_index", "left")
    out.orderBy("step_index").coalesce(1).write.mode("overwrite").json(path)
