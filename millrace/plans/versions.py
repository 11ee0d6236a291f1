"""Stored versions of a table, so that an edited pipeline runs from its first change on.

Every version is named by a digest of the source and of the steps that made it. A plan that was
edited, cut short, made longer or whose last steps were reordered finds the longest run of steps
that is already stored and computes only what follows. Names and ids of steps play no part.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .runner import Lookup, Step, apply_step, renumbered


def _written_plan(df: DataFrame):
    """The optimised plan of a table as it was written, also where parts of it are held in memory."""
    execution = df._jdf.queryExecution()
    return execution.sparkSession().sessionState().optimizer().execute(execution.analyzed().clone())


def _files(plan) -> list[str]:
    """Names of the files that a plan reads."""
    names, leaves = set(), plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and hasattr(leaf.relation(), "inputFiles"):
            names.update(leaf.relation().inputFiles())
        elif kind == "DataSourceV2ScanRelation" and hasattr(leaf.relation().table(), "fileIndex"):
            names.update(leaf.relation().table().fileIndex().inputFiles())
    return sorted(names)


def source_digest(df: DataFrame) -> str:
    """Digest of a table that is read from files: its plan, and name, size and time of each file.

    It is the same whether or not the table, or a part of it, is held in memory. A table that is
    not read from files has no such digest; name it with a key of its own."""
    context, plan = df.sparkSession.sparkContext, _written_plan(df)
    names = _files(plan)
    if not names:
        raise ValueError("the table is not read from files: give source_key")
    conf, parts = context._jsc.hadoopConfiguration(), [plan.canonicalized().toString()]
    for name in names:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def step_digest(before: str, step: Step, lookup: Lookup | None = None) -> str:
    """Digest of the version that a step makes of the version ``before``."""
    config = dict(step.config)
    for key in ("right_dataset", "right_dataset_path"):
        if config.get(key) is not None:
            right = config[key] if isinstance(config[key], DataFrame) else lookup(config[key]) if lookup else None
            config[key] = source_digest(right) if right is not None else config[key]
    return hashlib.sha256(json.dumps([before, step.step_type, config], sort_keys=True, default=str).encode()).hexdigest()


class Versions:
    """Versions under one folder, each a Parquet table that counts once it is complete."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, digest: str) -> str:
        return f"{self.folder}/{digest}"

    def has(self, digest: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(digest)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def load(self, digest: str) -> DataFrame:
        return self.spark.read.parquet(self._path(digest))

    def save(self, df: DataFrame, digest: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(digest))
        return self.load(digest)


@dataclass
class VersionedRun:
    """The last version, the digest of every version from the source on, and what was done for it."""

    df: DataFrame
    digests: list[str]
    computed: list[int] = field(default_factory=list)
    reused: list[int] = field(default_factory=list)


def run_versioned(
    df: DataFrame, plan: list[Step], versions: Versions, lookup: Lookup | None = None, source_key: str | None = None
) -> VersionedRun:
    """The table after all enabled steps; versions that are stored already are not made again."""
    active = [s for s in plan if s.enabled]
    digests = [hashlib.sha256(source_key.encode()).hexdigest() if source_key else source_digest(df)]
    for step in active:
        digests.append(step_digest(digests[-1], step, lookup))
    start = max((i for i in range(1, len(digests)) if versions.has(digests[i])), default=0)
    run = VersionedRun(versions.load(digests[start]) if start else df, digests, reused=list(range(1, start + 1)))
    for index in range(start + 1, len(digests)):
        step, stages = active[index - 1], []
        # always numbered: what a later edit depends on is not known yet
        made = renumbered(apply_step(run.df, step, lookup, stages), step, active[index:], always=True)
        run.df = versions.save(made, digests[index])
        run.computed.append(index)
        for stage in stages:
            stage.release()
    return run
