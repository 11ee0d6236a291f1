"""Run a list of steps on every micro-batch and report on the batch.

The batch operators are reused unchanged: a micro-batch is an ordinary DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.facts import NUMBERS, column_facts, data_columns
from ..plans.runner import Lookup, Step, build
from ..rows import with_row_id


def watch(
    stream: DataFrame,
    plan: list[Step],
    write: Callable[[DataFrame, DataFrame, int], None],
    key: str | None = None,
    lookup: Lookup | None = None,
) -> DataStreamWriter:
    """A writer that hands ``(result, facts, batch_id)`` of each batch to ``write``.

    ``facts`` has one row per column. Writing under the batch id makes a repeated
    batch replace itself, so the sink stays exact after a restart.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = with_row_id(batch, key).persist()
        stages: list = []
        try:
            result = build(rows, plan, lookup, stages)
            facts = column_facts(result, data_columns(result), frozenset({NUMBERS}))
            write(result, facts.withColumn("batch_id", F.lit(batch_id)), batch_id)
        finally:
            for stage in stages:
                stage.release()
            rows.unpersist()

    return stream.writeStream.foreachBatch(handle)
