"""Places in a global order, found without a task that holds the whole order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row among those of its group in this range; rows come sorted by group."""
    part, group, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        start = []
        for g, n in zip(batch.column("grp").to_pylist(), batch.column("copies").to_pylist()):
            if g != group:
                group, at = g, 0
            start.append(at)
            at += n
        names = [*batch.schema.names, "part", "start"]
        columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(start, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Give the nodes of each ``grp`` their first place in the order and the group's total.

    No task holds a group: ranges are numbered by themselves and moved by the sums before them."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    ranges = stored(ranged.mapInArrow(_numbered, schema + ", part int, start bigint"))
    sizes = ranges.groupBy("grp", "part").agg(F.sum("copies").alias("n"))
    along = Window.partitionBy("grp").orderBy("part")  # a row per range of a group
    before = sizes.select("grp", "part", (F.sum("n").over(along) - F.col("n")).alias("before"))
    totals = sizes.groupBy("grp").agg(F.sum("n").alias("total"))
    moved = ranges.join(before, ["grp", "part"]).join(totals, "grp")
    return moved.withColumn("pos", F.col("start") + F.col("before")).drop("part", "start", "before")
