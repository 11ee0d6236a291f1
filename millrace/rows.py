"""Row identity and small helpers shared by all operators.

``_row_id`` (BIGINT) is the row order. It is set once at the scan and carried
through every step, so first/last, fills and audits never depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .session import checkpointed

ROW_ID = "_row_id"
# After a join the row ids are those of the left table and may repeat; the right table's ids
# stand beside them until the rows are numbered anew.
RIGHT_ID = "_right_row_id"
# Kinds of the cells of a mixed column, beside the column of their texts (operators/cells.py).
KIND = "_kind_of_"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_ID, RIGHT_ID) and not c.startswith(KIND)]


def kind_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The kinds that tell cells with equal texts in these columns apart."""
    return [KIND + c for c in names if KIND + c in df.columns]


def quoted(name: str) -> Column:
    """Column by exact name, also when it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add ``_row_id`` from an existing unique key, or from the scan position."""
    if ROW_ID in df.columns:
        return df
    return df.withColumn(ROW_ID, quoted(key).cast("bigint") if key else F.monotonically_increasing_id())


def require_row_id(df: DataFrame, what: str) -> None:
    if ROW_ID not in df.columns:
        raise ValueError(f"{what} depends on row order: add {ROW_ID} with with_row_id() or number_rows()")


def require_columns(df: DataFrame, names: list[str], what: str = "Columns") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} not found: {missing}")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(dt: T.DataType) -> bool:
    """Numbers and booleans: both have means in the reports."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_time(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def as_double(df: DataFrame, name: str) -> Column:
    c, dt = quoted(name), dtype_of(df, name)
    return c.cast("int").cast("double") if isinstance(dt, T.BooleanType) else c.cast("double")


def together(*works: Callable[[], Any]) -> list:
    """Run independent jobs at the same time from driver threads; results in order."""
    if len(works) == 1:
        return [works[0]()]
    spark = SparkSession.getActiveSession()
    with ThreadPoolExecutor(max_workers=len(works)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in works]]


def local_table(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A small table held by the driver. Built from Arrow, it is part of the plan
    itself, so projections and filters on it run without a job."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*data)) or [()] * len(arrow)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=struct)


def settled(df: DataFrame) -> DataFrame:
    """A small report as a local table, so that reading it twice runs no job twice.

    Only for reports with a few rows per column of the schema.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def estimated_bytes(df: DataFrame) -> int | None:
    """Size estimate of the optimised plan, None where it is not available."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # e.g. Spark Connect
        return None


def hold(df: DataFrame) -> DataFrame:
    """Keep a stage that several jobs read, in memory and on disk.

    The costly text work then runs once, and filters on its results are not copied
    back into it. Lost blocks are computed again from the lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def number_rows(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """Sort and give rows the positions 0..n-1 as a new ``_row_id``.

    The sorted rows are checkpointed, so partition i is always the same file.
    Only one count per partition reaches the running sum.
    """
    ordered = checkpointed(df.orderBy(*order_by))
    place = ordered.withColumn("_part", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = {r["_part"]: r["n"] for r in place.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append((part, total))
        total += counts.get(part, 0)
    offsets = local_table(df.sparkSession, starts, "_part int, _start bigint")
    return (
        place.join(F.broadcast(offsets), "_part")
        .withColumn(ROW_ID, F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_start", RIGHT_ID)
    )
