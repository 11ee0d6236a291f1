"""Inputs, stored stages and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: dict[str, str] = {}
# Spark's setting (4.1) by which the shuffle files of a run go when it ends, not when the driver collects garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without the setting
    gets a temporary folder; on a cluster a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return _LOCAL_ROOT.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="millrace-llm-"))


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a stage as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never the stages before.
    So nothing reads the shuffle files of the stage again, and they go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/millrace-llm/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    tidy = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(_TIDY) if tidy is None else spark.conf.set(_TIDY, tidy)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored stage once all that is read from it has itself been stored."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that operators read; null texts are empty."""
    return df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def crc_of_id(name: str = "doc_id"):
    """crc32 of the id as text: decides which labelled rows may be learned from."""
    return F.crc32(F.col(name).cast("string"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small, so that a task holds few whole texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_groups(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text", rows: int = 256):
    """Group rows until their texts have ``limit`` bytes; a longer text is a group by itself.

    Yields lists of row dicts. Every row is in exactly one group."""
    held, size = [], 0
    for batch in slices(batches, rows):
        for row in batch.to_pylist():
            held.append(row)
            size += len(row[text])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held
