"""Digests of fixed length that stand for long texts and wide rows in a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rows import data_columns, dtype_of, quoted

LONG = 32  # bytes; a longer text is named by a digest, which has one character more


def short_key(text: Column) -> Column:
    """A text of up to LONG bytes itself, else a digest of it: equal for equal texts only."""
    return F.when(F.octet_length(text) > LONG, F.concat(F.lit("#"), F.md5(text))).otherwise(text)


def check(text: Column) -> Column:
    """A second, independent digest of long texts. Grouped by both, texts whose first digests
    collide stay apart."""
    return F.when(F.octet_length(text) > LONG, F.xxhash64(text)).otherwise(F.lit(0).cast("bigint"))


def hashable(dt: T.DataType) -> bool:
    if isinstance(dt, T.ArrayType):
        return hashable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(hashable(f.dataType) for f in dt.fields)
    return not isinstance(dt, (T.MapType, T.VariantType, T.UserDefinedType))


def row_key(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns to group by so that equal rows meet: the row itself if it is narrow, else 160 bits of
    it. NULLs do not enter a hash, so their places are hashed beside the values."""
    kinds = [dtype_of(df, c) for c in columns]
    narrow = len(columns) <= 4 and all(isinstance(k, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for k in kinds)
    if narrow or not all(map(hashable, kinds)):
        return [quoted(c) for c in columns]
    values = [quoted(c) for c in columns] + [quoted(c).isNull() for c in columns]
    return [F.xxhash64(F.lit(1), *values).alias("_d1"), F.xxhash64(F.lit(2), *values).alias("_d2"), F.hash(*values).alias("_d3")]


def table_digest(df: DataFrame) -> tuple:
    """Names and types of the columns, number of rows and a sum over all rows that tells tables with
    other rows apart. One aggregate without a shuffle; the order of rows plays no part."""
    columns = data_columns(df)
    kinds = tuple((c, dtype_of(df, c).simpleString()) for c in columns)
    if not all(hashable(dtype_of(df, c)) for c in columns):
        raise ValueError("a column of this table has no digest")
    values = [quoted(c) for c in columns] + [quoted(c).isNull() for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    return kinds, tuple(df.agg(F.count("*").alias("n"), *sums).first())
