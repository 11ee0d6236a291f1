"""Scans: CSV with type narrowing, JSON files, JSON records, Parquet."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.numbers import finite, parse_number, parse_trimmed
from ..functions.text import trimmed
from ..rows import ROW_ID, data_columns, quoted, with_row_id


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN is the null of the tables this engine replaces; make it NULL."""
    return df.select(
        *[
            F.nanvl(quoted(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def _boolean(c: Column) -> Column:
    return F.when(c.isin("True", "TRUE", "true"), True).when(c.isin("False", "FALSE", "false"), False)


# Whole numbers that fit a BIGINT whatever their digits, and those that fit a DECIMAL(38,0).
SHORT_INTEGER = r"^[+-]?0*\d{1,18}$"
WIDE_INTEGER = r"^[+-]?0*\d{1,38}$"


def narrow_types(df: DataFrame, tokens: tuple[str, ...] = fixed.SCAN_NULL_TOKENS) -> DataFrame:
    """Turn text columns into BIGINT, DECIMAL, DOUBLE or BOOLEAN where every value fits.

    One aggregate counts the fits per column; the result is a plain projection.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != ROW_ID]
    if not names:
        return df
    cleared = {n: F.when(~quoted(n).isin(*tokens), quoted(n)) for n in names}
    # Each text is cleared and trimmed once. Casts that fail are slow, so texts are cast only where their shape says that they fit.
    texts = df.select(*[x for i, n in enumerate(names) for x in (cleared[n].alias(f"c{i}"), trimmed(cleared[n]).alias(f"t{i}"))])
    counts = []
    for i in range(len(names)):
        c, t = F.col(f"c{i}"), F.col(f"t{i}")
        wide = t.rlike(WIDE_INTEGER)
        long = F.when(t.rlike(SHORT_INTEGER), True).when(wide, t.try_cast("decimal(38,0)").between(-(1 << 63), (1 << 63) - 1))
        counts += [
            F.count(c).alias(f"n{i}"),
            F.count_if(t.rlike(fixed.INTEGER_SHAPE)).alias(f"s{i}"),
            F.count_if(long).alias(f"i{i}"),
            F.count_if(wide).alias(f"w{i}"),
            F.count(parse_trimmed(t)).alias(f"d{i}"),
            F.count(_boolean(c)).alias(f"b{i}"),
        ]
    row = texts.agg(*counts).first()
    out = []
    for f in df.schema.fields:
        if f.name not in names:
            out.append(quoted(f.name))
            continue
        i, c = names.index(f.name), cleared[f.name]
        n = row[f"n{i}"]
        if n and row[f"s{i}"] == n:  # whole numbers keep every digit: BIGINT, else DECIMAL, else text
            if row[f"i{i}"] == n:
                c = trimmed(c).cast("bigint")
            elif row[f"w{i}"] == n:
                c = trimmed(c).cast("decimal(38,0)")
        elif n and row[f"d{i}"] == n:
            c = parse_number(c)
        elif n and row[f"b{i}"] == n:
            c = _boolean(c)
        elif not n:
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


# A list of files up to this many rows is copied to every task, by name; a longer one by a digest of the name.
LISTED = 200_000
# Places of splits are counted in steps of this many bytes, or of the least split size if that is smaller.
STEP_BYTES = 1 << 20


def file_places(spark: SparkSession, path: str, step: int | None) -> DataFrame:
    """_file, _first: where each file begins in the order of names, counted in steps of ``step``
    bytes, or in files if ``step`` is None. Reads names and sizes, no content; the window holds
    one short row per file."""
    files = spark.read.format("binaryFile").load(path)
    files = files.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size")).distinct()
    steps = F.lit(1).cast("bigint") if step is None else F.floor(F.col("_size") / step) + 1
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    return files.select("_file", F.coalesce(F.sum(steps).over(before), F.lit(0)).alias("_first"))


def _placed(df: DataFrame, path: str, step: int | None, index: Column, bits: int) -> DataFrame:
    """Row ids from file names and places in the files: the place of the file or its split
    above, the row's place in it below. The order depends neither on how Spark packs files
    into tasks nor on where it splits them. The table itself is read once and not shuffled."""
    listing = file_places(df.sparkSession, path, step)
    name = F.col("_metadata.file_path")
    if len(df.inputFiles()) > LISTED:
        listing, name = listing.withColumn("_file", F.unhex(F.md5("_file"))), F.unhex(F.md5(name))
    begin = F.lit(0).cast("bigint") if step is None else F.floor(F.col("_metadata.file_block_start") / step)
    placed = df.select("*", name.alias("_file"), begin.alias("_begin"), index.alias("_index"))
    joined = placed.join(F.broadcast(listing), "_file")
    row_id = F.shiftleft((F.col("_first") + F.col("_begin")).cast("bigint"), bits) + F.col("_index")
    return joined.withColumn(ROW_ID, row_id).select(*map(quoted, df.columns), ROW_ID)


def _bytes_of(spark: SparkSession, key: str) -> int:
    """A size setting in bytes, which may carry a unit."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", spark.conf.get(key).lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.rstrip("b").rstrip("i")]


def split_step(spark: SparkSession) -> int:
    """At most the size of the smallest split that is not the last one of its file, so that two
    splits of a file never begin in the same step."""
    least = min(_bytes_of(spark, f"spark.sql.files.{key}") for key in ("maxPartitionBytes", "openCostInBytes"))
    return max(1, min(STEP_BYTES, least))


def _in_file_order(df: DataFrame, path: str) -> DataFrame:
    """Row ids of text files: splits in order of file name and offset, lines in order."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return _placed(df, path, split_step(df.sparkSession), place, 33)


def read_csv(
    spark: SparkSession,
    path: str,
    null_tokens: tuple[str, ...] = fixed.SCAN_NULL_TOKENS,
    narrow: bool = True,
    row_id: bool = True,
) -> DataFrame:
    """CSV with a header: all text first, then null tokens, then types."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    if row_id:
        df = _in_file_order(df, path)
    return narrow_types(df, null_tokens) if narrow else df


def holds_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line with content is a whole JSON record, whatever the file is called."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    if first is None:
        return True
    try:
        return isinstance(json.loads(first["value"]), dict)
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str, lines: bool | None = None, row_id: bool = True) -> DataFrame:
    """JSON lines, or files that hold an array or one record over several lines. The form is
    read from the content unless ``lines`` states it."""
    if lines is None:
        lines = holds_json_lines(spark, path)
    df = spark.read.option("multiLine", not lines).json(path)
    return clean_nan(_in_file_order(df, path) if row_id else df)


def read_parquet(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Parquet with a row id from a key, or from file order and row position."""
    df = spark.read.parquet(path)
    if key:
        return clean_nan(with_row_id(df, key))
    return clean_nan(_placed(df, path, None, F.col("_metadata.row_index"), 40))


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """In-memory records: union of the keys, missing keys NULL.

    Columns whose cells mix types become VARIANT, so every cell keeps its type.
    """
    if not records:
        raise ValueError("no records")
    names = list(dict.fromkeys(k for r in records for k in r))
    kinds = {n: {type(r[n]) for r in records if r.get(n) is not None} for n in names}
    simple = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    fields, as_json = [], set()
    for n in names:
        found = kinds[n]
        if found <= {int, float} and len(found) == 2:
            fields.append("double")
        elif len(found) <= 1 and found <= set(simple):
            fields.append(simple[next(iter(found))] if found else "string")
        else:
            fields.append("string")
            as_json.add(n)

    def cell(record, name, kind):
        v = record.get(name)
        if v is None:
            return None
        if name in as_json:
            return json.dumps(v)
        return float(v) if kind == "double" else v

    rows = [tuple([i] + [cell(r, n, k) for n, k in zip(names, fields)]) for i, r in enumerate(records)]
    schema = T.StructType(
        [T.StructField(ROW_ID, T.LongType())]
        + [T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(names, fields)]
    )
    df = spark.createDataFrame(rows, schema)
    for n in as_json:
        df = df.withColumn(n, F.parse_json(quoted(n)))
    return clean_nan(df)


def variant_to_text(df: DataFrame) -> DataFrame:
    """VARIANT columns as text, the form the cleaning operators work on."""
    if not any(isinstance(f.dataType, T.VariantType) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.try_variant_get(quoted(f.name), "$", "string").alias(f.name)
            if isinstance(f.dataType, T.VariantType)
            else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def require_rows(df: DataFrame) -> DataFrame:
    """Stop early on an empty table."""
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """First n rows by row order; NaN and infinities NULL, times as dates."""
    head = df.orderBy(ROW_ID).limit(n) if ROW_ID in df.columns else df.limit(n)
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite(c)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return head.select(*out)


__all__ = [
    "clean_nan", "data_columns", "from_records", "narrow_types", "preview", "read_csv", "read_json",
    "read_parquet", "require_rows", "variant_to_text",
]
