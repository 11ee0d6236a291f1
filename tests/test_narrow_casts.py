"""Casts that only fitting texts reach."""

from pyspark.sql import functions as F

from millrace.sources import scan


def test_whole_numbers_at_the_bounds(spark):
    cells = {
        "a": ("9223372036854775807", "bigint"), "b": ("9223372036854775808", "decimal(38,0)"), "c": ("-9223372036854775808", "bigint"),
        "d": ("-9223372036854775809", "decimal(38,0)"), "e": ("0" * 45 + "12", "bigint"), "f": ("9" * 38, "decimal(38,0)"), "g": ("1" + "0" * 38, "string"),
    }
    df = spark.createDataFrame([tuple(t for t, _ in cells.values()), ("1",) * len(cells)], ", ".join(f"{c} string" for c in cells))
    assert dict(scan.narrow_types(df).dtypes) == {c: kind for c, (_, kind) in cells.items()}


def test_texts_that_do_not_fit_are_not_cast(spark):
    """A cast that fails makes an error with its trace for every cell."""
    assert [bool(t) for t in spark.createDataFrame([("x",), ("1.5",), ("9" * 39,)], "t string").select(F.col("t").rlike(scan.WIDE_INTEGER).alias("t")).toPandas()["t"]] == [False] * 3
