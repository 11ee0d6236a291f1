"""Columns whose cells mix types, as a text beside the kind of each cell.

A VARIANT column cannot be grouped, sorted or searched. ``split`` turns it into a text column
that all operators work on and a column ``_kind_of_<name>`` that travels with it like the row
id; ``joined`` makes typed cells of the two again. So `1`, `"1"` and `true` stay apart through
a cleaner, and a cell that it leaves alone comes back as it was.

Defined results: a JSON null is a missing cell; a string stays a string whatever it reads as;
any other cell whose new text does not fit its kind, and a filled cell, gets the type that the
text reads as (number, boolean, else string). A column that got one type for all cells keeps it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rows import KIND, kind_columns, quoted

SIMPLE = {
    "BIGINT": "int", "INT": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "double", "FLOAT": "double",
    "BOOLEAN": "boolean", "STRING": "string", "DATE": "date", "TIMESTAMP": "timestamp", "TIMESTAMP_NTZ": "timestamp_ntz",
}
CASTS = {"int": "bigint", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp_ntz"}


def mixed_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)]


def cell_kind(cell: Column) -> Column:
    """The kind of a VARIANT cell, NULL for a missing one."""
    tag = F.schema_of_variant(cell)
    names = F.create_map(*[F.lit(x) for pair in SIMPLE.items() for x in pair])
    return (
        F.when(tag.isNull() | (tag == "VOID"), None).when(tag.startswith("DECIMAL"), "decimal")
        .when(tag.startswith("OBJECT") | tag.startswith("ARRAY"), "nested").otherwise(F.coalesce(names[tag], F.lit("other")))
    )


def cell_text(cell: Column) -> Column:
    return F.try_variant_get(cell, "$", "string")


def split(df: DataFrame) -> DataFrame:
    """Every VARIANT column as its text, with the kinds of its cells beside it."""
    mixed = mixed_columns(df)
    if not mixed:
        return df
    plain = [cell_text(quoted(c)).alias(c) if c in mixed else quoted(c) for c in df.columns if c not in [KIND + m for m in mixed]]
    return df.select(*plain, *[cell_kind(quoted(c)).alias(KIND + c) for c in mixed])


def _read(text: Column) -> Column:
    """A cell of the type that the text reads as."""
    read = F.try_parse_json(text)
    tag = F.schema_of_variant(read)
    return F.when(tag.isin("BIGINT", "DOUBLE", "BOOLEAN") | tag.startswith("DECIMAL"), read).otherwise(text.cast("variant"))


def _cell(text: Column, kind: Column) -> Column:
    out = F.when(kind == "string", text.cast("variant"))
    for name, dtype in CASTS.items():
        made = text.try_cast(dtype)
        out = out.when((kind == name) & made.isNotNull(), made.cast("variant"))
    parsed, whole = F.try_parse_json(text), text.try_cast("decimal(38,0)")
    is_whole = whole.isNotNull() & ~text.contains(".")
    out = out.when((kind == "decimal") & is_whole, whole.cast("variant")).when((kind == "nested") & parsed.isNotNull(), parsed)
    return out.otherwise(_read(text))


def joined(df: DataFrame, mixed: list[str]) -> DataFrame:
    """Typed cells of the text columns among ``mixed`` that still have kinds; the kinds go."""
    out = []
    for f in df.schema.fields:
        if f.name in [KIND + c for c in mixed]:
            continue
        typed = f.name in mixed and isinstance(f.dataType, T.StringType) and KIND + f.name in df.columns
        out.append(_cell(quoted(f.name), quoted(KIND + f.name)).alias(f.name) if typed else quoted(f.name))
    return df.select(*out)


def typed(df: DataFrame, work: Callable[[DataFrame], DataFrame], retyped: tuple[str, ...] = ()) -> DataFrame:
    """``work`` on the texts of mixed cells; columns in ``retyped`` stay as it left them."""
    mixed = mixed_columns(df)
    if not mixed:
        return work(df)
    return joined(work(split(df)).drop(*[KIND + c for c in retyped]), mixed)


__all__ = ["cell_kind", "cell_text", "joined", "kind_columns", "mixed_columns", "split", "typed"]
