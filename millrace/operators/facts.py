"""Column facts: everything the detectors and cleaners need, in one aggregate.

The table is read as cells, ``(column, text, number)``, and grouped by column.
Partial sums shrink each task's output to one row per column before the shuffle,
so width does not blow up the plan and no column is too large for its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, fixed, numbers, text
from ..rows import as_double, data_columns, dtype_of, is_number, is_text, is_time, kind_columns, local_table, quoted, together
from . import cells, digests, stats

TEXT, WORDS, DATES, NUMBERS, BRACKET = "text", "words", "dates", "numbers", "bracket"
ALL = frozenset({TEXT, WORDS, DATES, NUMBERS, BRACKET})


def kind_of(df: DataFrame, name: str) -> str:
    dt = dtype_of(df, name)
    return "number" if is_number(dt) else "text" if is_text(dt) else "time" if is_time(dt) else "other"


def column_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, present, s, x)``: text cells fill ``s``, numbers fill ``x``."""
    nothing_s, nothing_x = F.lit(None).cast("string"), F.lit(None).cast("double")
    return stats.cells(
        df,
        columns,
        present=lambda c: quoted(c).isNotNull(),
        s=lambda c: quoted(c) if kind_of(df, c) == "text" else nothing_s,
        x=lambda c: as_double(df, c) if kind_of(df, c) == "number" else nothing_x,
    )


# Bytes up to which equal texts are brought together and judged once; longer ones are judged where they are.
SHARED_BYTES = 64


def _text_measures(long: DataFrame, parts: frozenset, n: F.Column) -> tuple[DataFrame, list]:
    """The cells ``(s, num)`` with what is derived once of each, and the aggregates over them; a cell stands for ``n`` equal ones."""
    s = F.col("s")
    t, low = F.col("t"), F.col("low")
    long = long.withColumn("t", text.trimmed(s))

    def hits_of(cond) -> F.Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0).cast("bigint"))

    derived = {}
    if TEXT in parts:
        signs = t.rlike(numbers.FORMATTED_SHAPE)
        derived["fnum"] = F.coalesce(F.col("num"), F.when(signs, numbers.parse_formatted_number(t)))
        derived["word"] = numbers.parse_number_words(s)
        derived["low"] = F.lower(t)
        derived["mail"] = t.contains("@")
        derived["len"] = F.length(s)
    if DATES in parts:
        derived["hits"] = dates.format_hits(s)
        derived["stamp"] = dates.parse_date_time(s)
    if derived:
        long = long.withColumns(derived)
    at = {f: i for i, f in enumerate(dates.ALL_FORMATS)}
    if DATES in parts:
        hits = F.col("hits")
        report = F.array(*[hits[at[f]] for f in fixed.REPORT_DATE_FORMATS])
        long = long.withColumns({
            "fmt": F.array_position(report, True),
            "is_day": F.array_contains(hits, True) | F.col("stamp").isNotNull(),
            "is_layer_day": F.array_contains(F.array(*[hits[at[f]] for f in fixed.LAYER_DATE_FORMATS]), True),
        })
    out = []
    if TEXT in parts:
        out += [
            hits_of(low.isin(*fixed.NULL_TOKENS)).alias("null_like"),
            hits_of(low.isin(*fixed.REPORT_NULL_TOKENS)).alias("null_like_wide"),
            hits_of(F.col("word").isNotNull()).alias("word_whole"),
            hits_of(text.has_currency(s)).alias("currency"),
            hits_of(s != t).alias("padded"),
            hits_of(F.col("fnum").isNotNull()).alias("fnum_count"),
            hits_of(s.isNotNull() & F.col("fnum").isNull() & F.col("word").isNull()).alias("leftover_text"),
            hits_of(F.col("fnum") < 0).alias("fnum_negative"),
            hits_of(F.col("fnum") > fixed.AGE_RANGE[1]).alias("fnum_over_age"),
            hits_of(F.col("fnum") > fixed.SCORE_RANGE[1]).alias("fnum_over_score"),
            hits_of(F.col("num").isNotNull() & t.rlike(fixed.INTEGER_SHAPE)).alias("int_like"),
            hits_of(low.isin("true", "false")).alias("bool_like"),
            hits_of(F.col("mail") & text.email_shaped(s)).alias("email_loose"),
            hits_of(F.col("mail") & text.email_shaped(s, strict=True)).alias("email_strict"),
            F.sum(F.col("len").cast("bigint") * n).alias("len_sum"),
            F.min("len").alias("len_min"),
            F.max("len").alias("len_max"),
        ]
    if WORDS in parts:
        out.append(hits_of(numbers.has_number_word(s)).alias("word_any"))
    if DATES in parts:
        layer = [F.col("hits")[at[f]] for f in fixed.LAYER_DATE_FORMATS]
        out += [
            hits_of(F.col("is_day")).alias("date_any"),
            hits_of(s.rlike(fixed.ISO_DATE_SHAPE)).alias("iso_shaped"),
            F.array(*[hits_of(F.col("fmt") == i + 1) for i in range(len(fixed.REPORT_DATE_FORMATS))]).alias("format_counts"),
            F.array(*[hits_of(h) for h in layer]).alias("layer_format_counts"),
            hits_of(F.col("is_layer_day")).alias("layer_date"),
        ]
    return long, out


def _added(one: DataFrame, other: DataFrame) -> DataFrame:
    """Counts of two sets of cells taken together, one row per column of ``one``."""

    def both(f: T.StructField) -> F.Column:
        a, b = F.col(f"one.{f.name}"), F.col(f"other.{f.name}")
        if f.name == "column" or f.name not in other.columns:
            return a
        if f.name in ("len_min", "len_max"):
            return (F.least if f.name == "len_min" else F.greatest)(a, b).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y)).alias(f.name)
        nothing = F.lit(0).cast("bigint")
        total = F.coalesce(a, nothing) + F.coalesce(b, nothing)
        return (F.when(a.isNotNull() | b.isNotNull(), total) if f.name == "len_sum" else total).alias(f.name)

    joined = one.alias("one").join(other.alias("other"), F.col("one.column") == F.col("other.column"), "left_outer")
    return joined.select(*[both(f) for f in one.schema.fields])


def column_facts(df: DataFrame, columns: list[str] | None = None, parts: frozenset = ALL) -> DataFrame:
    """One row of counts and statistics per column.

    ``parts`` selects the groups of measures; text shapes and date formats are the
    costly ones, so callers that only impute ask for numbers alone.
    """
    columns = data_columns(df) if columns is None else columns
    spark = df.sparkSession
    texts = [c for c in columns if kind_of(df, c) == "text"]
    shared = bool(texts) and bool(parts & {TEXT, WORDS, DATES})
    long = column_cells(df, columns)
    long = long.withColumn("number", F.coalesce(F.col("x"), numbers.parse_trimmed(text.trimmed(F.col("s")))))
    short = F.octet_length("s") <= SHARED_BYTES if shared else F.lit(False)
    lone = F.coalesce(~short, F.lit(True))
    long = long.withColumns({"s": F.when(lone, F.col("s")), "num": F.when(lone, F.col("number"))})
    num = F.col("number")
    out = [
        F.count("*").alias("row_count"),
        F.count_if(~F.col("present")).alias("null_count"),
        F.count("number").alias("num_count"),
    ]
    numeric: list = []
    if NUMBERS in parts:
        numeric = [
            F.min(num).alias("num_min"),
            F.max(num).alias("num_max"),
            F.avg(num).alias("num_mean"),
            F.stddev_samp(num).alias("num_std"),
            numbers.corrected_skewness(F.count(num), F.skewness(num)).alias("num_skew"),
            F.count_if(num < 0).alias("negative"),
            F.count_if(num > fixed.AGE_RANGE[1]).alias("over_age"),
            F.count_if(num > fixed.SCORE_RANGE[1]).alias("over_score"),
        ]
    made, measures = _text_measures(long, parts, F.lit(1).cast("bigint"))
    grouped = made.groupBy("column").agg(*out, *measures, *numeric)
    if shared and measures:
        # equal short texts of a column are judged once and count as often as they occur
        values = stats.cells(df, texts, s=lambda c: quoted(c)).filter(F.octet_length("s") <= SHARED_BYTES)
        values = values.groupBy("column", "s").agg(F.count("*").alias("n"))
        values = values.withColumn("num", numbers.parse_trimmed(text.trimmed(F.col("s"))))
        made, measures = _text_measures(values, parts, F.col("n"))
        grouped = _added(grouped, made.groupBy("column").agg(*measures))
    listing = local_table(spark, 
        [(i, c, kind_of(df, c), df.schema[c].dataType.simpleString()) for i, c in enumerate(columns)],
        "position int, column string, kind string, dtype string",
    )
    joined = listing.join(grouped, "column", "left_outer")
    return joined.fillna(0, subset=[f.name for f in grouped.schema.fields if f.dataType.simpleString() == "bigint"])


def collect_facts(facts: DataFrame) -> dict[str, dict]:
    """The facts on the driver: one small record per column."""
    return {r["column"]: r.asDict(recursive=True) for r in facts.orderBy("position").collect()}


def duplicate_count(df: DataFrame, columns: list[str] | None = None):
    """One row ``duplicate_rows``: rows beyond the first of each group of copies."""
    df = cells.split(df)
    columns = data_columns(df) if columns is None else columns
    columns = columns + kind_columns(df, columns)
    groups = df.groupBy(*digests.row_key(df, columns)).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = data_columns(df) if columns is None else columns
    long = stats.cells(df, columns, gone=lambda c: quoted(c).isNull().cast("bigint"))
    return long.groupBy("column").agg(F.sum("gone").alias("null_count"))


def table_totals(df: DataFrame) -> DataFrame:
    """Rows, columns, null cells and duplicate rows of a table, as one row."""
    df = cells.split(df)
    columns = data_columns(df)
    per_row = sum((quoted(c).isNull().cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    groups = df.groupBy(*digests.row_key(df, columns + kind_columns(df, columns))).agg(F.count("*").alias("_n"), F.sum(per_row).alias("_gone"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
        F.lit(len(columns)).cast("bigint").alias("cols"),
        F.coalesce(F.sum("_gone"), F.lit(0)).cast("bigint").alias("total_nulls"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def column_stats(
    df: DataFrame, columns: list[str] | None = None, held: dict[str, dict] | None = None, unique: dict[str, int] | None = None,
    middle: dict[str, float] | None = None,
) -> DataFrame:
    """Type, nulls, distinct values, and min/max/mean/std/median of number columns.

    ``held``, ``unique`` and ``middle`` are facts, distinct counts and medians that are known already.
    """
    columns = data_columns(df) if columns is None else columns
    if held is None or unique is None:
        held, unique = together(
            lambda: held or collect_facts(column_facts(df, columns, frozenset({NUMBERS, BRACKET}))),
            lambda: {r["column"]: r["unique_count"] for r in stats.distinct_counts(df, columns).collect()},
        )
    numeric = [c for c in columns if kind_of(df, c) == "number"]
    middle = middle or {}
    middle = {**middle, **stats.medians(df, held, [c for c in numeric if c not in middle], lambda c: as_double(df, c))}
    rows = [
        (
            c, held[c]["dtype"], held[c]["null_count"], unique.get(c, 0),
            *((held[c]["num_min"], held[c]["num_max"], held[c]["num_mean"], held[c]["num_std"], middle.get(c))
              if c in numeric else (None,) * 5),
        )
        for c in columns
    ]
    return local_table(df.sparkSession, 
        rows,
        "column string, dtype string, null_count bigint, unique_count bigint, min double, max double,"
        " mean double, std double, median double",
    )


_PROFILE_FACTS = {
    "column": "string", "kind": "string", "dtype": "string", "row_count": "bigint", "null_count": "bigint",
    "num_count": "bigint", "num_min": "double", "num_max": "double", "num_mean": "double", "num_std": "double",
    "negative": "bigint", "padded": "bigint", "len_min": "int", "len_max": "int", "currency": "bigint", "word_any": "bigint",
}


def column_profile(df: DataFrame, columns: list[str] | None = None, samples: int = 5) -> DataFrame:
    """Full profile: counts, null share, numbers, text lengths, hints and samples."""
    columns = data_columns(df) if columns is None else columns
    # Facts, distinct counts and samples are small; they are collected once and joined locally.
    held, unique, samples_of = together(
        lambda: collect_facts(column_facts(df, columns, frozenset({TEXT, WORDS, NUMBERS}))),
        lambda: stats.distinct_counts(df, columns).collect(),
        lambda: first_values(df, columns, samples).collect(),
    )
    middle = stats.medians(
        df, held, columns, lambda c: F.coalesce(
            as_double(df, c) if kind_of(df, c) == "number" else
            numbers.parse_number(quoted(c)) if kind_of(df, c) == "text" else F.lit(None).cast("double"),
            F.lit(None).cast("double"),
        )
    )
    middles = local_table(df.sparkSession, 
        [(c, middle.get(c)) for c in columns], "column string, num_median double"
    )
    spark = df.sparkSession
    small = lambda rows, schema: F.broadcast(local_table(spark, [tuple(r) for r in rows], schema))
    facts = local_table(spark, [tuple(held[c].get(n) for n in _PROFILE_FACTS) for c in columns], ", ".join(
        f"{n} {_PROFILE_FACTS[n]}" for n in _PROFILE_FACTS
    ))
    out = (
        facts.join(small(unique, "column string, unique_count bigint, unique_folded bigint"), "column", "left_outer")
        .join(F.broadcast(middles), "column", "left_outer")
        .join(small(samples_of, "column string, values array<string>"), "column", "left_outer")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    held_n = F.col("row_count") - F.col("null_count")
    is_text_kind = F.col("kind") == "text"
    number_dtype = F.col("dtype").isin("double", "float")
    has_numbers = F.col("num_count") > 0
    return out.select(
        "column", "dtype", "row_count", "null_count",
        F.coalesce(numbers.percent(F.col("null_count"), F.col("row_count")), F.lit(0.0)).alias("null_pct"),
        zero("unique_count").alias("unique_count"),
        F.create_map(
            F.lit("int"), F.when((F.col("kind") == "number") & ~number_dtype & (F.col("dtype") != "boolean"), held_n).otherwise(0),
            F.lit("float"), F.when(number_dtype, held_n).otherwise(0),
            F.lit("str"), F.when(is_text_kind, held_n).otherwise(0),
            F.lit("bool"), F.when(F.col("dtype") == "boolean", held_n).otherwise(0),
            F.lit("other"), F.when(F.col("kind").isin("time", "other"), held_n).otherwise(0),
        ).alias("type_counts"),
        F.when(has_numbers, F.struct(
            F.col("num_min").alias("min"), F.col("num_max").alias("max"), F.col("num_mean").alias("mean"),
            F.col("num_median").alias("median"), F.col("num_std").alias("std"), F.col("negative").alias("negative_count"),
        )).alias("numeric_stats"),
        F.struct(
            (F.col("padded") > 0).alias("has_padding"),
            (is_text_kind & (zero("unique_count") != zero("unique_folded"))).alias("has_mixed_case"),
            F.coalesce(F.col("len_max"), F.lit(0)).alias("max_length"),
            F.coalesce(F.col("len_min"), F.lit(0)).alias("min_length"),
        ).alias("string_stats"),
        (F.col("currency") > 0).alias("has_currency_symbols"),
        (F.col("word_any") > 0).alias("has_word_numbers"),
        F.coalesce(F.col("values"), F.array().cast("array<string>")).alias("sample_values"),
    )


def first_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The first k non-null values per column, by row order where there is one."""
    from pyspark.sql import Window as W

    from ..rows import ROW_ID

    order = quoted(ROW_ID) if ROW_ID in df.columns else F.lit(0)
    long = stats.cells(
        df, columns, at=lambda c: order.cast("bigint"), value=lambda c: quoted(c).cast("string")
    ).filter(F.col("value").isNotNull())
    ranked = long.withColumn("k", F.row_number().over(W.partitionBy("column").orderBy("at", "value")))
    few = ranked.filter(F.col("k") <= k)
    # At most k values per column are left.
    return few.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda v: v["value"]).alias("values"))


def cell_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How many cells of each column read as int, float, bool or other text.

    Text cells are judged by their shape, VARIANT cells by the type they carry."""
    columns = data_columns(df) if columns is None else columns
    mixed = [c for c in columns if isinstance(df.schema[c].dataType, T.VariantType)]
    f = column_facts(df, [c for c in columns if c not in mixed], frozenset({TEXT}))
    held = F.col("row_count") - F.col("null_count")
    kind, dtype = F.col("kind"), F.col("dtype")
    text_kind = kind == "text"
    plain = f.select(
        "column",
        F.when(text_kind, F.col("int_like")).when(dtype.isin("bigint", "int", "smallint", "tinyint"), held).otherwise(0).alias("int_cells"),
        F.when(text_kind, F.col("num_count") - F.col("int_like")).when((kind == "number") & ~dtype.isin("bigint", "int", "smallint", "tinyint", "boolean"), held).otherwise(0).alias("float_cells"),
        F.when(text_kind, F.col("bool_like")).when(dtype == "boolean", held).otherwise(0).alias("bool_cells"),
        F.when(text_kind, held - F.col("num_count") - F.col("bool_like")).otherwise(0).alias("str_cells"),
        F.when(kind.isin("time", "other"), held).otherwise(0).alias("other_cells"),
    )
    for c in mixed:
        tag = F.schema_of_variant(quoted(c))
        is_int, is_float = tag.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), tag.isin("DOUBLE", "FLOAT") | tag.startswith("DECIMAL")
        known = is_int | is_float | tag.isin("BOOLEAN", "STRING", "VOID")
        plain = plain.unionByName(
            df.agg(
                F.count_if(is_int).alias("int_cells"), F.count_if(is_float).alias("float_cells"), F.count_if(tag == "BOOLEAN").alias("bool_cells"),
                F.count_if(tag == "STRING").alias("str_cells"), F.count_if(~known).alias("other_cells"),
            ).select(F.lit(c).alias("column"), "*")
        )
    return plain
