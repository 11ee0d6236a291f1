"""Equi-joins that stay balanced when one key holds a large share of the rows.

Both tables are treated as multisets. Equal rows without a row id are combined to one row with
a count, spread by a hash of their content and multiplied out after the join, so the parts of a
hot key depend on what the rows hold and on nothing else: a task that runs again deals its rows
as before. The counts that find hot keys and the join read the same exchange of a table, so what
comes before it runs once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rows import ROW_ID, estimated_bytes, quoted, require_columns
from .digests import hashable

HOW = {"inner": "inner", "left": "left_outer", "right": "right_outer", "outer": "full_outer"}

# A key is split once it holds this many rows, or 1/1000 of its table if more.
# So at most 1000 keys per side are listed, and that list is safe to broadcast.
HOT_ROWS = 1_000_000
HOT_SHARE = 0.001
# Equal rows that stay one row of the join; more of them are dealt to several parts.
COPIES = 1000


def _fits_broadcast(df: DataFrame) -> bool:
    size = estimated_bytes(df)
    limit = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) if size else -1
    return size is not None and 0 <= size <= limit


def _content(df: DataFrame) -> list[Column]:
    """A row's values in a form that can be hashed."""
    return [quoted(f.name) if hashable(f.dataType) else F.to_json(F.struct(quoted(f.name))) for f in df.schema.fields]


def _bag(df: DataFrame) -> DataFrame:
    """The table dealt by row content, with the number of copies of each row as ``_n``.

    All columns take part, so that no reader of this exchange prunes it to one of its own."""
    if ROW_ID not in df.columns and all(hashable(f.dataType) for f in df.schema.fields):
        return df.groupBy(*map(quoted, df.columns)).agg(F.count("*").alias("_n"))
    return df.repartition(F.xxhash64(*_content(df))).withColumn("_n", F.lit(1).cast("bigint"))


def hot_keys(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys to split, with the number of parts per side (``_sl``, ``_sr``), from two bags.

    Counts are combined before the shuffle, so finding a hot key is cheap however
    hot it is. A key passes only above a thousandth of its side.
    """
    parts = []
    for df, name in ((left, "_nl"), (right, "_nr")):
        counts = df.groupBy(*map(quoted, keys)).agg(F.sum("_n").alias(name))
        total = counts.agg(F.coalesce(F.sum(name), F.lit(0)).alias("t"))
        limit = F.greatest(F.lit(float(hot_rows)), total.scalar() * F.lit(HOT_SHARE))
        hot = counts.filter(F.col(name) > limit)
        parts.append(hot.withColumn(name, F.ceil(F.col(name) / limit).cast("int")))
    l, r = parts
    tagged = l.withColumn("_nr", F.lit(None).cast("int")).unionByName(r.withColumn("_nl", F.lit(None).cast("int")))
    return tagged.groupBy(*map(quoted, keys)).agg(
        F.coalesce(F.max("_nl"), F.lit(1)).alias("_sl"), F.coalesce(F.max("_nr"), F.lit(1)).alias("_sr")
    )


def _same(l: Column, r: Column, null_safe: bool) -> Column:
    return l.eqNullSafe(r) if null_safe else l == r


def _tag_parts(df: DataFrame, hot: DataFrame, keys: list[str], mine: str, other: str, slot: str, copies: str):
    """Give each row its own part number and one copy per part of the other side."""
    content = _content(df.drop("_n"))
    if ROW_ID not in df.columns:  # many equal rows: several rows with a part of their number each
        part = F.explode(F.when(F.col("_n") > COPIES, F.expr(f"sequence(0L, (_n - 1) div {COPIES})")).otherwise(F.array(F.lit(0).cast("bigint"))))
        df = df.withColumn("_chunk", part).withColumn("_n", F.least(F.lit(COPIES), F.col("_n") - F.col("_chunk") * COPIES))
        content.append(F.col("_chunk"))
    h = F.broadcast(hot.select(*[quoted(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_sl", "_sr"))
    cond = reduce(lambda a, b: a & b, [quoted(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    out = df.join(h, cond, "left_outer").drop(*[f"_h{i}" for i in range(len(keys))])
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(1)) for c in ("_sl", "_sr")})
    own = F.pmod(F.xxhash64(*content, F.lit(slot)), F.col(mine)).cast("int")
    spread = F.when(F.col(other) > 1, F.sequence(F.lit(0), F.col(other) - 1)).otherwise(F.array(F.lit(0)))
    return out.withColumn(slot, own).withColumn(copies, F.explode(spread))


def join_tables(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    how: str = "inner",
    null_keys_match: bool = True,
    split_hot: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join on same-named keys; other shared names get ``_x`` and ``_y``.

    NULL keys match each other unless ``null_keys_match`` is False. If the optional
    side is small, Spark broadcasts it and no row moves. Otherwise rows of hot keys
    are split into parts by their content, and the partner rows are copied to each part.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in HOW:
        raise ValueError(f"unknown join type {how!r}; use one of {sorted(HOW)}")
    if not keys:
        raise ValueError("join needs at least one key")
    require_columns(left, keys, "Join key(s) in the left table")
    require_columns(right, keys, "Join key(s) in the right table")

    shared = [c for c in left.columns if c in right.columns and c not in keys and c != ROW_ID]
    l_names = {c: (f"{c}_x" if c in shared else c) for c in left.columns}
    r_names = {c: (f"{c}_y" if c in shared else c) for c in right.columns if c != ROW_ID}
    has_id = ROW_ID in left.columns

    small = {"inner": [left, right], "left": [right], "right": [left], "outer": []}[how]
    split = split_hot and not any(_fits_broadcast(d) for d in small)
    extra = []
    if split:
        many = [ROW_ID not in d.columns for d in (left, right)]
        left, right = _bag(left), _bag(right)
        hot = hot_keys(left, right, keys, hot_rows)
        left = _tag_parts(left, hot, keys, "_sl", "_sr", "_a", "_b")
        right = _tag_parts(right, hot, keys, "_sr", "_sl", "_b", "_a")
        extra = ["_a", "_b"]

    lt = left.select(
        *[quoted(c).alias(f"l_{i}") for i, c in enumerate(l_names)],
        *([F.col("_a").alias("la"), F.col("_b").alias("lb"), F.col("_sl").alias("lsl"), F.col("_sr").alias("lsr"),
           F.col("_n").alias("ln"), F.lit(True).alias("lm")] if split else []),
    )
    rt = right.select(
        *[quoted(c).alias(f"r_{i}") for i, c in enumerate(r_names)],
        *([F.col("_a").alias("ra"), F.col("_b").alias("rb"), F.col("_sl").alias("rsl"), F.col("_sr").alias("rsr"),
           F.col("_n").alias("rn"), F.lit(True).alias("rm")] if split else []),
    )
    l_at = {c: F.col(f"l_{i}") for i, c in enumerate(l_names)}
    r_at = {c: F.col(f"r_{i}") for i, c in enumerate(r_names)}
    conds = [_same(l_at[k], r_at[k], null_keys_match) for k in keys]
    if extra:
        conds += [F.col("la") == F.col("ra"), F.col("lb") == F.col("rb")]
    joined = lt.join(rt, reduce(lambda a, b: a & b, conds), HOW[how])
    if split and how != "inner":
        # A key split on the other side has partners there; a row whose own part
        # happened to be empty is not unmatched, its other copies were joined.
        if null_keys_match:
            lost_right, lost_left = F.lit(False), F.lit(False)
        else:
            lost_right = reduce(lambda a, b: a | b, [l_at[k].isNull() for k in keys]) & (F.col("lb") == 0)
            lost_left = reduce(lambda a, b: a | b, [r_at[k].isNull() for k in keys]) & (F.col("ra") == 0)
        joined = joined.filter(
            ~(F.col("rm").isNull() & (F.col("lsr") > 1) & ~lost_right)
            & ~(F.col("lm").isNull() & (F.col("rsl") > 1) & ~lost_left)
        )
    if split and any(many):
        copies = reduce(lambda a, b: a * b, [F.coalesce(F.col(n), F.lit(1)) for n, m in zip(("ln", "rn"), many) if m])
        joined = joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))))

    out = []
    for c, name in l_names.items():
        if c in keys:
            out.append((F.coalesce(l_at[c], r_at[c]) if how in ("right", "outer") else l_at[c]).alias(name))
        elif c != ROW_ID or has_id:
            out.append(l_at[c].alias(name))
    out += [r_at[c].alias(name) for c, name in r_names.items() if c not in keys]
    return joined.select(*out)


def values_only_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column that the other table lacks."""
    a = left.select(quoted(column)).filter(quoted(column).isNotNull()).distinct()
    b = right.select(quoted(column)).filter(quoted(column).isNotNull()).distinct()
    return a.join(b, column, "left_anti")
