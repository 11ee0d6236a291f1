"""Joins of the dirty table with customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.joins import join_tables, values_only_in

from .base import dirty, query, table, with_dirty

_LEFT = "SELECT row_id, order_id, cust_id, status FROM dirty"
_RIGHT = (
    "SELECT CASE WHEN c_custkey % 50 = 3 THEN c_custkey + 1000000 WHEN c_custkey = 9 THEN NULL ELSE c_custkey END AS cust_id,"
    " c_mktsegment AS status, c_nationkey FROM customer"
)


def _sides(spark, sf):
    left = dirty(spark, sf).select("_row_id", "order_id", "cust_id", "status")
    k = F.col("c_custkey")
    key = F.when(k % 50 == 3, k + 1000000).when(k == 9, F.lit(None)).otherwise(k)
    right = table(spark, sf, "customer").select(key.alias("cust_id"), F.col("c_mktsegment").alias("status"), "c_nationkey")
    return left, right


def _join(name: str, how: str, sql_how: str, key: str, null_safe: bool = True, **options):
    same = "l.cust_id IS NOT DISTINCT FROM r.cust_id" if null_safe else "l.cust_id = r.cust_id"

    @query(
        name,
        with_dirty(
            f", l AS ({_LEFT}), r AS ({_RIGHT}) SELECT l.row_id AS _row_id, l.order_id, {key} AS cust_id,"
            f" l.status AS status_x, r.status AS status_y, r.c_nationkey FROM l {sql_how} JOIN r ON {same}"
        ),
    )
    def run(spark, sf):
        left, right = _sides(spark, sf)
        return join_tables(left, right, "cust_id", how, null_keys_match=null_safe, **options)

    return run


_join("join_inner", "inner", "INNER", "l.cust_id")
_join("join_left", "left", "LEFT", "l.cust_id")
_join("join_right", "right", "RIGHT", "coalesce(l.cust_id, r.cust_id)")
_join("join_outer", "outer", "FULL", "coalesce(l.cust_id, r.cust_id)")
_join("join_strict_keys", "outer", "FULL", "coalesce(l.cust_id, r.cust_id)", null_safe=False)


@query(
    "join_null_keys",
    with_dirty(
        f", l AS ({_LEFT}), r AS ({_RIGHT}) SELECT l.row_id AS _row_id, r.c_nationkey FROM l JOIN r"
        " ON l.cust_id IS NOT DISTINCT FROM r.cust_id WHERE l.cust_id IS NULL"
    ),
)
def join_null_keys(spark, sf):
    left, right = _sides(spark, sf)
    out = join_tables(left, right.drop("status"), "cust_id")
    return out.filter(F.col("cust_id").isNull()).select("_row_id", "c_nationkey")


@query(
    "join_suffixes",
    "SELECT l.l_orderkey AS key, l.l_suppkey AS part_x, r.l_suppkey AS part_y FROM lineitem l JOIN"
    " lineitem r ON l.l_orderkey = r.l_orderkey",
)
def join_suffixes(spark, sf):
    lines = table(spark, sf, "lineitem")
    left = lines.select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("part"))
    return join_tables(left, left, ["key"])


@query(
    "join_hot_key",
    "SELECT e.event_id, e.hot AS kind, n.total FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hot'"
    " ELSE event_type END AS hot FROM events) e FULL JOIN (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE"
    " event_type END AS kind, count(*) AS total FROM events GROUP BY 1) n ON e.hot = n.kind",
)
def join_hot_key(spark, sf):
    """A third of the left rows share one key; it is split over several parts by row content."""
    kind = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("kind")
    events = table(spark, sf, "events").select("event_id", kind)
    totals = events.groupBy("kind").agg(F.count("*").alias("total"))
    return join_tables(events, totals, "kind", "outer", hot_rows=100)


@query(
    "join_hot_copies",
    "SELECT coalesce(l.kind, r.kind) AS kind, l.odd, r.region FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS kind,"
    " event_id % 2 AS odd FROM events) l FULL JOIN (SELECT CASE WHEN n_regionkey = 4 THEN 'none' ELSE 'hot' END AS kind,"
    " n_regionkey AS region FROM nation) r ON l.kind = r.kind",
)
def join_hot_copies(spark, sf):
    """Both sides hold many equal rows under one key and have no row ids."""
    kind = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("kind")
    left = table(spark, sf, "events").select(kind, (F.col("event_id") % 2).alias("odd"))
    group = F.when(F.col("n_regionkey") == 4, "none").otherwise("hot").alias("kind")
    right = table(spark, sf, "nation").select(group, F.col("n_regionkey").alias("region"))
    return join_tables(left, right, "kind", "outer", hot_rows=10)


@query(
    "values_only_left",
    with_dirty(
        f", r AS ({_RIGHT}) SELECT DISTINCT cust_id FROM dirty WHERE cust_id IS NOT NULL AND cust_id NOT IN"
        " (SELECT cust_id FROM r WHERE cust_id IS NOT NULL)"
    ),
)
def values_only_left(spark, sf):
    left, right = _sides(spark, sf)
    return values_only_in(left, right, "cust_id")
