"""Registration of queries and the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A table with deliberate faults, derived from orders by the same text on both engines.
DIRTY = """
raw_orders AS (
  SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_orderdate,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS p,
         CAST(CAST(o_orderdate AS DATE) AS STRING) AS d
  FROM {orders}),
dirty_once AS (
  SELECT k AS row_id, k AS order_id,
    CASE WHEN k % 17 = 0 THEN NULL ELSE o_custkey END AS cust_id,
    CASE WHEN k % 13 = 0 THEN 'NOT_AVAILABLE' WHEN k % 11 = 0 THEN ' n/a'
         WHEN k % 7 = 0 THEN concat('$', p) ELSE p END AS price,
    CASE WHEN k % 19 = 0 THEN 'thirty' WHEN k % 23 = 0 THEN 'twenty-eight'
         WHEN k % 29 = 0 THEN '150' WHEN k % 31 = 0 THEN '-5'
         WHEN k % 37 = 0 THEN NULL ELSE CAST(18 + k % 60 AS STRING) END AS age,
    CASE WHEN k % 5 = 0 THEN concat(' ', lower(o_orderstatus)) ELSE o_orderstatus END AS status,
    CASE WHEN k % 41 = 0 THEN '2023-13-01'
         WHEN k % 3 = 0 THEN concat(substr(d,9,2),'/',substr(d,6,2),'/',substr(d,1,4))
         WHEN k % 3 = 1 THEN replace(d,'-','/') ELSE d END AS order_date,
    CASE WHEN k % 10 < 6 THEN NULL ELSE CAST(k AS DOUBLE) END AS mostly_null
  FROM raw_orders),
dirty AS (
  SELECT * FROM dirty_once
  UNION ALL
  SELECT row_id + 1000000000, order_id, cust_id, price, age, status, order_date, mostly_null
  FROM dirty_once WHERE row_id % 97 = 0)
"""
DIRTY_SQL = DIRTY.replace("{orders}", "orders")

# --- SQL fragments for the DuckDB side ----------------------------------------------
_TOKENS = ", ".join("'" + t + "'" for t in fixed.NULL_TOKENS)
_WIDE_TOKENS = ", ".join("'" + t + "'" for t in fixed.REPORT_NULL_TOKENS)


def num(x: str) -> str:
    shape = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
    return f"(CASE WHEN regexp_full_match(trim({x}), '{shape}') THEN TRY_CAST(trim({x}) AS DOUBLE) END)"


def bare(x: str) -> str:
    return f"regexp_replace({x}, '[£$€¥₹,%\\s]', '', 'g')"


def fnum(x: str) -> str:
    return num(bare(x))


def word(x: str) -> str:
    return f"(CASE lower(trim({x})) WHEN 'thirty' THEN 30::DOUBLE WHEN 'twenty-eight' THEN 28::DOUBLE END)"


def null_like(x: str) -> str:
    return f"(lower(trim({x})) IN ({_TOKENS}))"


def null_like_wide(x: str) -> str:
    return f"(lower(trim({x})) IN ({_WIDE_TOKENS}))"


def day(x: str) -> str:
    """The three formats of the dirty table, in the order they are tried."""
    return (
        f"CAST(coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%Y/%m/%d'),"
        f" try_strptime({x}, '%d/%m/%Y')) AS DATE)"
    )


def day_text(x: str) -> str:
    return f"strftime({day(x)}, '%Y-%m-%d')"


def with_dirty(sql: str) -> str:
    """SQL over the dirty table; further CTEs may follow a leading comma."""
    return f"WITH {DIRTY_SQL} {sql}"


# --- inputs on the Spark side ----------------------------------------------------------
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"
    )
    out = spark.sql(f"WITH {DIRTY} SELECT * FROM dirty", orders=orders)
    return out.withColumnRenamed("row_id", "_row_id")


def keyed(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A test table whose unique key is the row order."""
    return table(spark, folder, name).withColumn("_row_id", F.col(key).cast("bigint"))


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL text if it has one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


DIRTY_COLUMNS = ("order_id", "cust_id", "price", "age", "status", "order_date", "mostly_null")
