"""Operators over a dataset catalogue: search, rank, save, collections, limits."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_key
from ..rows import quoted

# The seven reliability factors and the daily search limit.
FACTORS = (
    "citationCount", "sourceCredibility", "documentation", "licenseClarity", "communityAdoption", "maintenance",
    "biasAndDiversity",
)
SEARCHES_PER_DAY = 5


def search_terms(query: str) -> tuple[str, list[str]]:
    """"and" or "or", and the terms in lower case; AND is looked for first."""
    joiner, parts = "and", [query]
    for word in ("AND", "OR"):
        if f" {word} " in query.upper():
            joiner, parts = word.lower(), re.split(rf" {word} ", query, flags=re.IGNORECASE)
            break
    return joiner, [p.strip().lower() for p in parts]


def keyword_match(columns: list[str], query: str) -> Column:
    """``a AND b`` needs every term in the text, ``a OR b`` any."""
    joiner, terms = search_terms(query)
    text = F.lower(F.concat_ws(" ", *map(quoted, columns)))
    hits = [text.contains(t) for t in terms]
    return reduce((lambda a, b: a & b) if joiner == "and" else (lambda a, b: a | b), hits)


def search(catalog: DataFrame, query: str, columns: list[str] = ("name", "description")) -> DataFrame:
    return catalog.filter(keyword_match(list(columns), query))


def with_reliability(catalog: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the seven factors, one decimal; equal weights by default."""
    weights = weights or {f: 1.0 for f in FACTORS}
    total = sum(weights.values())
    terms = [quoted(f).cast("double") * w for f, w in weights.items()]
    return catalog.withColumn("reliabilityScore", F.round(reduce(lambda a, b: a + b, terms) / total, 1))


def filter_and_sort(
    catalog: DataFrame,
    source: str | None = None,
    license: str | None = None,
    min_score: float = 0,
    sort_by: str = "reliability",
) -> DataFrame:
    """Parts of source and licence names, a least score, then sort; missing counts as 0."""
    out = catalog
    for column, part in (("source", source), ("license", license)):
        if part:
            out = out.filter(F.lower(quoted(column)).contains(part.lower()))
    if min_score > 0:
        out = out.filter(F.col("reliabilityScore") >= min_score)
    key = {"reliability": "reliabilityScore", "year": "year"}.get(sort_by, "sizeBytes")
    return out.orderBy(F.coalesce(F.col(key), F.lit(0)).desc(), "name")


def top_reliable(catalog: DataFrame, k: int = 3, weights: dict[str, float] | None = None) -> DataFrame:
    """The k entries of highest reliability."""
    return with_reliability(catalog, weights).orderBy(F.desc("reliabilityScore"), "name").limit(k)


def papers_newest_first(catalog: DataFrame, column: str = "papers") -> DataFrame:
    """Sort the papers inside each entry by year, newest first; no year counts as 0."""
    year = lambda p: F.coalesce(p["year"], F.lit(0))
    return catalog.withColumn(
        column,
        F.array_sort(quoted(column), lambda a, b: (year(b) - year(a)).cast("int")),
    )


def save_once(saved: DataFrame, new: DataFrame, keys: list[str] = ("user_id", "name", "source"), order: str | None = None) -> DataFrame:
    """Entries to add: one per key, and none whose key is saved already."""
    keys = list(keys)
    rest = [c for c in new.columns if c not in keys]
    lead = [order] if order else []
    chosen = F.min(F.struct(*[quoted(c) for c in lead + [c for c in rest if c not in lead]])).alias("_pick")
    one = new.groupBy(*map(quoted, keys)).agg(chosen) if rest else new.distinct()
    known = saved.select(*map(quoted, keys)).distinct()
    fresh = one.join(known, keys, "left_anti")
    return fresh.select(*[quoted(c) if c in keys else F.col("_pick").getField(c).alias(c) for c in new.columns])


def collection_counts(collections: DataFrame, saved: DataFrame) -> DataFrame:
    """Entries per collection, 0 for empty ones."""
    n = saved.groupBy("collection_id").agg(F.count("*").alias("n"))
    return collections.join(n, "collection_id", "left_outer").withColumn("entries", F.coalesce("n", F.lit(0))).drop("n")


def delete_collection(collections: DataFrame, saved: DataFrame, collection_id) -> tuple[DataFrame, DataFrame]:
    """Both tables without the collection and its entries."""
    gone = F.col("collection_id").eqNullSafe(F.lit(collection_id))
    return collections.filter(~gone), saved.filter(~gone)


def remaining_searches(events: DataFrame, user: str, ts: str, limit: int = SEARCHES_PER_DAY) -> DataFrame:
    """Searches used and left per user and day."""
    used = events.groupBy(quoted(user), F.to_date(quoted(ts)).alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), F.lit(limit) - F.col("used")))


def with_query_key(queries: DataFrame, column: str) -> DataFrame:
    return queries.withColumn("query_key", query_key(quoted(column)))
