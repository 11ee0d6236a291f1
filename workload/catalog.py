"""Catalogue operators on a catalogue derived from the documents, and on events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import catalog, substring
from millrace.session import shared_folder

from .base import query, table

_PRIMES = (3, 7, 9, 11, 13, 17, 19)
_FACTORS = ", ".join(f"1 + (doc_id * {p}) % 10 AS {f}" for f, p in zip(catalog.FACTORS, _PRIMES))
_CATALOG = (
    "SELECT concat('ds-', doc_id) AS name, source, text AS description, CASE doc_id % 4 WHEN 0 THEN 'CC0' WHEN 1 THEN 'MIT'"
    " WHEN 2 THEN 'CC BY 4.0' END AS license, CASE WHEN doc_id % 13 > 0 THEN 2015 + doc_id % 11 END AS year, n_chars AS sizeBytes,"
    f" doc_id, {_FACTORS} FROM {{documents}}"
)
_DUCK = "(" + _CATALOG.replace("{documents}", "documents") + ")"
_SCORE = "round((" + " + ".join(catalog.FACTORS) + ") / 7.0, 1)"


def _catalog(spark, sf):
    return spark.sql(_CATALOG, documents=table(spark, sf, "documents"))


def _search(name: str, words: str, where: str):
    @query(name, f"SELECT name, source FROM {_DUCK} WHERE {where}")
    def run(spark, sf):
        return catalog.search(_catalog(spark, sf), words, ["description"]).select("name", "source")

    return run


def _has(w: str) -> str:
    return f"contains(lower(description), '{w}')"


_search("catalog_and", "the AND data", f"{_has('the')} AND {_has('data')}")
_search("catalog_or", "license or http", f"{_has('license')} OR {_has('http')}")
_search("catalog_simple", " Data ", _has("data"))


def _indexed(name: str, words: str, where: str):
    @query(name, f"SELECT name, source FROM {_DUCK} WHERE {where}")
    def run(spark, sf):
        entries = _catalog(spark, sf)
        folder = f"{shared_folder(spark)}/millrace-index/{uuid.uuid4().hex}"
        index = substring.build_index(entries, "doc_id", ["description"], folder)
        return index.search(entries, words).select("name", "source")


_indexed("catalog_index_and", "license AND apache", f"{_has('license')} AND {_has('apache')}")
_indexed("catalog_index_or", "apache or data", f"{_has('apache')} OR {_has('data')}")
_indexed("catalog_index_phrase", "MIT license", _has("mit license"))
_indexed("catalog_index_short", "@ OR apache", f"{_has('@')} OR {_has('apache')}")


@query(
    "catalog_filter_sort",
    f"SELECT name, license, year, CAST({_SCORE} AS DOUBLE) AS score FROM {_DUCK} WHERE contains(lower(license), 'c') AND {_SCORE} >= 5",
)
def catalog_filter_sort(spark, sf):
    out = catalog.filter_and_sort(catalog.with_reliability(_catalog(spark, sf)), license="C", min_score=5, sort_by="year")
    return out.select("name", "license", "year", F.col("reliabilityScore").alias("score"))


@query("catalog_reliability_top", f"SELECT name, CAST({_SCORE} AS DOUBLE) AS score FROM {_DUCK} ORDER BY score DESC, name LIMIT 3")
def catalog_reliability_top(spark, sf):
    return catalog.top_reliable(_catalog(spark, sf)).select("name", F.col("reliabilityScore").alias("score"))


_WEIGHTED = "round((" + " + ".join(f"{f} * {w}" for f, w in zip(catalog.FACTORS, (3, 2, 1, 1, 1, 1, 1))) + ") / 10.0, 1)"


@query("catalog_reliability_weighted", f"SELECT name, CAST({_WEIGHTED} AS DOUBLE) AS score FROM {_DUCK}")
def catalog_reliability_weighted(spark, sf):
    weights = dict(zip(catalog.FACTORS, (3, 2, 1, 1, 1, 1, 1)))
    return catalog.with_reliability(_catalog(spark, sf), weights).select("name", F.col("reliabilityScore").alias("score"))


@query(
    "catalog_papers_newest",
    "SELECT doc_id, array_to_string(list_transform(list_reverse_sort([d0, d1, d2]), lambda x: CAST(x AS VARCHAR)), '|') AS years FROM"
    " (SELECT doc_id, 2015 + doc_id % 7 AS d0, 2015 + (doc_id * 3) % 8 AS d1, 2015 + (doc_id * 5) % 9 AS d2 FROM documents)",
)
def catalog_papers_newest(spark, sf):
    d = F.col("doc_id")
    paper = lambda e: F.struct(F.lit("t").alias("title"), e.alias("year"))
    df = table(spark, sf, "documents").select(
        "doc_id", F.array(paper(2015 + d % 7), paper(2015 + (d * 3) % 8), paper(2015 + (d * 5) % 9)).alias("papers")
    )
    out = catalog.papers_newest_first(df)
    return out.select("doc_id", F.array_join(F.transform("papers", lambda p: p["year"].cast("string")), "|").alias("years"))


_SAVES = "SELECT event_id, user_id, event_type AS name, CAST(ts AS DATE)::VARCHAR AS source FROM events"


def _saves(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", F.col("event_type").alias("name"), F.to_date("ts").cast("string").alias("source")
    )


@query(
    "catalog_save_once",
    f"WITH s AS ({_SAVES}) SELECT min(event_id) AS event_id, user_id, name, source FROM s WHERE event_id % 5 <> 0 AND NOT EXISTS"
    " (SELECT 1 FROM s k WHERE k.event_id % 5 = 0 AND k.user_id = s.user_id AND k.name = s.name AND k.source = s.source)"
    " GROUP BY user_id, name, source",
)
def catalog_save_once(spark, sf):
    saves = _saves(spark, sf)
    return catalog.save_once(saves.filter("event_id % 5 = 0"), saves.filter("event_id % 5 <> 0"), order="event_id")


@query(
    "catalog_collection_counts",
    "SELECT collection_id, count(e.event_id) AS entries FROM (SELECT DISTINCT user_id AS collection_id FROM events) c"
    " LEFT JOIN events e ON e.user_id = collection_id GROUP BY collection_id",
)
def catalog_collection_counts(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").alias("collection_id"))
    return catalog.collection_counts(events.select("collection_id").distinct(), events)


@query(
    "catalog_delete_collection",
    "SELECT event_id, user_id AS collection_id FROM events WHERE user_id <> (SELECT min(user_id) FROM events)",
)
def catalog_delete_collection(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("collection_id"))
    first = events.agg(F.min("collection_id")).first()[0]
    return catalog.delete_collection(events.select("collection_id").distinct(), events, first)[1]


@query(
    "query_normal_key",
    r"SELECT conv_id, turn, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS query_key FROM conversations",
)
def query_normal_key(spark, sf):
    out = catalog.with_query_key(table(spark, sf, "conversations"), "text")
    return out.select("conv_id", "turn", "query_key")


@query(
    "usage_remaining",
    "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used, greatest(0, 5 - count(*)) AS remaining FROM events GROUP BY ALL",
)
def usage_remaining(spark, sf):
    return catalog.remaining_searches(table(spark, sf, "events"), "user_id", "ts").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
