"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, embeddings, html, jaccard, manifest, mixing, oracles, packing, phrases, quality, secrets, substrings, toxicity
from .common import crc_of_id, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op4_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op3_decontamination", oracles.DECONTAMINATION)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.pmod(crc_of_id(), F.lit(5)) == 0).alias("held_out"), "score", "predicted")


@query("op10_ngram_jaccard_join", oracles.JACCARD_JOIN)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.pmod(crc_of_id(), F.lit(3)) == 1).alias("held_out"), "score", "predicted")


@query("op7_embedding_near_dedup", oracles.NEAR_VECTORS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


@query("op9_substring_dedup", oracles.WORD_REPEATS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(read(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", oracles.MANIFEST)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(read(spark, sf_dir, "documents"), manifest.every_third())


@query("op12_cube_mixing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_source_divergence", oracles.DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))
