"""Column roles and semantic types from names and column facts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed
from ..rows import data_columns, local_table
from . import facts as F_
from . import stats


def normal_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def name_has(name: str, words: tuple[str, ...], match: str = "token") -> bool:
    """Does a column name contain one of the keywords?

    ``token`` compares whole ``_``-separated parts, so ``manager_id`` is no age
    column; ``substring`` looks anywhere in the name.
    """
    name = normal_name(name)
    if match == "substring":
        return any(w in name for w in words)
    padded = "_" + re.sub(r"[^a-z0-9]+", "_", name).strip("_") + "_"
    return any("_" + w.strip("_") + "_" in padded for w in words)


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _held(f: dict) -> int:
    return f["row_count"] - f["null_count"]


# --- five-way type of the quality report ----------------------------------------
def report_type(name: str, f: dict, unique: int, match: str = "token") -> str:
    """``id``, ``numeric``, ``date``, ``categorical`` or ``text``."""
    n = _held(f)
    id_name = name_has(name, fixed.ID_WORDS, match)
    if f["kind"] == "number":
        return "id" if id_name and n else "numeric"
    if f["kind"] == "time":
        return "date"
    if not n:
        return "text"
    if id_name and _share(unique, n) > 0.8:
        return "id"
    if name_has(name, fixed.DATE_WORDS, match) and _share(f["date_any"], n) > 0.5:
        return "date"
    if _share(f["fnum_count"], n) > 0.7:
        return "numeric"
    if _share(unique, n) > 0.6 or (f["len_sum"] or 0) / n > 60:
        return "text"
    return "categorical"


# --- four-way type of the automatic cleaner --------------------------------------
def auto_type(f: dict, unique: int) -> str:
    """``numeric``, ``datetime``, ``categorical`` or ``text``."""
    if f["kind"] == "number":
        return "numeric"
    if f["kind"] == "time":
        return "datetime"
    n = _held(f)
    if not n:
        return "text"
    if _share(f["date_any"], n) > 0.7:
        return "datetime"
    if _share(f["fnum_count"], n) > 0.7:
        return "numeric"
    return "text" if _share(unique, n) > 0.5 or (f["len_sum"] or 0) / n > 50 else "categorical"


def is_important(name: str, held: int, unique: int, match: str = "token") -> bool:
    """Worth keeping although mostly empty: by name, or nearly unique values."""
    return name_has(name, fixed.IMPORTANT_WORDS, match) or (held >= 10 and _share(unique, held) >= 0.9)


# --- roles of the smart cleaner -----------------------------------------------------
ROLES = ("age_columns", "score_columns", "currency_columns", "salary_columns", "date_columns")


def detect_roles(held: dict[str, dict], match: str = "token") -> dict[str, list[str]]:
    """Role lists by name, currency signs (> 10 %) and date share."""
    roles: dict[str, list[str]] = {r: [] for r in ROLES}
    for name, f in held.items():
        n = _held(f)
        for role, words in (
            ("age_columns", fixed.AGE_WORDS), ("score_columns", fixed.SCORE_WORDS),
            ("salary_columns", fixed.SALARY_WORDS),
        ):
            if name_has(name, words, match):
                roles[role].append(name)
        text = f["kind"] == "text" and n > 0
        if name_has(name, fixed.CURRENCY_WORDS, match) or (text and _share(f["currency"], n) > 0.1):
            roles["currency_columns"].append(name)
        if text:
            rate = _share(f["date_any"], n)
            if rate > 0.7 or (rate > 0.4 and name_has(name, fixed.DATE_WORDS, match)):
                roles["date_columns"].append(name)
    return roles


def suggest_roles(held: dict[str, dict], unique: dict[str, int], match: str = "token") -> dict[str, list[str]]:
    """Role lists the quality report proposes for ``smart_clean``."""
    roles: dict[str, list[str]] = {r: [] for r in ROLES}
    for name, f in held.items():
        for role, words in (
            ("age_columns", fixed.AGE_WORDS), ("score_columns", fixed.REPORT_SCORE_WORDS),
            ("salary_columns", fixed.REPORT_SALARY_WORDS),
        ):
            if name_has(name, words, match):
                roles[role].append(name)
        signs = f["kind"] == "text" and _share(f["currency"], _held(f)) > 0.05
        if name_has(name, fixed.REPORT_CURRENCY_WORDS, match) or signs:
            roles["currency_columns"].append(name)
        if report_type(name, f, unique.get(name, 0), match) == "date":
            roles["date_columns"].append(name)
    return roles


# --- semantic schema of the layered cleaner --------------------------------------------
def semantic_type(name: str, f: dict) -> tuple[str, str]:
    """Semantic type and confidence; the first matching rule wins."""
    n = _held(f)
    emails = n > 0 and f["kind"] == "text" and _share(f["email_strict"], n) > 0.5
    for kind, patterns in fixed.SEMANTIC_NAME_PATTERNS:
        if any(re.search(p, normal_name(name)) for p in patterns):
            return kind, ("medium" if kind == "email" and not emails else "high")
        if kind == "email" and emails:
            return kind, "medium"
    if _looks_like_date(f):
        return "date", "medium"
    return ("money", "medium") if f["currency"] else ("unknown", "low")


def _looks_like_date(f: dict) -> bool:
    return f["kind"] == "time" or _share(f["layer_date"], _held(f)) > 0.5


def storage_type(f: dict) -> str:
    """``numeric``, ``boolean``, ``date`` or ``text``."""
    if f["kind"] == "number":
        return "boolean" if f["dtype"] == "boolean" else "numeric"
    if f["kind"] == "time":
        return "date"
    if _share(f["num_count"], _held(f)) > 0.7:
        return "numeric"
    return "date" if _looks_like_date(f) else "text"


def semantic_schema(held: dict[str, dict]) -> dict[str, dict]:
    """``column -> {semantic, storage, confidence, bucket}``."""
    out = {}
    for name, f in held.items():
        semantic, confidence = semantic_type(name, f)
        storage = storage_type(f)
        bucket = fixed.SEMANTIC_BUCKETS.get(semantic) or (
            "numeric_columns" if storage == "numeric" else "categorical_columns"
        )
        out[name] = {"semantic": semantic, "storage": storage, "confidence": confidence, "bucket": bucket}
    return out


def schema_table(spark: SparkSession, schema: dict[str, dict]) -> DataFrame:
    return local_table(spark, 
        [(c, s["semantic"], s["storage"], s["confidence"], s["bucket"]) for c, s in schema.items()],
        "column string, semantic_type string, storage_type string, confidence string, bucket string",
    )


SCHEMA_PARTS = frozenset({F_.TEXT, F_.WORDS, F_.DATES, F_.NUMBERS, F_.BRACKET})


def infer_schema(df: DataFrame) -> DataFrame:
    """Semantic type, storage type, confidence and bucket of every column."""
    held = F_.collect_facts(F_.column_facts(df, parts=frozenset({F_.TEXT, F_.DATES})))
    return schema_table(df.sparkSession, semantic_schema(held))


def unique_counts(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> dict[str, int]:
    columns = data_columns(df) if columns is None else columns
    return {r["column"]: r["unique_count"] for r in stats.distinct_counts(df, columns, exact).collect()}


def column_types(df: DataFrame, family: str = "report", match: str = "token") -> DataFrame:
    """Inferred type per column, by the rules of the report or the automatic cleaner."""
    held = F_.collect_facts(F_.column_facts(df, parts=frozenset({F_.TEXT, F_.DATES})))
    unique = unique_counts(df)
    rows = [
        (c, report_type(c, f, unique.get(c, 0), match) if family == "report" else auto_type(f, unique.get(c, 0)))
        for c, f in held.items()
    ]
    return local_table(df.sparkSession, rows, "column string, column_type string")


def role_table(df: DataFrame, family: str = "smart", match: str = "token") -> DataFrame:
    """``(role, column)`` rows: detected roles, or those suggested by the report."""
    held = F_.collect_facts(F_.column_facts(df, parts=frozenset({F_.TEXT, F_.DATES})))
    roles = detect_roles(held, match) if family == "smart" else suggest_roles(held, unique_counts(df), match)
    return local_table(df.sparkSession, 
        [(r, c) for r, cs in roles.items() for c in cs], "role string, column string"
    )
