"""Text column expressions: trimming, casing, placeholders, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def trimmed(c: Column) -> Column:
    """Strip all leading and trailing white space, not just blanks."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, so ``mary-jane`` gives ``Mary-Jane``."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(t.substr(F.lit(2), F.length(t)))),
        ),
        "",
    )


def folded(c: Column) -> Column:
    """Trimmed lower-case form used to compare with token lists."""
    return F.lower(trimmed(c))


def is_null_like(c: Column, tokens: tuple[str, ...] = fixed.NULL_TOKENS) -> Column:
    return folded(c).isin(*tokens)


def null_tokens_to_null(c: Column, tokens: tuple[str, ...] = fixed.NULL_TOKENS) -> Column:
    return F.when(~is_null_like(c, tokens), c)


def is_blank(c: Column) -> Column:
    """NULL or white space only."""
    return c.isNull() | (trimmed(c.cast("string")) == "")


def is_padded(c: Column) -> Column:
    return c != trimmed(c)


def has_currency(c: Column) -> Column:
    return c.rlike(fixed.CURRENCY_SHAPE)


def email_shaped(c: Column, strict: bool = False) -> Column:
    return c.rlike(fixed.EMAIL_STRICT if strict else fixed.EMAIL_LOOSE)


def query_key(c: Column) -> Column:
    """Normal form of a search text: trimmed, lower case, single blanks."""
    return F.regexp_replace(folded(c), r"\s+", " ")
