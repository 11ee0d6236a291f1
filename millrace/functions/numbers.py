"""Numeric column expressions: lenient parsing, number words, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import has_currency, trimmed

_ALL_WORDS = "|".join(fixed.WORD_VALUES)
_WORD_MAP = "map(" + ", ".join(f"'{w}', {v}" for w, v in fixed.WORD_VALUES.items()) + ")"
WORD_ANYWHERE = rf"(?i)\b({_ALL_WORDS})\b"
_WORDS_ONLY = rf"(?i)^\s*(?:(?:{_ALL_WORDS})(?:\s+|$))+$"
_WORDS_ONLY_HYPHEN = rf"(?i)^[\s-]*(?:(?:{_ALL_WORDS})(?:[\s-]+|$))+$"


# A digit next to the signs that a formatted number may carry, and nothing else.
FORMATTED_SHAPE = rf"^[\d\s.,%eE+\-{fixed.CURRENCY_SYMBOLS}]*\d[\d\s.,%eE+\-{fixed.CURRENCY_SYMBOLS}]*$"


def parse_number(c: Column) -> Column:
    """DOUBLE for text shaped like a plain number, else NULL."""
    return parse_trimmed(trimmed(c))


def parse_trimmed(t: Column) -> Column:
    return F.when(t.rlike(fixed.NUMBER_SHAPE), t.try_cast("double"))


def parse_currency(c: Column) -> Column:
    """Number behind a currency symbol; NULL when there is no symbol."""
    bare = F.translate(c, fixed.CURRENCY_SYMBOLS + "," + fixed.WHITESPACE, "")
    return F.when(has_currency(c), parse_number(bare))


def parse_formatted_number(c: Column) -> Column:
    """Number after removing currency signs, commas, percent signs and blanks."""
    return parse_number(F.translate(c, fixed.CURRENCY_SYMBOLS + ",%" + fixed.WHITESPACE, ""))


def has_number_word(c: Column) -> Column:
    return c.rlike(WORD_ANYWHERE)


def parse_number_words(c: Column, hyphens: bool = True, allow_zero: bool = True) -> Column:
    """``twenty-eight`` -> 28.0; NULL unless every word is a number word.

    The shape test runs first, so the word loop only touches matching cells.
    """
    lookup = F.expr(_WORD_MAP)
    plain = F.translate(F.lower(c), "-", " ") if hyphens else F.lower(c)
    words = F.split(trimmed(plain), r"\s+")

    def one_or(cur):
        return F.when(cur == 0, F.lit(1)).otherwise(cur)

    def step(acc, word):
        v, total, cur = lookup[word], acc["total"], acc["cur"]
        return F.struct(
            F.when(v == 1000, total + one_or(cur) * 1000).otherwise(total).alias("total"),
            F.when(v == 1000, F.lit(0)).when(v == 100, one_or(cur) * 100).otherwise(cur + v).alias("cur"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("cur"))
    value = F.aggregate(words, start, step, lambda acc: (acc["total"] + acc["cur"]).cast("double"))
    if not allow_zero:
        value = F.nullif(value, F.lit(0.0))
    return F.when(c.rlike(_WORDS_ONLY_HYPHEN if hyphens else _WORDS_ONLY), value)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, NULL for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, digits)


def z_score(c: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(F.abs(c - mean), std)


def fill_confidence(null_pct: Column) -> Column:
    """Trust in a fill by the share of missing cells, in percent."""
    return F.when(null_pct < 5, "high").when(null_pct <= 20, "medium").otherwise("low")


def corrected_skewness(n: Column, population: Column) -> Column:
    """Sample skewness from the population figure; 0 below three values or no spread."""
    n = n.cast("double")
    adjusted = F.try_divide(population * F.sqrt(n * (n - 1)), n - 2)
    return F.when(n < 3, F.lit(0.0)).otherwise(F.coalesce(F.nanvl(adjusted, F.lit(0.0)), F.lit(0.0)))
