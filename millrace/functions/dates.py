"""Date column expressions for text dates in several formats.

Each format becomes a shape test and a safe cast of the reordered parts, so nothing
depends on format guessing and every value is judged by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import trimmed

_ABBREVIATED = "|".join(m[:3] for m in fixed.MONTHS)
_FULL = "|".join(fixed.MONTHS)
_MONTH_LIST = "array(" + ", ".join(f"'{m[:3]}'" for m in fixed.MONTHS) + ")"
_DIGITS = {"Y": r"\d{4}", "y": r"\d{2}", "m": r"\d{1,2}", "d": r"\d{1,2}"}
_PIECES = {"%Y": r"(\d{4})", "%d": r"(\d{1,2})", "%b": f"({_ABBREVIATED})", "%B": f"({_FULL})"}


def _digits_only(fmt: str) -> bool:
    return "%b" not in fmt and "%B" not in fmt


def _bound(c: Column, make) -> Column:
    """``make`` of the trimmed text, computed once.

    The list of formats makes one long expression. As the body of ``transform`` it
    stays out of the generated stage code, whose method would be too long to compile.
    """
    return F.transform(F.array(trimmed(c)), make)[0]


def _in_digits(text: Column, fmt: str) -> Column:
    """Date from a format like ``%d/%m/%Y`` or ``%Y%m%d``."""
    if fmt == "%Y%m%d":
        iso = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
        return F.when(text.rlike(r"^\d{8}$"), iso.try_cast("date"))
    fields = re.findall(r"%([A-Za-z])", fmt)
    sep = fmt[2]
    shape = "^" + re.escape(sep).join(_DIGITS[f] for f in fields) + "$"
    part = {f: F.split_part(text, F.lit(sep), F.lit(i + 1)) for i, f in enumerate(fields)}
    if "y" in part:
        # Two-digit years: 69-99 are 19xx, 00-68 are 20xx.
        year = F.concat(F.when(part["y"] > "68", "19").otherwise("20"), part["y"])
    else:
        year = part["Y"]
    return F.when(text.rlike(shape), F.concat_ws("-", year, part["m"], part["d"]).try_cast("date"))


def _with_month_name(text: Column, fmt: str) -> Column:
    body, groups = "", {}
    for token in re.findall(r"%[A-Za-z]|.", fmt):
        if token in _PIECES:
            groups["m" if token in ("%b", "%B") else token[1]] = len(groups) + 1
            body += _PIECES[token]
        else:
            body += r"\s+" if token == " " else re.escape(token)
    pattern = f"(?i)^{body}$"
    name = F.lower(F.substring(F.regexp_extract(text, pattern, groups["m"]), 1, 3))
    month = F.array_position(F.expr(_MONTH_LIST), name)
    iso = F.concat_ws("-", F.regexp_extract(text, pattern, groups["Y"]), month, F.regexp_extract(text, pattern, groups["d"]))
    return F.when(text.rlike(pattern), iso.try_cast("date"))


_KNOWN = tuple(dict.fromkeys(fixed.REPORT_DATE_FORMATS + fixed.LAYER_DATE_FORMATS + fixed.EXTRA_DATE_FORMATS))
# Every known format, ordered by the families below.
ALL_FORMATS = tuple(
    [f for sep in "-/." for f in _KNOWN if _digits_only(f) and sep in f]
    + ["%Y%m%d"]
    + [f for f in _KNOWN if not _digits_only(f)]
)


def _parsed(text: Column, fmt: str) -> Column:
    return _in_digits(text, fmt) if _digits_only(fmt) else _with_month_name(text, fmt)


def parse_date(c: Column, fmt: str) -> Column:
    """DATE when the trimmed text has exactly this format and is a real day."""
    return _parsed(trimmed(c), fmt)


def _families(text: Column, formats: tuple[str, ...]) -> list[tuple[Column, list[str]]]:
    """Formats by what the text must contain: a separator, a month name, or digits alone.

    A text fits formats of one family only, so families may be tried in any order
    and the order within each is kept.
    """
    out = []
    for sep in "-/.":
        mine = [f for f in formats if _digits_only(f) and sep in f]
        if mine:
            out.append((text.contains(sep), mine))
    plain = [f for f in formats if f == "%Y%m%d"]
    if plain:
        out.append((F.length(text) == 8, plain))
    names = [f for f in formats if not _digits_only(f)]
    if names:
        out.append((text.rlike(f"(?i)({_ABBREVIATED})"), names))
    return out


# What every known format has: three numbers with separators, eight digits, or the name of a month.
_ANY_SHAPE = rf"(?i)^\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}$|^\d{{8}}$|{_ABBREVIATED}"


def _could_be_date(text: Column) -> Column:
    return (F.length(text) >= 6) & text.rlike(r"\d") & text.rlike(_ANY_SHAPE)


def _first(c: Column, formats: tuple[str, ...], one) -> Column:
    def search(text: Column) -> Column:
        found = [F.when(guard, F.coalesce(*[one(text, f) for f in mine])) for guard, mine in _families(text, formats)]
        return F.when(_could_be_date(text), F.coalesce(*found))

    return _bound(c, search)


def parse_date_time(c: Column) -> Column:
    """TIMESTAMP_NTZ of an ISO date with a time of day."""
    text = trimmed(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{1,2}:\d{2}"), text.try_cast("timestamp_ntz"))


def first_date(c: Column, formats: tuple[str, ...] = fixed.CLEANER_DATE_FORMATS, extra: bool = False) -> Column:
    """The date by the first format that fits; ``extra`` also takes date-times."""
    if not extra:
        return _first(c, formats, _parsed)
    formats = formats + tuple(f for f in fixed.EXTRA_DATE_FORMATS if f not in formats)
    return F.coalesce(_first(c, formats, _parsed), parse_date_time(c).cast("date"))


def first_format(c: Column, formats: tuple[str, ...] = fixed.REPORT_DATE_FORMATS) -> Column:
    """Name of the first format that fits, or NULL."""
    return _first(c, formats, lambda text, f: F.when(_parsed(text, f).isNotNull(), F.lit(f)))


def format_hits(c: Column) -> Column:
    """For each of ``ALL_FORMATS``, whether the text is a date in it; NULL if it is none."""

    def test(text: Column) -> Column:
        parts = [
            F.when(guard, F.array(*[_parsed(text, f).isNotNull() for f in mine])).otherwise(
                F.expr(f"array_repeat(false, {len(mine)})")
            )
            for guard, mine in _families(text, ALL_FORMATS)
        ]
        return F.when(_could_be_date(text), F.concat(*parts))

    return _bound(c, test)


def parse_timestamp(c: Column) -> Column:
    """TIMESTAMP_NTZ from an ISO date-time or any known date format."""
    return F.coalesce(parse_date_time(c), first_date(c, extra=True).cast("timestamp_ntz"))


def is_real_iso_date(c: Column) -> Column:
    return parse_date(c, "%Y-%m-%d").isNotNull()


def is_ambiguous_date(c: Column) -> Column:
    """``a/b/yyyy`` whose two first numbers could both be the month."""
    t = trimmed(c)
    first, second = (F.split_part(t, F.lit("/"), F.lit(i)).try_cast("int").between(1, 12) for i in (1, 2))
    return F.coalesce(F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), first & second), F.lit(False))


_ONE_READING = fixed.UNAMBIGUOUS_DATE_FORMATS + ("%d/%m/%Y", "%m/%d/%Y")


def careful_date(c: Column) -> Column:
    """ISO text for dates with one possible reading; other text unchanged."""
    sure = F.date_format(F.coalesce(*[parse_date(c, f) for f in _ONE_READING]), "yyyy-MM-dd")
    iso = trimmed(c).rlike(fixed.ISO_DATE_SHAPE)
    return F.when(iso | is_ambiguous_date(c), c).otherwise(F.coalesce(sure, c))


def careful_date_format(c: Column) -> Column:
    """Format by which :func:`careful_date` rewrote the text, NULL if it did not."""
    iso = trimmed(c).rlike(fixed.ISO_DATE_SHAPE)
    named = F.coalesce(*[F.when(parse_date(c, f).isNotNull(), F.lit(f)) for f in _ONE_READING])
    return F.when(~iso & ~is_ambiguous_date(c), named)


def iso_text(c: Column) -> Column:
    """``YYYY-MM-DD`` text of a date or timestamp."""
    return F.date_format(c, "yyyy-MM-dd")
