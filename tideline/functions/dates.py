"""Italian dates and inclusive date ranges as column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.labels import case_map
from tideline.functions.numbers import as_col

# Month names.
IT_MONTHS = {
    "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4,
    "maggio": 5, "giugno": 6, "luglio": 7, "agosto": 8,
    "settembre": 9, "ottobre": 10, "novembre": 11, "dicembre": 12,
}
EN_MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4,
    "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
}

_GAP = r"[\s\p{Z}]+"
_ANYWHERE = rf"(\d{{1,2}})[º°]?{_GAP}(\p{{L}}+){_GAP}(\d{{4}})"
_WHOLE = rf"^[\s\p{{Z}}]*(\d{{1,2}})[ºª°]?{_GAP}(\p{{L}}+){_GAP}(\d{{4}})[\s\p{{Z}}]*\z"


def _as_date(text: Column, pattern: str, month: Column) -> Column:
    day = F.regexp_extract(text, pattern, 1)
    year = F.regexp_extract(text, pattern, 3)
    # concat is null when the month is unknown; an impossible day parses to null.
    return F.try_to_date(F.concat(year, F.lit("-"), month, F.lit("-"), day), "yyyy-M-d")


def italian_date(c: Column | str) -> Column:
    """The first ``<day>[º°] <month> <year>`` anywhere in the text, case-blind; else null."""
    text = F.lower(as_col(c))
    month = case_map(F.regexp_extract(text, _ANYWHERE, 2), IT_MONTHS, None).cast("string")
    return _as_date(text, _ANYWHERE, month)


def strict_italian_date(c: Column | str) -> Column:
    """As :func:`italian_date`, but the whole text must be the date.

    Italian month names must be lower-case; English ones are taken in any case.
    """
    text = as_col(c)
    word = F.regexp_extract(text, _WHOLE, 2)
    month = F.coalesce(
        case_map(word, IT_MONTHS, None), case_map(F.lower(word), EN_MONTHS, None)
    ).cast("string")
    return _as_date(text, _WHOLE, month)


def in_date_range(c: Column | str, low: date | None, high: date | None) -> Column:
    """Inclusive range test, open where a bound is None; undated rows pass."""
    day = as_col(c)
    test = F.lit(True)
    if low is not None:
        test = test & (day >= F.lit(low))
    if high is not None:
        test = test & (day <= F.lit(high))
    return day.isNull() | test
