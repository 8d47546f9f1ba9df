"""Number parsing, null-safe change and rounding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` places, ties to even, by scaling: the array-library rule."""
    scale = float(10 ** digits)
    return F.rint(as_col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def pct_change(new: Column | str, old: Column | str, digits: int = 2) -> Column:
    """Change from ``old`` to ``new`` in percent of |old|; null when ``old`` is 0."""
    new, old = as_col(new).cast("double"), as_col(old).cast("double")
    ratio = F.try_divide(new - old, F.nullif(F.abs(old), F.lit(0.0)))
    return half_even(ratio * F.lit(100.0), digits)


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``whole``; null when there is no whole."""
    ratio = F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))
    return half_even(ratio * F.lit(100.0), digits)


def to_number(c: Column | str) -> Column:
    """Double, or null when the text is no number."""
    return as_col(c).try_cast("double")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coerce the listed columns that exist to doubles."""
    present = {c: to_number(c) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def parse_rating(c: Column | str) -> Column:
    """First number of a score text, comma or dot; a 0-100 score is brought to 0-10."""
    text = F.replace(as_col(c), F.lit(","), F.lit("."))
    value = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(value > 10, half_even(value / 10, 2)).otherwise(value)


def parse_count(c: Column | str) -> Column:
    """First run of digits as an integer, else null."""
    return F.nullif(F.regexp_extract(as_col(c), r"(\d+)", 1), F.lit("")).try_cast("int")


def parse_nights(c: Column | str) -> Column:
    """Nights from a text that starts ``<n> nott``, else null."""
    head = F.regexp_extract(as_col(c), r"(?i)^[\s\p{Z}]*(\d+)[\s\p{Z}]*nott", 1)
    return F.nullif(head, F.lit("")).try_cast("int")
