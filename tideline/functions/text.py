"""Text cleaning and features as column expressions."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numbers import as_col

RESOURCES = Path(__file__).resolve().parent.parent / "resources"

# The placeholder of an empty negative text, and texts that count as missing.
PLACEHOLDER = "---"
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
# Stay types, the quotes around review texts, the date prefix.
STAY_TYPES = [
    "Coppia", "Solo", "Famiglia con bambini piccoli",
    "Famiglia con bambini più grandi", "Gruppo", "Viaggio d'affari",
]
QUOTES = "«»"
DATE_PREFIX = "Data della recensione:"

_SPACE = r"\s\p{Z}"
_NOT_WORD = r"[^\p{L}\p{N}_]+"
_EDGE_SPACE = rf"^[{_SPACE}]+|[{_SPACE}]+\z"


def null_placeholder(c: Column | str, placeholder: str = PLACEHOLDER) -> Column:
    return F.nullif(as_col(c), F.lit(placeholder))


def null_tokens(c: Column | str) -> Column:
    """Null for the texts a CSV reader takes for missing."""
    c = as_col(c)
    return F.when(~c.isin(NA_TOKENS), c)


def strip_space(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_col(c), _EDGE_SPACE, "")


def is_valid_text(c: Column | str) -> Column:
    """True for text that is neither null nor blank."""
    return F.coalesce(strip_space(c) != "", F.lit(False))


def clean_text(c: Column | str) -> Column:
    """Lower-cased words (letters, digits, underscore of any script) joined by one blank.

    Null becomes empty. One pass: a run of anything else is one blank.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), _NOT_WORD, " "))


def tokens(cleaned: Column | str) -> Column:
    """Words of a cleaned text; empty text has none."""
    return F.array_remove(F.split(as_col(cleaned), " "), "")


def word_tokens(c: Column | str, min_chars: int = 2) -> Column:
    """Lower-cased words of at least ``min_chars`` word characters."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(as_col(c), F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}_]{{{min_chars},}}"), F.lit(0)
    )


def stopwords(*languages: str) -> list[str]:
    """Union of the stop-word lists under ``resources``, sorted."""
    found: set[str] = set()
    for language in languages:
        found.update((RESOURCES / f"{language}.txt").read_text("utf-8").split())
    return sorted(found)


def remove_words(words: Column | str, drop: list[str]) -> Column:
    """Words not in ``drop``, order and repeats kept.

    A long literal list becomes one hash set per task, not one per row.
    """
    return F.filter(as_col(words), lambda t: ~t.isin(drop))


def count_in(words: Column | str, members: list[str]) -> Column:
    """How many of ``words`` are in ``members``."""
    return F.size(F.filter(as_col(words), lambda t: t.isin(members)))


def lemmatize(words: Column | str, lemmas: dict[str, str]) -> Column:
    """Dictionary lemma of each word, the word itself if unknown; blank lemmas drop.

    For dictionaries small enough to be configuration; larger ones go through
    :func:`tideline.operators.scoring.lemmatize_table`.
    """
    if not lemmas:
        return F.filter(as_col(words), lambda t: F.trim(t) != "")
    forms = list(lemmas)
    table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
    mapped = F.transform(as_col(words), lambda t: F.when(t.isin(forms), F.element_at(table, t)).otherwise(t))
    return F.filter(mapped, lambda t: F.trim(t) != "")


def word_count(c: Column | str) -> Column:
    """Number of runs of non-space characters, 0 for null."""
    return F.coalesce(F.regexp_count(as_col(c), F.lit(rf"[^{_SPACE}]+")), F.lit(0))


def add_features(df: DataFrame, positive: str = "text_positive", negative: str = "text_negative") -> DataFrame:
    """review_length and has_negative, for the text columns that exist."""
    new = {}
    if positive in df.columns:
        new["review_length"] = word_count(positive)
    if negative in df.columns:
        new["has_negative"] = F.col(negative).isNotNull()
    return df.withColumns(new) if new else df


def strip_quotes(c: Column | str) -> Column:
    """Trim, strip the quotes, trim again."""
    return strip_space(F.btrim(strip_space(c), F.lit(QUOTES)))


def strip_date_prefix(c: Column | str) -> Column:
    return strip_space(F.replace(as_col(c), F.lit(DATE_PREFIX), F.lit("")))


def stay_type(marked: Column | str, candidates: Column | str) -> Column:
    """The marked stay type, else the first candidate text that is a known one, else empty."""
    known = F.filter(as_col(candidates), lambda t: t.isin(STAY_TYPES))
    return F.coalesce(as_col(marked), F.try_element_at(known, F.lit(1)), F.lit(""))


def title_case(c: Column | str) -> Column:
    """Upper first letter of every run of letters, the rest lower."""
    runs = F.regexp_extract_all(as_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def property_from_url(c: Column | str, marker: str = "/hotel/it/", ending: str = ".it.html") -> Column:
    """Readable name from the path slug after ``marker``, else ``unknown``."""
    after = F.try_element_at(F.split(as_col(c), re.escape(marker)), F.lit(2))
    slug = F.element_at(F.split(after, re.escape(ending)), 1)
    return F.coalesce(title_case(F.replace(slug, F.lit("-"), F.lit(" "))), F.lit("unknown"))


def canonical_group(c: Column | str) -> Column:
    """One spelling of a group name for keys: lower case, trimmed."""
    return F.trim(F.lower(as_col(c)))


def display_group(c: Column | str) -> Column:
    return title_case(canonical_group(c))


def slug(c: Column | str) -> Column:
    """Name safe in a path: runs of non-word characters become one underscore."""
    return F.btrim(F.regexp_replace(F.lower(as_col(c)), _NOT_WORD, "_"), F.lit("_"))
