"""Stored web pages to review rows and links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tideline.functions.dates import strict_italian_date
from tideline.functions.numbers import parse_count, parse_nights, parse_rating
from tideline.functions.text import STAY_TYPES, property_from_url, strip_date_prefix, strip_quotes
from tideline.sources.markup import Field, Profile, Selector, read_cards


def _marked(*names: str, tag: str | None = None) -> tuple[tuple[Selector, ...], ...]:
    return tuple((Selector(tag, "data-testid", equals=n),) for n in names)


_TEXT_TAGS = ("span", "div", "p")
_ANY_STAY = "(?:" + "|".join(STAY_TYPES) + r")\Z"

# The marks of review cards and their fields, in order of preference.
REVIEW_CARDS = Profile(
    cards=(
        Selector(attr="data-testid", equals="review-card"),
        Selector(attr="data-testid", equals="featuredreview"),
        Selector(attr="data-testid", equals="review-block"),
        Selector("div", "class", contains="review_item"),
        Selector("div", "itemprop", equals="review"),
    ),
    fields=(
        Field("text_positive", _marked("review-positive-text", "featuredreview-text", "featuredreviewcard-text")),
        Field("text_negative", _marked("review-negative-text")),
        Field("review_title", _marked("review-title", "featuredreview-title")),
        Field("score", _marked("review-score", "review-score-badge")
              + ((Selector(attr="class", contains="review-score"),),), glue=" "),
        Field("reviewer", tuple(
            (*path, Selector("div", "class", contains="b08850ce41"))
            for path in _marked("review-avatar", "featuredreview-avatar")
        )),
        Field("reviewer_country",
              ((Selector("img", "src", contains="images-flags", also=Selector(attr="alt")),),), take="alt"),
        Field("stay_type", _marked("review-traveler-type", "review-stay-type")
              + tuple((Selector(t, text=_ANY_STAY),) for t in _TEXT_TAGS)),
        Field("nights_marked", _marked("review-num-nights")),
        Field("nights_text", tuple((Selector(t, text=r"\d+\s*nott"),) for t in _TEXT_TAGS)),
        Field("date_marked", _marked("review-date")),
        Field("date_stay", _marked("review-stay-date")),
    ),
    page_fields=(
        Field("stars_label", _marked("rating-squares", "quality-rating"), take="aria-label"),
        Field("stars_icons", tuple(
            (*path, Selector("span", "aria-hidden", equals="true"))
            for path in _marked("rating-squares", "quality-rating")
        ), take="#count"),
    ),
)

# A page whose cards are its articles.
ARTICLES = Profile(
    cards=(Selector("article"),),
    fields=(Field("review_title", ((Selector("h1"),),)), Field("text_positive", ((),))),
)


def extract_cards(pages: DataFrame, profile: Profile, key: str = "page_id", html: str = "html",
                  keep: list[str] | None = None) -> DataFrame:
    """One row per card with the raw texts of its fields and its place on the page.

    Only the page source crosses to Python; pages are independent, so nothing is shuffled.
    """
    names = [f.name for f in (*profile.page_fields, *profile.fields)]
    schema = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"

    @pandas_udf(schema)
    def cards(sources: pd.Series) -> pd.Series:
        return sources.map(lambda s: [{n: row.get(n) for n in names} for row in read_cards(s, profile)])

    found = pages.select(*(keep or [key]), F.posexplode(cards(html)).alias("card", "_c"))
    return found.select(*(keep or [key]), "card", *[F.col(f"_c.{n}").alias(n) for n in names])


def review_rows(pages: DataFrame, city: Column, source: Column, key: str = "page_id", url: str = "url",
                html: str = "html", scraped_at: str | None = None) -> DataFrame:
    """Review pages to the raw review table, all parsing as column expressions."""
    keep = [c for c in (key, url, scraped_at) if c]
    raw = extract_cards(pages, REVIEW_CARDS, key, html, keep)
    empty = F.lit("")
    date_text = F.coalesce(F.nullif(strip_date_prefix("date_marked"), empty), F.col("date_stay"), empty)
    icons = F.nullif(F.coalesce(F.col("stars_icons").cast("int"), F.lit(0)), F.lit(0))
    return raw.select(
        key, "card",
        city.alias("city"), source.alias("source"),
        property_from_url(url).alias("property"),
        F.coalesce(parse_count("stars_label"), icons).alias("property_stars"),
        (F.col(scraped_at) if scraped_at else F.current_timestamp()).alias("scraped_at"),
        date_text.alias("review_date"),
        parse_rating("score").alias("rating"),
        F.coalesce(strip_quotes("review_title"), empty).alias("review_title"),
        F.coalesce("stay_type", empty).alias("stay_type"),
        F.when(F.col("nights_marked").isNotNull(), parse_count("nights_marked"))
        .otherwise(parse_nights("nights_text")).alias("nights_stayed"),
        strip_quotes("text_positive").alias("text_positive"),
        F.coalesce(strip_quotes("text_negative"), empty).alias("text_negative"),
        F.coalesce("reviewer", empty).alias("reviewer"),
        F.coalesce("reviewer_country", empty).alias("reviewer_country"),
    ).where(F.col("text_positive") != "")


def with_review_day(reviews: DataFrame, column: str = "review_date", out: str = "review_day") -> DataFrame:
    """The date of a collected review, null if the text is no whole date."""
    return reviews.withColumn(out, strict_italian_date(column))


def extract_links(pages: DataFrame, base: str, key: str = "page_id", html: str = "html",
                  card_mark: str = 'data-testid="property-card"', link_mark: str = 'data-testid="title-link"',
                  path_mark: str = "/hotel/", most: int | None = None) -> DataFrame:
    """Distinct links with the page and position where each is met first.

    Pages with marked cards give the marked links; pages without any give all links whose
    path holds ``path_mark``. Relative links are put under ``base``. The first meeting is a
    minimum, which is partly taken before the shuffle. ``most`` keeps that many links in
    order of meeting.
    """
    anchors = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*>"), F.lit(0))
    has_cards = F.contains(F.col(html), F.lit(card_mark))
    wanted = F.filter(
        anchors,
        lambda a: F.when(has_cards, F.contains(a, F.lit(link_mark)))
        .otherwise(F.contains(_href(a), F.lit(path_mark))),
    )
    hrefs = F.transform(wanted, lambda a: F.replace(_href(a), F.lit("&amp;"), F.lit("&")))
    found = pages.select(key, F.posexplode(hrefs).alias("pos", "href")).where(F.col("href") != "")
    url = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    first = found.groupBy(url.alias("url")).agg(F.min(F.struct(key, "pos")).alias("first"))
    out = first.select("url", F.col(f"first.{key}").alias("first_page"), F.col("first.pos").alias("first_pos"))
    return out if most is None else out.orderBy("first_page", "first_pos").limit(most)


_HREF = r"""(?i)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _href(anchor: Column) -> Column:
    """The target in double, single or no quotes; empty without one."""
    return F.concat(*[F.regexp_extract(anchor, _HREF, i) for i in (1, 2, 3)])
