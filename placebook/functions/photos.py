"""Photo candidates: licences, sizes and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import title_pattern
from .scalars import is_https
from .text import _col

# Licences that may be shown, and the smallest picture.
LICENCES = ["cc0", "pdm", "by"]
LEAST_WIDTH, LEAST_HEIGHT = 900, 600


def https_or_null(c: Column | str) -> Column:
    c = F.trim(_col(c))
    return F.when(is_https(c), c)


def usable_photos(df: DataFrame, width: int = LEAST_WIDTH, height: int = LEAST_HEIGHT) -> DataFrame:
    """Candidates that may be shown: safe links, a free licence (with its author where it asks), large, wider than high, not for adults.

    Adds photo_url, source_url, licence and attribution.
    """
    told = df.withColumns(
        {
            "photo_url": F.coalesce(https_or_null("url"), https_or_null("thumbnail")),
            "source_url": https_or_null("foreign_landing_url"),
            "licence": F.lower(F.coalesce("license", F.lit(""))),
        }
    )
    named = (F.col("licence") != "by") | (F.col("creator").isNotNull() & (F.col("creator") != "") & https_or_null("license_url").isNotNull())
    large = (F.col("width") >= width) & (F.col("height") >= height) & (F.col("width") > F.col("height"))
    ok = (F.coalesce("id", F.lit("")) != "") & F.col("photo_url").isNotNull() & F.col("source_url").isNotNull() & F.col("licence").isin(LICENCES) & named & large
    who = F.when(F.coalesce("creator", F.lit("")) != "", F.concat(F.lit("사진: "), "creator", F.lit(" · "))).otherwise("")
    return told.filter(ok & ~F.coalesce("mature", F.lit(False))).withColumn("attribution", F.concat(who, F.upper("licence"), F.lit(" · Openverse")))


def fitting_titles(df: DataFrame, query: str = "query", title: str = "title") -> DataFrame:
    """Photos whose title says what the query looks for; queries without a pattern take any."""
    pattern = title_pattern(query)
    return df.filter(pattern.isNull() | F.coalesce(F.regexp_like(F.coalesce(title, F.lit("")), pattern), F.lit(False)))


def fresh_position(accuracy: Column | str, at: Column | str, now: Column, most_seconds: int = 300) -> Column:
    """A position that is known well enough and no older than five minutes, nor of the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(_col(at))
    return (_col(accuracy) >= 0) & age.between(0, most_seconds)
