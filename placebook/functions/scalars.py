"""Dates, amounts, distances and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, squeeze

EARTH = 6371000.0


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date, null where there is no such day."""
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when((y != "") & (m != "") & (d != ""), F.try_to_date(text, "yyyy-MM-dd"))


def _parts(c: Column, pattern: str, century: str = "") -> Column:
    y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return _date(F.when(y != "", F.concat(F.lit(century), y)).otherwise(""), m, d)


def strict_date(c: Column | str) -> Column:
    """YYYY-MM-DD at the beginning of the text."""
    return _parts(F.coalesce(_col(c), F.lit("")), r"^(\d{4})-(\d{2})-(\d{2})")


def korean_date(c: Column | str) -> Column:
    """The first that gives a day: a year 202x, a year 23 to 26, eight digits."""
    s = F.trim(F.regexp_replace(F.translate(F.coalesce(_col(c), F.lit("")), "‘’`", "'''"), r"[\r\n\t]+", " "))
    sep_y, sep_m = r"[.\-/년\s]+", r"[.\-/월\s]+"
    return F.coalesce(
        _parts(s, rf"(?:^|[^\d])(202\d){sep_y}(\d{{1,2}}){sep_m}(\d{{1,2}})"),
        _parts(s, rf"(?:^|['\s])(2[3-6]){sep_y}(\d{{1,2}}){sep_m}(\d{{1,2}})", "20"),
        _parts(s, r"(?:^|[^\p{L}\p{N}_])(202\d)(\d{2})(\d{2})(?![\p{L}\p{N}_])"),
    )


def separated_date(c: Column | str) -> Column:
    """Any four-digit year with separators, or eight digits."""
    s = squeeze(F.coalesce(_col(c), F.lit("")))
    return F.coalesce(_parts(s, r"(\d{4})[.\-/년\s]+(\d{1,2})[.\-/월\s]+(\d{1,2})"), _parts(s, r"^(\d{4})(\d{2})(\d{2})$"))


def sheet_date(number: Column | str) -> Column:
    """Spreadsheet serials from 40000 to 60000."""
    n = _col(number)
    return F.when(n.between(40000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))


def months_before(day: Column | str, months: int) -> Column:
    """The same day so many months earlier, the month's last day if there is none."""
    return F.add_months(_col(day), -months)


def in_window(day: Column | str, as_of: Column, months: int) -> Column:
    """From so many months before ``as_of`` up to it, both ends included."""
    return _col(day).between(months_before(as_of, months), as_of)


def decimal_amount(c: Column | str) -> Column:
    """Won with separators and signs; decimals are cut off, anything else is 0."""
    plain = F.regexp_replace(F.coalesce(F.trim(_col(c)), F.lit("")), "[,원₩]", "")
    return F.coalesce(plain.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def digits_amount(c: Column | str) -> Column:
    """All digits of the text as one number, 0 without any."""
    return F.coalesce(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^0-9]", "").try_cast("long"), F.lit(0).cast("long"))


def flat_distance(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the flat map around the mean latitude."""
    a, b, c, d = map(_col, (lat1, lon1, lat2, lon2))
    return F.lit(EARTH) * F.hypot(F.radians(a - c), F.radians(b - d) * F.cos(F.radians((a + c) / 2)))


def great_circle(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the sphere; infinite where a coordinate is missing."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    found = F.lit(2 * EARTH) * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    return F.when(found.isNull() | F.isnan(found), F.lit(float("inf"))).otherwise(found)


def coordinate(c: Column | str, low: float, high: float) -> Column:
    """The number if it is one within the bounds, else null."""
    n = F.trim(_col(c)).try_cast("double")
    return F.when(n.between(low, high), n)


def match_score(distance: Column, same_phone: Column) -> Column:
    """100, and 20 within 25 m or 10 within 50 m, and 15 for the same phone."""
    return F.lit(100) + F.when(distance <= 25, 20).when(distance <= 50, 10).otherwise(0) + F.when(same_phone, 15).otherwise(0)


def minute_of_day(hour: Column, minute: Column, lead: Column) -> Column:
    """Minutes since midnight, so many minutes earlier, around the clock."""
    return F.pmod(hour * 60 + minute - lead, F.lit(1440))


def is_https(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(r"^https://[^\s/]+")


def origin(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"^(https?://[^/?#]+)", 1), F.lit(""))


def posting_before(title: Column | str, cutoff: Column, told: Column | None = None) -> Column:
    """Whether a posting's period ended before the cutoff: by the year and quarter of its title, the year and month, the year, or else the day it tells."""
    t = F.coalesce(_col(title), F.lit(""))

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    by_quarter, by_month = r"(20\d\d)년?\s*(?:도\s*)?([1-4])분기", r"(20\d\d)[.\-년\s]+(\d{1,2})월"
    now = F.year(cutoff) * 12 + F.month(cutoff)
    quarter = number(by_quarter, 1) * 4 + number(by_quarter, 2) < F.year(cutoff) * 4 + F.quarter(cutoff)
    month = number(by_month, 1) * 12 + number(by_month, 2) < now
    year = F.when(number(r"(20\d\d)년", 1) < F.year(cutoff), True)
    day = told < cutoff if told is not None else F.lit(None).cast("boolean")
    return F.coalesce(quarter, month, year, day, F.lit(False))
