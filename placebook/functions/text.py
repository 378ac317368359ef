"""Normalisers of names and free text. NFKC and HTML unescaping are the only Python steps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _vector(kernel, returns: str = "string"):
    """An Arrow UDF that executors can import; made where a session is there."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return F.pandas_udf(kernel, returns)


def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def _unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(html.unescape, na_action="ignore")


def _fnv1a(s: pd.Series) -> pd.Series:
    """FNV-1a over UTF-8 in 64 bits, as the signed number of the same bits."""

    def one(text: str) -> int:
        h = 0xCBF29CE484222325
        for byte in text.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return s.map(one, na_action="ignore").astype("Int64")


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility composition. Plain ASCII, which it leaves alone, stays in the JVM."""
    c = _col(c)
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_vector(_nfkc)(c))


def unescape(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.contains("&"), _vector(_unescape)(c)).otherwise(c)


def fnv1a64(c: Column | str) -> Column:
    return _vector(_fnv1a, "long")(_col(c))


def rotation(c: Column | str, n: int) -> Column:
    """The unsigned FNV-1a hash modulo n: where a rotation through n choices begins."""
    h = fnv1a64(c)
    # unsigned = 2 * (h >>> 1) + (h & 1)
    return ((F.shiftrightunsigned(h, 1) % n) * (2 % n) + h.bitwiseAND(F.lit(1))) % n


def any_of(words: list[str]) -> str:
    """A pattern for any of the words as they are."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)\s+", " "), r"^ | $", "")


def clean_text(c: Column | str) -> Column:
    """NFKC, single spaces, trimmed; null gives ''."""
    return F.coalesce(squeeze(nfkc(c)), F.lit(""))


def norm_text(c: Column | str) -> Column:
    """NFKC, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(nfkc(c)), r"(?U)[\s\W_]+", "")


def plain_norm(c: Column | str) -> Column:
    """norm_text for text that is composed already: no Python step."""
    return F.regexp_replace(F.lower(_col(c)), r"(?U)[\s\W_]+", "")


def registry_name(c: Column | str) -> Column:
    """Registry names: unescaped, NFKC, without company marks, only Hangul syllables, a-z and digits."""
    low = F.lower(nfkc(unescape(F.coalesce(_col(c), F.lit("")))))
    return F.regexp_replace(F.regexp_replace(low, fixed.REGISTRY_MARKS, ""), fixed.NOT_NAME, "")


def business_name(c: Column | str) -> Column:
    """Names as index keys: without spaces, company marks and quotes at the ends."""
    s = F.regexp_replace(F.lower(F.trim(unescape(F.coalesce(_col(c), F.lit(""))))), r"(?U)\s+", "")
    s = F.regexp_replace(F.regexp_replace(s, fixed.MARK_FIRST, ""), fixed.MARK_LAST, "")
    return F.regexp_replace(s, fixed.QUOTES_AROUND, "")


def client_name(c: Column | str) -> Column:
    """Names as the client compares them: company marks go from both ends until none is left."""
    marks = any_of(fixed.COMPANY_MARKS)
    s = F.trim(F.lower(nfkc(c)))
    return F.regexp_replace(F.regexp_replace(s, rf"(?U)^(?:(?:{marks})\s*)+|(?:\s*(?:{marks}))+$", ""), r"(?U)\s+", "")


def place_name(c: Column | str) -> Column:
    """Names of places without bracketed text and main-branch marks."""
    s = F.regexp_replace(F.lower(nfkc(F.coalesce(_col(c), F.lit("")))), fixed.BRACKETED, "")
    return F.regexp_replace(F.regexp_replace(s, fixed.MAIN_BRANCH, ""), fixed.NOT_NAME, "")


def provider_text(c: Column | str) -> Column:
    s = F.regexp_replace(F.lower(nfkc(F.coalesce(_col(c), F.lit("")))), fixed.COUNTRY, "")
    return F.regexp_replace(s, fixed.NOT_NAME, "")


def phone_digits(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^0-9]", "")


def phone_link(c: Column | str) -> Column:
    """tel: link of the digits and a leading plus; null without digits."""
    kept = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^0-9+]", "")
    return F.when(F.length(kept) > 0, F.concat(F.lit("tel:"), kept))


def display_name(c: Column | str) -> Column:
    """Restaurant names for display: quotes, 'and n others', company marks in front and bracketed addresses go."""
    s = F.trim(unescape(F.coalesce(_col(c), F.lit(""))))
    for pattern in (fixed.QUOTES_AND_SPACES, fixed.OTHERS, fixed.SHOWN_MARK, fixed.ADDRESS_IN_BRACKETS):
        s = F.regexp_replace(s, pattern, "")
    return F.trim(s)


def last_word(c: Column | str) -> Column:
    """The last word: departments are known by it, whatever stands above them."""
    return F.element_at(F.split(squeeze(c), " "), -1)


def contains_any(c: Column | str, words: list[str]) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike(any_of(words))


def code_point_sum(c: Column | str) -> Column:
    """Sum of the code points of all characters."""
    return F.aggregate(F.filter(F.split(_col(c), ""), lambda x: x != ""), F.lit(0).cast("long"), lambda total, x: total + F.ascii(x))


def redact(c: Column | str) -> Column:
    """Names without phone numbers and without the owner's name in front or behind."""
    s = F.trim(F.regexp_replace(_col(c), fixed.PHONE, ""))
    return F.regexp_replace(F.regexp_replace(s, fixed.PERSON_FIRST, ""), fixed.PERSON_LAST, "")


def version_key(c: Column | str) -> Column:
    """Versions such as 1.10.2 as arrays that compare by number; missing parts count as 0."""
    parts = F.transform(F.split(_col(c), r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d*)", 1).try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
