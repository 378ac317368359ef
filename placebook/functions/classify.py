"""Meals, places, departments and dishes: ordered rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _col, any_of, clean_text, code_point_sum, contains_any, squeeze, unescape

# Endings of organisational units, titles of persons, names of sheets that are no department.
UNIT_ENDINGS = ["과", "담당관", "관", "센터", "사업소", "소방서", "위원회", "읍", "면", "동", "실", "국", "단", "본부", "처", "대변인", "팀", "소", "원", "부", "서", "비서실"]
GENERAL_NAMES = ["서식", "시책", "부서", "내역", "공개", "기관"]
EXPENSE_WORDS = ["업무추진비", "시책추진", "기관운영", "부서운영", "공개서식", "공개자료", "집행내역", "사용내역", "집행현황", "사용현황", "행정서식", "도약기반구축", "업무추진", "시책설명", "상생협력", "청사방호"]
PERSON_TITLES = ["시장", "부시장", "도지사", "부지사", "국장", "과장", "팀장", "주무관", "실장", "본부장", "단장", "소장", "의장", "부의장", "위원장"]
UNIT_OF_ROLE = {
    "과장": "과", "국장": "국", "실장": "실", "본부장": "본부", "단장": "단", "처장": "처", "부장": "부", "팀장": "팀",
    "소장": "소", "서장": "서", "원장": "원", "센터장": "센터", "위원장": "위원회",
}


def meal_purpose(c: Column | str) -> Column:
    """A purpose that has a meal word and no other; spaces don't count."""
    p = F.regexp_replace(F.coalesce(_col(c), F.lit("")), " ", "")
    return ~contains_any(p, fixed.NOT_MEAL_WORDS) & contains_any(p, fixed.MEAL_WORDS)


def meal_purpose_2(c: Column | str) -> Column:
    """The same by longer lists; no purpose at all counts as a meal."""
    p = F.regexp_replace(clean_text(c), " ", "")
    return F.when(p == "", True).otherwise(~contains_any(p, fixed.NOT_MEAL_WORDS_2) & contains_any(p, fixed.MEAL_WORDS_2))


def meal_3(purpose: Column | str, place: Column | str) -> Column:
    """Place out, purpose out, purpose in, place in, and then any purpose of two characters."""
    p, s = (F.trim(F.coalesce(_col(x), F.lit(""))) for x in (purpose, place))
    return (
        F.when(contains_any(s, fixed.PLACES_OUT_3), False)
        .when(contains_any(p, fixed.PURPOSES_OUT_3), False)
        .when(contains_any(p, fixed.PURPOSES_IN_3), True)
        .when(contains_any(s, fixed.PLACES_IN_3), True)
        .otherwise(F.length(p) >= 2)
    )


def many_places(c: Column | str) -> Column:
    """The text counts several places."""
    return F.coalesce(F.trim(_col(c)), F.lit("")).rlike("(?U)" + "|".join(fixed.MANY_PLACES))


def many_merchants(c: Column | str) -> Column:
    """The text lists several merchants outside of parentheses."""
    s = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\([^)]*\)", ""))
    name = "[가-힣a-zA-Z0-9]"
    return s.rlike(rf"{name}\s*,\s*{name}|{name}\s+및\s+{name}|{name}\s+/\s+{name}")


def meal_4(place: Column | str, purpose: Column | str) -> Column:
    s, p = (F.coalesce(_col(x), F.lit("")) for x in (place, purpose))
    name = F.trim(F.regexp_replace(F.trim(s), r"\s*\([0-9-]+\)$", ""))
    return (
        F.when((s == "") | s.isin(fixed.PLACES_NONE_4), False)
        .when(many_places(s) | many_places(p), False)
        .when(contains_any(name, fixed.PLACES_OUT_4) & ~contains_any(p, fixed.MEALS_4), False)
        .when(contains_any(p, fixed.PURPOSES_OUT_4), False)
        .when(contains_any(p, fixed.PURPOSES_IN_4) | contains_any(name, fixed.PLACES_IN_4), True)
        .otherwise((F.length(name) >= 2) & contains_any(p, fixed.TALKS_4))
    )


def not_restaurant(name: Column | str) -> Column:
    """Names of other trades, of hotels themselves, and names without a letter."""
    n = F.coalesce(_col(name), F.lit(""))
    return contains_any(F.lower(n), fixed.NOT_RESTAURANT_WORDS) | n.rlike(r"호텔\s*$") | n.rlike(r"(?U)^[\d\W_]+$")


def sum_row(cells: Column | str) -> Column:
    """Rows of sums in ledgers."""
    return F.coalesce(_col(cells), F.lit("")).rlike("합계|총계|소계")


def personal(c: Column | str) -> Column:
    """A person's name or title instead of a unit."""
    s = F.trim(F.coalesce(_col(c), F.lit("")))
    return s.isin(PERSON_TITLES) | s.rlike("^[가-힣]{2,4}\\s*(" + any_of(PERSON_TITLES) + ")$")


def _bare(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.trim(c), fixed.UNIT_BULLET, ""), fixed.UNIT_FORM, "")
    return F.trim(F.regexp_replace(s, fixed.UNIT_TAG, ""))


def general_department(c: Column | str) -> Column:
    """Names that tell no unit: too short, of a sheet or of a kind of expense."""
    s = F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[\s\d_\-()\[\].,'\"]+", ""))
    expense = s.rlike(any_of(EXPENSE_WORDS)) & ~s.rlike("(" + any_of(UNIT_ENDINGS) + ")$")
    return (F.length(s) <= 1) | s.startswith("sheet") | s.isin(GENERAL_NAMES) | expense


def valid_department(c: Column | str) -> Column:
    """Names of real units: a Hangul name with a unit's ending or a role's, no expense, no date."""
    s = _bare(F.coalesce(_col(c), F.lit("")))
    base = F.trim(F.regexp_replace(s, fixed.UNIT_WITH_NOTE, "$1"))
    ending = base.rlike("(" + any_of([*UNIT_ENDINGS, *UNIT_OF_ROLE]) + ")$")
    return (
        ~general_department(s)
        & ~F.regexp_replace(s, r"\s+", "").rlike(any_of(EXPENSE_WORDS))
        & ~s.rlike(fixed.UNIT_OF_PERIOD)
        & base.rlike("[가-힣]")
        & ending
        & (F.length(base) > 1)
    )


def canonical_department(c: Column | str) -> Column:
    """The unit itself: brackets, notes and quotes go, and a head's title becomes the unit's name."""
    s = F.trim(F.coalesce(_col(c), F.lit("")))
    s = F.trim(F.regexp_replace(s, fixed.UNIT_IN_BRACKETS, "$1"))
    s = _bare(s)
    s = F.trim(F.translate(F.regexp_replace(s, fixed.UNIT_FORM_NOTE, ""), "`'\"", ""))
    base = F.trim(F.regexp_replace(s, fixed.UNIT_WITH_NOTE, "$1"))
    s = F.when((base != s) & valid_department(base), base).otherwise(s)
    for role in sorted(UNIT_OF_ROLE, key=len, reverse=True):
        s = F.regexp_replace(s, f"{role}(?:님)?$", UNIT_OF_ROLE[role])
    return F.trim(F.regexp_replace(F.regexp_replace(s, fixed.UNIT_HONORIFIC, "$1"), fixed.HEAD_OF_REGION, "비서실"))


def title_department(c: Column | str) -> Column:
    """The unit that a posting's title names: in the last bracket that has one, or in front of the kind of expense."""
    t = F.trim(unescape(F.coalesce(_col(c), F.lit(""))))
    inside = F.filter(F.transform(F.regexp_extract_all(t, F.lit(fixed.TITLE_BRACKET), F.lit(1)), F.trim), valid_department)
    lead = F.regexp_extract(t, fixed.TITLE_LEAD, 1)
    found = F.coalesce(F.try_element_at(inside, F.lit(-1)), F.when(valid_department(lead), lead))
    return F.when(found.isNotNull(), canonical_department(found))


def purpose_department(c: Column | str) -> Column:
    """The unit that a purpose names in brackets, or else in front; names of persons don't count."""
    t = F.coalesce(_col(c), F.lit(""))
    end = "(?:" + any_of(UNIT_ENDINGS) + ")"
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (rf"[(\[]([가-힣A-Za-z0-9 ]+?{end})[)\]]", rf"^([가-힣A-Za-z0-9]+?{end})\s")])
    return F.when(~personal(found), found)


def institution(department: Column, given: Column) -> Column:
    """Fire stations and universities stand for themselves."""
    own = F.regexp_extract(department, fixed.OWN_INSTITUTION, 1)
    return F.coalesce(F.nullif(own, F.lit("")), given)


def leaf_department(c: Column | str) -> Column:
    """The last unit of a > b, the short form of an officer's office."""
    return F.regexp_replace(F.trim(F.element_at(F.split(_col(c), ">"), -1)), "담당관실$", "담당관")


def last_category(c: Column | str) -> Column:
    return F.trim(F.element_at(F.split(F.coalesce(_col(c), F.lit("")), ">"), -1))


def menus(name: Column | str, category: Column | str, curated: Column) -> Column:
    """Confirmed dishes first, and then those that the name or the last category spells out."""
    hay = F.concat_ws("\n", F.coalesce(_col(name), F.lit("")), last_category(category))
    told = F.array_compact(F.array(*[F.when(hay.rlike(any_of(v)), F.lit(v[0])) for v in fixed.MENUS]))
    given = F.coalesce(curated, F.array().cast("array<string>"))
    return F.concat(given, F.array_except(told, given))


def menu_for(found: Column, situation: str | None = None) -> Column:
    """The first dish, or the first one that fits the situation."""
    fits = found if situation is None else F.filter(found, lambda m: m.rlike(any_of(fixed.SITUATIONS[situation])))
    return F.get(fits, F.lit(0))


def _ladder(text: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def category_query(category: Column | str) -> Column:
    c = F.coalesce(_col(category), F.lit(""))
    return F.coalesce(_ladder(c, fixed.PHOTO_QUERIES), _ladder(c, fixed.CATEGORY_QUERIES), F.lit(fixed.ANY_QUERY))


def broad_query(category: Column | str) -> Column:
    return _ladder(F.coalesce(_col(category), F.lit("")), fixed.BROAD_QUERIES, F.lit(fixed.ANY_QUERY))


def photo_query(name: Column | str, category: Column | str, curated: Column) -> Column:
    """What to look for: a dish in the name, the first confirmed dish, the last category, one of three for Chinese houses, the category."""
    n = F.coalesce(_col(name), F.lit(""))
    dish = F.get(curated, F.lit(0))
    chinese = F.get(F.array(*map(F.lit, fixed.CHINESE_QUERIES)), (code_point_sum(n) % 3).cast("int"))
    return F.coalesce(
        _ladder(n, fixed.PHOTO_QUERIES),
        F.when(dish.isNotNull() & (dish != ""), F.coalesce(_ladder(dish, fixed.PHOTO_QUERIES), F.concat(dish, F.lit(" food")))),
        _ladder(last_category(category), fixed.PHOTO_QUERIES),
        F.when(F.coalesce(_col(category), F.lit("")).rlike(fixed.CHINESE), chinese),
        category_query(category),
    )


def title_pattern(query: Column | str) -> Column:
    """What a photo's title must match for the query, null if anything goes."""
    return _ladder(F.coalesce(_col(query), F.lit("")), [(m, "(?i)" + p) for m, p in fixed.TITLE_PATTERNS])


def region_label(parts: Column) -> Column:
    """Parts of a place as one name, each once and in order."""
    return squeeze(F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != ""))), " "))
