"""Korean addresses: merge keys, display parts, tokens and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import _col, any_of, clean_text, nfkc, plain_norm, squeeze, unescape

# The parts of an address.
ROAD = r"([가-힣A-Za-z0-9·]+?(?:로|길))\s?(?:(지하)\s*)?(\d+(?:-\d+)?)(?![가-힣\d])"
LOT = r"([가-힣]+\d*(?:동|리|가|읍|면))\s?(?:(지하)\s*)?(\d+(?:-\d+)?)(?:번지)?(?![가-힣\d])"
LOT_NUMBER = r"^(?:(지하)\s*)?(\d+(?:-\d+)?)(?:번지)?(?![가-힣\d])"
SIGUNGU = r"^([가-힣]{1,6}(?:시|군|구))(?![가-힣])"
SUB_GU = r"^([가-힣]{1,5}구)(?![가-힣])"
EUPMYEON = r"^([가-힣]{1,6}(?:읍|면))(?![가-힣])"
SEJONG_TWICE = r"^(세종특별자치시|세종시|세종)\s+(?:세종특별자치시|세종시|세종)(?![가-힣])"
SPACED_ROAD = r"([가-힣A-Za-z0-9·]+(?:로|길))\s+([가-힣\d]+길)"
SPACED_LANE = r"(로)\s+(\d+(?:번)?길)"
LOOKS_LIKE_ADDRESS = r"(?:[가-힣]+[시군구]\s|[가-힣A-Za-z0-9·]+(?:로|길|동|리|가)\s?\d)"
AND_OTHERS = r"\s*외\s*\d+\s*(?:곳|명|건|개소)?\s*$"
LOCATION = r"^\s*(.+?)\s*[(（]([^()（）]*)[)）]\s*$"
SEOUL_ROAD = r"([가-힣A-Za-z0-9·]+?(?:로|길))\s?(\d+(?:-\d+)?)(?![가-힣\d])"
SEOUL_START = r"(서울특별시|서울시|서울|경기도|인천|[가-힣]{1,4}(?:시|구|군)\s|[가-힣A-Za-z0-9·]+(?:로|길)\s?\d)"
DISTRICT = r"([가-힣]{1,4}구)(?![가-힣])"

PREFIX = "^(" + any_of(sorted([*fixed.ALIASES, *fixed.INTEGRATED], key=len, reverse=True)) + ")(?![가-힣])"


def strip(c: Column, chars: str = " ,") -> Column:
    return F.regexp_replace(c, rf"^[{chars}]+|[{chars}]+$", "")


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def after(c: Column, pattern: str) -> Column:
    """What follows a match at the beginning."""
    return strip(F.regexp_replace(c, pattern, ""))


def region_of(spelling: Column) -> Column:
    """The region that a spelling stands for, null for others."""
    pairs = [F.lit(x) for pair in fixed.ALIASES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), spelling)


def integrated_region(sigungu: Column, others: bool = False) -> Column:
    """The integrated city's region by the first word of the district; ``others``: any other district is 전남."""
    head = F.split(sigungu, " ")[0]
    rest = F.when(head.rlike("(시|군)$"), "전남") if not others else F.when(head != "", "전남")
    return F.when(head.isin(fixed.GWANGJU_DISTRICTS), "광주").otherwise(rest)


def address_steps(address: Column | str, region: Column | str, variant: str = "merge", composed: bool = False) -> list[dict[str, Column]]:
    """Columns to add one step after another; the last step's ``address_key`` is null if a rule fails.

    variant "southwest": other districts of the integrated city are 전남, the district is
    always needed, and a region that is the integrated city itself is not accepted.
    ``composed``: the text is in NFKC already.
    """
    c = F.col
    merge = variant == "merge"
    integrated = c("_prefix").isin(fixed.INTEGRATED)
    detected = F.when(integrated, integrated_region(c("sigungu"), others=not merge)).otherwise(region_of(c("_prefix")))
    same = F.coalesce(region_of(_col(region)), _col(region)) == c("_detected")
    accepted = F.when(_col(region).isin(fixed.INTEGRATED), F.lit(merge)).otherwise(same)
    needed = (c("sigungu") != "") | ((c("_detected") == "세종") if merge else F.lit(False))
    lot_text = F.when(c("_em").isNotNull(), c("_after_em")).otherwise(c("_rest"))
    under = lambda word: F.coalesce(F.nullif(word, F.lit("")), F.lit(""))
    number = lambda text, pattern, u, n: F.concat(under(F.regexp_extract(text, pattern, u)), F.regexp_extract(text, pattern, n))
    road = F.concat_ws("|", F.lit("도로"), plain_norm(first(c("_road_text"), ROAD)), number(c("_road_text"), ROAD, 2, 3))
    lot = F.concat_ws("|", F.lit("지번"), plain_norm(c("_em")), plain_norm(first(c("_lot_text"), LOT)), number(c("_lot_text"), LOT, 2, 3))
    bare = F.concat_ws("|", F.lit("지번"), plain_norm(c("_em")), number(c("_after_em"), LOT_NUMBER, 1, 2))
    return [
        {"_text": F.regexp_replace(strip(squeeze(F.coalesce(_col(address), F.lit(""))) if composed else clean_text(address), " ,./"), SEJONG_TWICE, "$1")},
        {"_prefix": first(c("_text"), PREFIX), "_tail": after(c("_text"), PREFIX)},
        {"_si": first(c("_tail"), SIGUNGU)},
        {"_tail2": F.when(c("_si").isNotNull(), after(c("_tail"), SIGUNGU)).otherwise(c("_tail"))},
        {"_gu": F.when(c("_si").endswith("시"), first(c("_tail2"), SUB_GU))},
        {"_rest": F.when(c("_gu").isNotNull(), after(c("_tail2"), SUB_GU)).otherwise(c("_tail2")), "sigungu": F.concat_ws(" ", "_si", "_gu")},
        {"_detected": detected, "_em": first(c("_rest"), EUPMYEON)},
        {
            "_after_em": after(c("_rest"), EUPMYEON),
            "_road_text": F.regexp_replace(c("_rest"), SPACED_ROAD, "$1$2"),
        },
        {"_lot_text": lot_text},
        {
            "_locator": F.when(first(c("_road_text"), ROAD).isNotNull(), road)
            .when(first(c("_lot_text"), LOT).isNotNull(), lot)
            .when(c("_em").isNotNull() & first(c("_after_em"), LOT_NUMBER, 2).isNotNull(), bare)
        },
        {"_ok": F.coalesce(c("_prefix").isNotNull() & c("_detected").isNotNull() & needed & accepted & c("_locator").isNotNull(), F.lit(False))},
        {
            "address_key": F.when(c("_ok"), F.concat_ws("|", "_detected", "sigungu", "_locator")),
            "cleaned_address": F.when(c("_ok"), F.concat_ws(" ", "_prefix", F.nullif("sigungu", F.lit("")), F.nullif("_rest", F.lit("")))),
        },
    ]


def with_address(df, address: str = "address", region: str = "region", variant: str = "merge", composed: bool = False):
    """The rows with address_key, cleaned_address and sigungu; null where the address can't be placed in the region."""
    made = []
    for step in address_steps(address, region, variant, composed):
        df = df.withColumns(step)
        made += step
    df = df.withColumn("sigungu", F.when(F.col("_ok"), F.col("sigungu")))
    return df.drop(*[x for x in made if x.startswith("_")])


def with_location(df, location: str = "location"):
    """'name (address)' in Seoul: adds loc_name, loc_address, loc_key, loc_district; null where a rule fails."""
    c = F.col
    s = squeeze
    df = df.withColumn("_l", F.regexp_replace(F.trim(nfkc(F.coalesce(c(location), F.lit("")))), AND_OTHERS, ""))
    df = df.withColumns({"_n": F.regexp_extract("_l", LOCATION, 1), "_a": F.regexp_extract("_l", LOCATION, 2)})
    df = df.withColumns(
        {
            "_n": F.regexp_replace(strip(s("_n"), " –,./-"), fixed.PERSON_FIRST, ""),
            "_a": F.regexp_replace(F.regexp_replace(strip(s("_a"), " ,./"), fixed.PERSON_FIRST, ""), fixed.PERSON_LAST, ""),
        }
    )
    bad = (
        (F.length("_n") < 2)
        | (F.length("_a") < 4)
        | F.lower("_n").rlike(any_of(fixed.NOT_RESTAURANT_WORDS))
        | c("_n").rlike(r"호텔\s*$")
        | c("_n").rlike(r"(?U)^[\d\W_]+$")
    )
    df = df.withColumn("_a", F.regexp_replace("_a", SPACED_LANE, "$1$2"))
    # from the first word that is a region or a road
    df = df.withColumns({"_bad": bad, "_from": strip(F.regexp_replace("_a", rf"^.*?(?={SEOUL_START})", ""), " ,./")})
    df = df.withColumns({"_d": F.regexp_extract("_from", DISTRICT, 1), "_before": F.trim(F.regexp_extract("_from", rf"^(.*?){DISTRICT}", 1))})
    ok = (
        ~c("_bad")
        & first(c("_from"), SEOUL_ROAD).isNotNull()
        & c("_d").isin(fixed.SEOUL_DISTRICTS)
        & c("_before").isin("", "서울", "서울시", "서울특별시")
    )
    key = F.concat_ws("|", F.lit("서울"), "_d", plain_norm(F.regexp_extract("_a", SEOUL_ROAD, 1)), F.regexp_extract("_a", SEOUL_ROAD, 2))
    return df.withColumns(
        {"loc_name": F.when(ok, c("_n")), "loc_address": F.when(ok, c("_from")), "loc_key": F.when(ok, key), "loc_district": F.when(ok, c("_d"))}
    ).drop("_l", "_n", "_a", "_bad", "_from", "_d", "_before")


def address_rank(c: Column | str) -> Column:
    """How good an address is to show: a district of Seoul, the city, the length."""
    c = _col(c)
    return F.struct(c.rlike(any_of(fixed.SEOUL_DISTRICTS)).alias("district"), c.contains("서울").alias("city"), F.length(c).alias("length"))


def first_contained(c: Column | str, words: list[str]) -> Column:
    """The first of the words, in their order, that the text contains."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(_col(c), w)), F.lit(0)) if words else F.lit(None).cast("string")


def address_tokens(c: Column | str) -> Column:
    """Words of an address that is composed (NFKC) already: regions in their short form, no brackets, no lot suffix, 세종 once.

    Spark allows no Python step inside of array functions, so that callers compose first.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\([^)]*\)", " "), ",", " ")
    pieces = F.filter(F.split(squeeze(text), " "), lambda x: x != "")
    second = F.get(pieces, F.lit(1))
    city = F.when(second.isin(fixed.GWANGJU_DISTRICTS), F.lit("광주")).otherwise(F.lit("전남"))

    def short(x: Column, i: Column) -> Column:
        plain = F.coalesce(region_of(x), x)
        named = F.when((i == 0) & x.isin(fixed.INTEGRATED), F.when(F.size(pieces) > 1, city).otherwise(x)).otherwise(plain)
        return F.regexp_replace(named, "^([0-9-]+)번지$", "$1")

    tokens = F.transform(pieces, short)
    return F.filter(tokens, lambda x, i: (x != "") & ~F.coalesce((x == "세종") & (F.get(tokens, i - 1) == "세종"), F.lit(False)))


def contains_run(haystack: Column, needle: Column) -> Column:
    """Whether the needle's words stand in the haystack one after another."""
    gap = F.size(haystack) - F.size(needle)
    places = F.sequence(F.lit(0), F.greatest(gap, F.lit(0)))
    return (F.size(needle) > 0) & (gap >= 0) & F.exists(places, lambda i: F.slice(haystack, i + 1, F.greatest(F.size(needle), F.lit(1))) == needle)


def same_address(catalog: Column, asked: Column, record_region: Column | None = None) -> Column:
    """Whether the asked address's words stand in the catalog's; regions that are told must agree."""
    asked_region, own_region = region_of(F.get(asked, F.lit(0))), region_of(F.get(catalog, F.lit(0)))
    told = own_region if record_region is None else F.coalesce(region_of(record_region), record_region, own_region)
    enough = (F.size(asked) >= 3) & (F.size(catalog) >= 2)
    clash = F.coalesce(asked_region != told, F.lit(False))
    rest = F.slice(asked, 2, F.greatest(F.size(asked) - 1, F.lit(1)))
    without_region = (F.size(asked) >= 4) & asked_region.isNotNull() & own_region.isNull() & contains_run(catalog, rest)
    return F.coalesce(enough & ~clash & (contains_run(catalog, asked) | without_region), F.lit(False))


def same_provider_address(ours: Column, theirs: Column) -> Column:
    """Any two normalised addresses are equal, or the shorter of 6 characters or more is in the longer."""

    def alike(a: Column, b: Column) -> Column:
        short = F.least(F.length(a), F.length(b)) >= 6
        return (a == b) | (short & (F.contains(a, b) | F.contains(b, a)))

    return F.coalesce(F.exists(F.filter(ours, lambda x: x != ""), lambda a: F.exists(F.filter(theirs, lambda x: x != ""), lambda b: alike(a, b))), F.lit(False))


def official(region: Column) -> Column:
    """The region's full name."""
    pairs = [F.lit(x) for r, spellings in fixed.REGION_SPELLINGS.items() for x in (r, spellings[0])]
    return F.element_at(F.create_map(*pairs), region)


def repaired(c: Column | str, hint: Column | None = None) -> Column:
    """Addresses as they are written in ledgers, brought to the form with the region in front.

    Owners' names go; the address begins at its first region or district; the region gets
    its full name, or the hint's if the address names none. Composed text is expected.
    """
    s = strip(squeeze(F.coalesce(_col(c), F.lit(""))), " ,./")
    s = F.regexp_replace(F.regexp_replace(s, fixed.PERSON_FIRST, ""), fixed.PERSON_LAST, "")
    spellings = any_of(sorted([*fixed.ALIASES, *fixed.INTEGRATED], key=len, reverse=True))
    s = F.regexp_replace(s, rf"^.*?(?=(?:^|[^가-힣])(?:{spellings})(?![가-힣]))", "")
    s = strip(s, " ,./()")
    prefix = first(s, PREFIX)
    rest = after(s, PREFIX)
    named = F.when(prefix.isin(fixed.INTEGRATED), prefix).otherwise(official(region_of(prefix)))
    hinted = official(F.coalesce(region_of(hint), hint)) if hint is not None else F.lit(None).cast("string")
    district = s.rlike(SIGUNGU)
    return F.when(prefix.isNotNull(), F.concat_ws(" ", named, rest)).when(district & hinted.isNotNull(), F.concat_ws(" ", hinted, s)).when(s != "", s)


def place_and_address(place: Column | str, address: Column | str | None = None) -> Column:
    """struct<place, address> of ledger cells: the address column, else the last bracket that looks like one, else what follows a comma.

    The place is what is left. Composed text is expected.
    """
    p = squeeze(F.coalesce(_col(place), F.lit("")))
    own = F.nullif(squeeze(F.coalesce(_col(address), F.lit(""))), F.lit("")) if address is not None else F.lit(None).cast("string")
    bracket = F.nullif(F.regexp_extract(p, rf"[(（]([^()（）]*{LOOKS_LIKE_ADDRESS}[^()（）]*)[)）]\s*$", 1), F.lit(""))
    comma = F.nullif(F.regexp_extract(p, rf"^[^,]+,\s*(.*{LOOKS_LIKE_ADDRESS}.*)$", 1), F.lit(""))
    name = F.when(bracket.isNotNull(), F.regexp_replace(p, r"\s*[(（][^()（）]*[)）]\s*$", "")).when(own.isNull() & comma.isNotNull(), F.regexp_replace(p, r",.*$", "")).otherwise(p)
    return F.struct(F.trim(name).alias("place"), F.coalesce(own, bracket, comma).alias("address"))


def district_hint(*texts: Column | str) -> Column:
    """The first city or district, in the order of the fixed list, that the texts name."""
    words = [w for group in fixed.DISTRICTS.values() for w in group] + list(fixed.SHARED_DISTRICTS)
    return first_contained(F.concat_ws(" ", *[F.coalesce(_col(t), F.lit("")) for t in texts]), words)


def placed_steps(address: Column | str, hint: Column | None = None, validated: bool = False) -> list[dict[str, Column]]:
    """Columns to add one after another; the last have placed_region and placed_address, null where an address can't be placed.

    An address needs a road or lot with a number, a province and, but for 세종, a city or
    district. The province is the one that is written, else that of the district; districts
    that several provinces have need the hint. ``validated``: addresses of an official
    registry may lack both, and are then in the hint's province.
    """
    c = F.col
    pairs = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    once = lambda t: F.regexp_replace(F.regexp_replace(t, fixed.SEJONG_REPEATED, "세종특별자치시"), fixed.PROVINCE_TWICE, "$1")
    word = lambda w: F.when(c("_raw").rlike(f"(?<![0-9A-Za-z_가-힣]){w}(?![0-9A-Za-z_가-힣])"), F.lit(fixed.PROVINCES[w]))
    hinted = F.element_at(pairs(fixed.PROVINCES), hint) if hint is not None else F.lit(None).cast("string")
    region_of_city = {w: fixed.PROVINCES[r] for r, group in fixed.DISTRICTS.items() for w in group}
    shared = F.coalesce(*[F.when((c("_city") == w) & (hint.isin(regions) if hint is not None else F.lit(False)), hinted) for w, regions in fixed.SHARED_DISTRICTS.items()])
    sejong = c("_raw").contains("세종") | ((hint == "세종") & c("_written").isNull() if hint is not None else F.lit(False))
    by_city = F.coalesce(F.element_at(pairs(region_of_city), c("_city")), shared)
    short = {v: k for k, v in reversed(fixed.PROVINCES.items()) if len(k) == 2}
    return [
        {"_raw": once(F.regexp_replace(squeeze(F.regexp_replace(F.trim(unescape(F.coalesce(_col(address), F.lit("")))), r"[\r\n\t]+", " ")), r"\s*외\s*\d+.*$", ""))},
        {"_written": F.coalesce(*[word(w) for w in fixed.PROVINCES]), "_city": district_hint("_raw")},
        {"_sejong": F.coalesce(sejong, F.lit(False))},
        {"_province": F.when(c("_sejong"), "세종특별자치시").otherwise(F.coalesce(c("_written"), by_city, *([hinted] if validated else [])))},
        {
            "_ok": F.coalesce(c("_raw").rlike(fixed.NUMBERED) & c("_province").isNotNull() & (c("_sejong") | c("_city").isNotNull() | F.lit(validated)), F.lit(False)),
            "_from_province": F.expr("locate(_province, _raw)"),
            "_from_city": F.expr("locate(_city, _raw)"),
        },
        {
            "_clean": F.when(c("_from_province") > 0, F.expr("substring(_raw, _from_province)"))
            .when(c("_from_city") > 0, F.concat_ws(" ", "_province", F.expr("substring(_raw, _from_city)")))
            .when(F.lit(validated) & c("_sejong") & c("_raw").startswith("세종시"), F.regexp_replace("_raw", r"^세종시\s*", "세종특별자치시 "))
            .when(F.lit(validated), F.concat_ws(" ", "_province", "_raw"))
        },
        {"_clean": squeeze(once(F.trim("_clean")))},
        {"_ok": c("_ok") & F.coalesce(c("_clean").rlike(r"\d"), F.lit(False))},
        {"placed_region": F.when(c("_ok"), F.element_at(pairs(short), c("_province"))), "placed_address": F.when(c("_ok"), c("_clean"))},
    ]


def with_placed(df, address: str = "address", hint: Column | None = None, validated: bool = False):
    """The rows with placed_region and placed_address."""
    made = []
    for step in placed_steps(address, hint, validated):
        df = df.withColumns(step)
        made += step
    return df.drop(*[x for x in made if x.startswith("_")])


def allowed_region(region: Column | str, allowed: list[str]) -> Column:
    """Whether a region, in any spelling, is among the allowed ones; the integrated city is if either of its regions is."""
    r = F.trim(_col(region))
    integrated = F.lit(bool({"광주", "전남"} & set(allowed)))
    return F.coalesce(F.when(r.isin(fixed.INTEGRATED), integrated).otherwise(region_of(r).isin(allowed)), F.lit(False))


def with_mended(df, address: str = "address", default: str = "region"):
    """Addresses of the southwest as ledgers have them, brought to the form with their region in front: mended_region, mended_address, mended_key.

    Owners and "and n others" go. A region is written out, that of the integrated city is told
    by its district; without one the district tells it, or else the default. An address that
    begins with neither is read again from the first place where one may begin. Null where
    no address can be parsed.
    """
    c = F.col
    pairs = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair])
    by_district = pairs({d: r for r, group in fixed.SOUTHWEST_DISTRICTS.items() for d in group})
    full = pairs({r: fixed.REGION_SPELLINGS[r][0] for r in fixed.SOUTHWEST_DISTRICTS})
    mine = lambda r: F.when(r.isin(list(fixed.SOUTHWEST_DISTRICTS)), r)

    def plain(x: Column) -> Column:
        for pattern in (fixed.PERSON_FIRST, fixed.PERSON_LAST, AND_OTHERS):
            x = F.regexp_replace(x, pattern, "")
        return F.when(F.length(x) >= 3, x)

    def settled(df, *names: str):
        """The columns as they are from here on: an explode is never merged with what follows, so that steps are computed once."""
        return df.withColumn("_once", F.explode(F.array(F.struct(*names)))).drop(*names).select("*", "_once.*").drop("_once")

    kept, made = [x for x in df.columns if x == "sigungu"], []
    df = df.withColumnsRenamed({x: "_own_sigungu" for x in kept})  # with_address tells one itself
    df = settled(df.withColumn("_x0", strip(clean_text(address), " ,./")), "_x0")
    for n in (0, 1):
        x, prefix, rest, region, key, written, clean = (f"_{k}{n}" for k in ("x", "prefix", "rest", "region", "key", "written", "clean"))
        if n:  # from the first place where an address may begin, if it begins with no region
            again = strip(F.regexp_extract("_x0", rf"^.+?({fixed.SOUTHWEST_START}.*)$", 1), " ,./")
            df = df.withColumn(x, F.when(c("_prefix0").isNull(), again))
        df = settled(df.withColumn(x, plain(c(x))).withColumn(prefix, first(c(x), PREFIX)).withColumn(rest, after(c(x), PREFIX)), x, prefix, rest)
        integrated, named = c(prefix).isin(fixed.INTEGRATED), c(prefix).isNotNull()
        district = first(F.when(named, c(rest)).otherwise(c(x)), SIGUNGU)
        own = F.when(integrated, integrated_region(district, others=True)).when(named, mine(region_of(c(prefix)))).when(district.isNotNull(), mine(F.coalesce(F.element_at(by_district, district), c(default))))
        df = df.withColumn(region, own)
        df = df.withColumn(written, F.when(c(region).isNotNull(), F.when(integrated, c(x)).otherwise(F.concat_ws(" ", F.element_at(full, c(region)), F.when(named, c(rest)).otherwise(c(x))))))
        df = with_address(settled(df, region, written), written, region, "southwest", composed=True).drop("sigungu").withColumnsRenamed({"address_key": key, "cleaned_address": clean})
        df = settled(df, key, clean)
        made += [x, prefix, rest, region, written, key, clean]
    found = c("_key0").isNotNull()
    df = df.withColumns({f"mended_{k}": F.when(found, c(f"_{a}0")).when(c("_key1").isNotNull(), c(f"_{a}1")) for k, a in (("region", "region"), ("address", "clean"), ("key", "key"))})
    return df.drop(*made).withColumnsRenamed({"_own_sigungu": x for x in kept})
