"""Queries of the serving side: ranking, menus, usage, menus and addresses by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as adr
from ..functions import classify, fixed, scalars, text
from ..operators import quality, ranking, serve
from .surrogates import choice, lat, lon, sql_choice, sql_flat, sql_lat, sql_lon, table


def _restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as search results on pages; ids repeat across pages."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 1000).alias("id"), F.col("c_custkey").alias("ordinal"), F.floor(F.col("c_custkey") / 15).alias("page"),
        F.when(F.col("c_custkey") % 13 != 0, F.col("c_custkey") * 37 % 2000).alias("distance"),
        F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 2 == 0).alias("is_open"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
    )


RS = """r AS (SELECT c_custkey % 1000 AS id, c_custkey AS ordinal, CAST(floor(c_custkey / 15) AS BIGINT) AS page, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey * 37 % 2000 END AS distance,
 CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 2 = 0 END AS is_open, c_mktsegment AS segment, c_nationkey AS nation FROM customer)"""


def first_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.first_unique(_restaurants(spark, sf_dir), "id", ["page", "ordinal"]).select("id", "ordinal")


FIRST_UNIQUE_SQL = f"WITH {RS}, f AS (SELECT id, min(ordinal) AS ordinal FROM r GROUP BY id) SELECT id, ordinal FROM f ORDER BY ordinal LIMIT 13"


def nearest_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.nearest_open(_restaurants(spark, sf_dir)).select("ordinal", "distance")


NEAREST_OPEN_SQL = f"WITH {RS} SELECT ordinal, distance FROM r WHERE coalesce(is_open, true) ORDER BY distance ASC NULLS LAST, ordinal LIMIT 13"


def prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in the prioritised order: matched by distance, then the others as they come."""
    rows = _restaurants(spark, sf_dir)
    return serve.prioritised(rows, F.col("nation") == 7).select("ordinal", (F.col("nation") == 7).alias("is_matched"))


PRIORITISED_SQL = f"WITH {RS} SELECT ordinal, nation = 7 AS is_matched FROM r ORDER BY nation <> 7, CASE WHEN nation = 7 THEN coalesce(distance, 2147483647) END, ordinal"


def prioritised_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place in the prioritised order, counted from 1."""
    return serve.prioritised_places(_restaurants(spark, sf_dir), F.col("nation") == 7).select("place", "ordinal", (F.col("nation") == 7).alias("is_matched"))


PRIORITISED_PLACES_SQL = f"WITH {RS} SELECT row_number() OVER (ORDER BY nation <> 7, CASE WHEN nation = 7 THEN coalesce(distance, 2147483647) END, ordinal) AS place, ordinal, nation = 7 AS is_matched FROM r"


def situation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restaurants that fit; for a situation that none fits, all."""
    rows = _restaurants(spark, sf_dir)
    some = serve.fitting(rows, F.col("segment") == "BUILDING").groupBy(F.lit("some").alias("situation")).agg(F.count(F.lit(1)).alias("n"))
    none = serve.fitting(rows, F.col("segment") == "NOWHERE").groupBy(F.lit("none").alias("situation")).agg(F.count(F.lit(1)).alias("n"))
    return some.unionByName(none)


FALLBACK_SQL = """SELECT 'some' AS situation, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'none', count(*) FROM customer"""

NAMES = ["시골 김밥 본점", "평양냉면집", "돈까스하우스", "신흥관", "바다횟집", "마라탕 천국", "행복식당", "삼거리 순대국", "피자 앤 파스타", "자장면 나라"]
CATEGORIES = ["음식점 > 한식", "음식점 > 일식 > 초밥", "음식점 > 중식", "음식점 > 분식 > 떡볶이", "음식점 > 양식 > 스테이크", "카페", "음식점 > 해물,생선"]


def _menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ordinal"), choice(NAMES, "c_custkey").alias("name"), choice(CATEGORIES, "c_custkey").alias("category"),
        F.when(F.col("c_custkey") % 9 == 0, F.array(F.lit("탕수육"), F.lit("냉면"))).alias("curated"), (F.col("c_custkey") * 37 % 2000).alias("distance"))
    return rows.withColumn("menus", classify.menus("name", "category", F.col("curated")))


def menu_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All restaurants of every dish, each with its place."""
    return serve.menu_candidates(_menus(spark, sf_dir)).select("menu", "restaurant_count", "nearest", "place", "id", "distance")


def _told_sql() -> str:
    rules = " UNION ALL ".join(
        f"SELECT id, distance, '{v[0]}' AS menu FROM m WHERE regexp_matches(name || chr(10) || trim(list_last(string_split(category, '>'))), '{'|'.join(v)}')" for v in fixed.MENUS
    )
    return f"""WITH m AS (SELECT c_custkey AS id, {sql_choice(NAMES, "c_custkey")} AS name, {sql_choice(CATEGORIES, "c_custkey")} AS category, c_custkey * 37 % 2000 AS distance, c_custkey % 9 = 0 AS curated FROM customer),
 e AS (SELECT id, distance, menu FROM ({rules}) UNION SELECT id, distance, '탕수육' FROM m WHERE curated UNION SELECT id, distance, '냉면' FROM m WHERE curated)"""


MENU_SQL = _told_sql() + " SELECT menu, count(*) OVER w AS restaurant_count, min(distance) OVER w AS nearest, row_number() OVER (PARTITION BY menu ORDER BY distance, id) AS place, id, distance FROM e WINDOW w AS (PARTITION BY menu)"


def photo_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _menus(spark, sf_dir).withColumn("query", classify.photo_query("name", "category", F.col("curated")))
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max(classify.broad_query("category")).alias("broad"), F.max(F.coalesce(classify.title_pattern("query"), F.lit(""))).alias("title"))


def _case(value: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE {otherwise} END"


def _photo_sql() -> str:
    last = "trim(list_last(string_split(category, '>')))"
    chinese = f"CASE WHEN regexp_matches(category, '{fixed.CHINESE}') THEN ([{', '.join(repr(q) for q in fixed.CHINESE_QUERIES)}])[CAST(list_sum(list_transform(string_split(name, ''), lambda c: unicode(c))) % 3 + 1 AS INT)] END"
    rest = f"coalesce({_case(last, fixed.PHOTO_QUERIES, 'NULL')}, {chinese}, {_case('category', fixed.PHOTO_QUERIES, 'NULL')}, {_case('category', fixed.CATEGORY_QUERIES, repr(fixed.ANY_QUERY))})"
    return f"""WITH m AS (SELECT c_custkey AS id, {sql_choice(NAMES, "c_custkey")} AS name, {sql_choice(CATEGORIES, "c_custkey")} AS category, c_custkey % 9 = 0 AS curated FROM customer),
 q AS (SELECT *, coalesce({_case("name", fixed.PHOTO_QUERIES, "NULL")}, CASE WHEN curated THEN 'tangsuyuk Korean sweet sour pork' END, {rest}) AS query FROM m)
SELECT query, count(*) AS n, min(id) AS first_id, max({_case("category", fixed.BROAD_QUERIES, repr(fixed.ANY_QUERY))}) AS broad,
 max({_case("query", [(a, "(?i)" + b) for a, b in fixed.TITLE_PATTERNS], "''")}) AS title FROM q GROUP BY query"""


def choice_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.choice_ranking(table(spark, sf_dir, "events"), "event_type")


CHOICE_SQL = "SELECT event_type, count(*) AS n_choices FROM events GROUP BY event_type"
USED = ["종로구", "  강남구 ", "현재 위치", "", "마포구", "지정 지역", "해운대구"]


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(choice(USED, "user_id").alias("name"), "ts", lat("event_id").alias("latitude"), lon("event_id").alias("longitude"))
    return serve.region_usage(log)


USAGE = f"""u AS (SELECT trim({sql_choice(USED, "user_id")}) AS name, ts, {sql_lat("event_id")} AS latitude, {sql_lon("event_id")} AS longitude FROM events),
 g AS (SELECT name, count(*) AS n_used, max(ts) AS last_used, arg_min(latitude, ts) AS latitude, arg_min(longitude, ts) AS longitude FROM u WHERE name NOT IN ('', '현재 위치', '지정 지역') GROUP BY name)"""


def region_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir)


def frequent_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.frequent(_usage(spark, sf_dir)).select("name", "n_used")


def history_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("r"), F.col("user_id") % 20)).alias("region"), "ts", "event_type")
    return serve.history_by_region(log, "region", "ts", "기타 지역").select("region", "newest", "n_choices", "place", "ts", "event_type")


HISTORY_SQL = """SELECT region, max(ts) OVER w AS newest, count(*) OVER w AS n_choices, row_number() OVER (PARTITION BY region ORDER BY ts DESC, event_type DESC) AS place, ts, event_type
FROM (SELECT CASE WHEN user_id % 4 <> 0 THEN 'r' || (user_id % 20) ELSE '기타 지역' END AS region, ts, event_type FROM events) WINDOW w AS (PARTITION BY region)"""


def nearest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest distance to each name, and the two nearest names."""
    c = table(spark, sf_dir, "customer").withColumn("metres", F.round(scalars.flat_distance(lat("c_custkey"), lon("c_custkey"), F.lit(36.0), F.lit(127.5))).cast("long"))
    return serve.nearest_names(c.withColumnRenamed("c_mktsegment", "name"), "name", "metres")


NEAREST_REGIONS_SQL = f"SELECT c_mktsegment AS name, CAST(round(min({sql_flat(sql_lat('c_custkey'), sql_lon('c_custkey'), '36.0', '127.5')})) AS BIGINT) AS metres FROM customer GROUP BY 1 ORDER BY metres, name LIMIT 2"

PURPOSES = ["직원 간담회 식대", "커피 구입", "업무협의 오찬", "", "도시락 구매", "현안 논의", "시책 추진 회의", "화환 발송", "출장", "체육대회 격려"]
PLACES = ["행복식당", "스타벅스 시청점", "가연, 서로히", "본가(중구, 무교로)", "롯데호텔", "한우마을 외 2곳", "회의실", "이마트", "바다횟집 (051-123-4567)", "김밥천국"]


def meal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(choice(PURPOSES, "p_partkey").alias("purpose"), F.get(F.array(*map(F.lit, PLACES)), (F.floor(F.col("p_partkey") / 10) % 10).cast("int")).alias("place"))
    return rows.groupBy("purpose", "place").agg(F.count(F.lit(1)).alias("n")).select(
        "purpose", "place", "n", classify.meal_purpose("purpose").alias("rule_1"), classify.meal_purpose_2("purpose").alias("rule_2"), classify.meal_3("purpose", "place").alias("rule_3"),
        classify.meal_4("place", "purpose").alias("rule_4"), classify.many_merchants("place").alias("many"), classify.many_places("place").alias("counted"), classify.not_restaurant("place").alias("no_restaurant"),
    )


def _any(value: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{w}')" for w in words) + ")"


def _meal_sql() -> str:
    p, s, q = "replace(purpose, ' ', '')", "place", "purpose"
    name = r"trim(regexp_replace(place, '\s*\([0-9-]+\)$', ''))"
    many = r"(\D|^)?(외|등)\s*\d+\s*(개소|곳|점|건|명|인)|\d+\s*개소|(외|등)\s*[1-9]($|[^0-9A-Za-z_가-힣])"
    bare = r"regexp_replace(place, '\([^)]*\)', '', 'g')"
    return f"""WITH b AS (SELECT {sql_choice(PURPOSES, "p_partkey")} AS purpose, ([{", ".join(repr(x) for x in PLACES)}])[(p_partkey // 10) % 10 + 1] AS place FROM part), g AS (SELECT purpose, place, count(*) AS n FROM b GROUP BY ALL)
SELECT purpose, place, n, NOT {_any(p, fixed.NOT_MEAL_WORDS)} AND {_any(p, fixed.MEAL_WORDS)} AS rule_1,
 {p} = '' OR (NOT {_any(p, fixed.NOT_MEAL_WORDS_2)} AND {_any(p, fixed.MEAL_WORDS_2)}) AS rule_2,
 CASE WHEN {_any(s, fixed.PLACES_OUT_3)} THEN false WHEN {_any(q, fixed.PURPOSES_OUT_3)} THEN false WHEN {_any(q, fixed.PURPOSES_IN_3)} THEN true WHEN {_any(s, fixed.PLACES_IN_3)} THEN true ELSE length(purpose) >= 2 END AS rule_3,
 CASE WHEN place IN ('', {", ".join(repr(x) for x in fixed.PLACES_NONE_4)}) THEN false WHEN regexp_matches(place, '{many}') OR regexp_matches(purpose, '{many}') THEN false
  WHEN {_any(name, fixed.PLACES_OUT_4)} AND NOT {_any(q, fixed.MEALS_4)} THEN false WHEN {_any(q, fixed.PURPOSES_OUT_4)} THEN false WHEN {_any(q, fixed.PURPOSES_IN_4)} OR {_any(name, fixed.PLACES_IN_4)} THEN true
  ELSE length({name}) >= 2 AND {_any(q, fixed.TALKS_4)} END AS rule_4,
 regexp_matches({bare}, '[가-힣a-zA-Z0-9]\\s*,\\s*[가-힣a-zA-Z0-9]|[가-힣a-zA-Z0-9]\\s+및\\s+[가-힣a-zA-Z0-9]') AS many, regexp_matches(place, '{many}') AS counted,
 {_any("lower(place)", fixed.NOT_RESTAURANT_WORDS)} OR regexp_matches(place, '호텔\\s*$') AS no_restaurant FROM g"""


#: Addresses, their region, and the key that each must get; RE2 has no look-ahead, so that the SQL side tells the expected keys.
ADDRESSES = [
    ("서울특별시 중구 무교로 21", "서울", "서울|중구|도로|무교로|21"),
    ("서울특별시 중구 세종대로 20길 23", "서울", "서울|중구|도로|세종대로20길|23"),
    ("서울특별시 중구 태평로1가 31-20", "서울", "서울|중구|지번|태평로1가|31-20"),
    ("경기도 수원시 팔달구 인계동 1113-1", "경기", "경기|수원시 팔달구|지번|인계동|1113-1"),
    ("세종특별자치시 세종특별자치시 한누리대로 2130", "세종", "세종||도로|한누리대로|2130"),
    ("서울특별시 중구 세종대로 지하 101", "서울", "서울|중구|도로|세종대로|지하101"),
    ("전남광주통합특별시 북구 우치로 100", "광주", "광주|북구|도로|우치로|100"),
    ("부산광역시 중구 중앙대로 1", "대구", None),
    ("경기도 무교로 21", "경기", None),
]


def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", choice([a for a, _, _ in ADDRESSES], "s_suppkey").alias("address"), choice([r for _, r, _ in ADDRESSES], "s_suppkey").alias("region"))
    return adr.with_address(rows).select("s_suppkey", "address_key")


ADDRESS_SQL = "SELECT s_suppkey, ([" + ", ".join("NULL" if k is None else f"'{k}'" for _, _, k in ADDRESSES) + f"])[s_suppkey % {len(ADDRESSES)} + 1] AS address_key FROM supplier"

DATES = [("'26. 8. 4.", "2026-08-04"), ("20260230", None), ("2025년 3월 9일", "2025-03-09"), ("집행 2024-12-31 19:00", "2024-12-31"), ("20240229", "2024-02-29"), ("없음", None)]


def korean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", choice([d for d, _ in DATES], "s_suppkey").alias("told"))
    return rows.select("s_suppkey", scalars.korean_date("told").alias("day"), F.add_months(scalars.korean_date("told"), -18).alias("from_day"))


DATES_SQL = "WITH d AS (SELECT s_suppkey, CAST(([" + ", ".join("NULL" if k is None else f"'{k}'" for _, k in DATES) + f"])[s_suppkey % {len(DATES)} + 1] AS DATE) AS day FROM supplier) SELECT s_suppkey, day, CAST(day - INTERVAL 18 MONTH AS DATE) AS from_day FROM d"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and the origin of each page."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", scalars.origin("url").alias("origin"), F.size(links).cast("long").alias("n_links"), F.size(F.array_distinct(links)).cast("long").alias("n_distinct"), scalars.is_https("url").alias("https"))


LINKS_SQL = """WITH l AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)
SELECT page_id, nullif(regexp_extract(url, '^(https?://[^/?#]+)', 1), '') AS origin, len(links) AS n_links, len(list_distinct(links)) AS n_distinct, regexp_matches(url, '^https://[^\\s/]+') AS https FROM l"""


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties lack a key, and the value of another."""
    rows = table(spark, sf_dir, "events")
    lacks = quality.missing_keys(F.col("props"), ["k", "z"])
    return rows.groupBy(F.array_join(lacks, ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


JSON_SQL = """WITH e AS (SELECT *, json_keys(props) AS ks FROM events) SELECT array_to_string(list_filter(['k', 'z'], lambda x: NOT list_contains(ks, x)), ',') AS missing, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM e GROUP BY 1"""


def workdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of orders but for weekends and holidays, which are here the days that few ordered on."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return serve.workdays(days, days.groupBy("day").agg(F.count(F.lit(1)).alias("n")).filter("n < 5").select("day"))


WORKDAYS_SQL = """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT day FROM d WHERE n >= 5 AND dayofweek(day) NOT IN (0, 6) AND year(day) IN (SELECT year(day) FROM d WHERE n < 5)"""


def shuffled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every restaurant with its place in an order that a seed decides, and whether it is its segment's pick."""
    rows = _restaurants(spark, sf_dir)
    one = ranking.picked(rows, ["segment"], ["ordinal"], seed=11).select(F.col("ordinal").alias("_o"))
    placed = ranking.shuffled(rows, ["ordinal"], seed=7)
    out = placed.join(one, F.col("ordinal") == F.col("_o"), "left").groupBy("segment")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count("_o").alias("n_picked"), F.count_distinct("place").alias("n_places"))


SHUFFLED_SQL = "SELECT c_mktsegment AS segment, count(*) AS n, 1::BIGINT AS n_picked, count(*) AS n_places FROM customer GROUP BY 1"


def text_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names normalised, digests and digits, on text that is composed already."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.plain_norm("c_name").alias("norm"), text.phone_digits("c_name").alias("digits"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha"), text.last_word(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("last"), text.code_point_sum("c_mktsegment").alias("points"))


NORMS_SQL = """SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS norm, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, sha256(c_name) AS sha, c_name AS last, list_sum(list_transform(string_split(c_mktsegment, ''), lambda c: unicode(c)))::BIGINT AS points FROM customer"""


def unique_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos dealt out in each request, no id and no address twice."""
    k = F.col("c_custkey")
    named = lambda prefix, n: F.struct(F.concat(F.lit(prefix), n.cast("string")).alias("id"), F.concat(F.lit(f"https://{prefix}/"), F.floor(n / 2).cast("string")).alias("url"))
    rows = table(spark, sf_dir, "customer").select(
        F.floor(k / 13).alias("request"), (k % 13).alias("ordinal"), k.alias("id"),
        F.when(k % 3 == 0, F.concat(F.lit("p"), (k % 5).cast("string"))).alias("photo_id"), F.when(k % 3 == 0, F.concat(F.lit("https://p/"), F.floor((k % 5) / 2).cast("string"))).alias("photo_url"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: named("p", (k * 7 + i) % 11)).alias("photos"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: named("s", i)).alias("spare"),
    )
    return serve.unique_photos(rows)


PHOTOS_SQL = """WITH RECURSIVE o AS (
  SELECT c_custkey // 13 AS request, c_custkey % 13 AS ordinal, c_custkey AS id, row_number() OVER (PARTITION BY c_custkey // 13 ORDER BY c_custkey) AS step,
    list_concat(list_concat(CASE WHEN c_custkey % 3 = 0 THEN [{'id': 'p' || (c_custkey % 5), 'url': 'https://p/' || (c_custkey % 5 // 2), 'own': true}] ELSE [] END,
      list_transform(range(0, 3), lambda i: {'id': 'p' || ((c_custkey * 7 + i) % 11), 'url': 'https://p/' || ((c_custkey * 7 + i) % 11 // 2), 'own': false})),
      list_transform(range(0, 4), lambda i: {'id': 's' || i, 'url': 'https://s/' || (i // 2), 'own': false})) AS offered FROM customer
), d AS (
  SELECT DISTINCT request, 0::BIGINT AS step, NULL::BIGINT AS ordinal, NULL::BIGINT AS id, []::VARCHAR[] AS ids, []::VARCHAR[] AS urls, NULL::STRUCT(id VARCHAR, url VARCHAR, own BOOLEAN) AS pick FROM o
  UNION ALL
  SELECT request, step, ordinal, id, CASE WHEN p IS NULL THEN ids ELSE list_append(ids, p.id) END, CASE WHEN p IS NULL THEN urls ELSE list_append(urls, p.url) END, p
  FROM (SELECT o.request, o.step, o.ordinal, o.id, ids, urls, list_filter(offered, lambda x: NOT list_contains(ids, x.id) AND NOT list_contains(urls, x.url))[1] AS p FROM d JOIN o ON o.request = d.request AND o.step = d.step + 1)
)
SELECT request, ordinal, id, pick.id AS photo_id, pick.url AS photo_url, coalesce(pick.own, false) AS kept FROM d WHERE step > 0"""

QUERIES = {f.__name__: f for f in (shuffled_places, first_unique, nearest_open, prioritised, prioritised_places, situation_fallback, menu_candidates, photo_queries, choice_ranking, region_usage, frequent_regions, history_by_region, nearest_regions, meal_rules, address_keys, korean_dates, page_links, json_keys, workdays, text_norms, unique_photos)}
SQL = {
    "first_unique": FIRST_UNIQUE_SQL,
    "nearest_open": NEAREST_OPEN_SQL,
    "prioritised": PRIORITISED_SQL,
    "prioritised_places": PRIORITISED_PLACES_SQL,
    "situation_fallback": FALLBACK_SQL,
    "menu_candidates": MENU_SQL,
    "photo_queries": _photo_sql(),
    "choice_ranking": CHOICE_SQL,
    "region_usage": f"WITH {USAGE} SELECT * FROM g",
    "frequent_regions": f"WITH {USAGE} SELECT name, n_used FROM g ORDER BY n_used DESC, last_used DESC LIMIT 3",
    "history_by_region": HISTORY_SQL,
    "nearest_regions": NEAREST_REGIONS_SQL,
    "meal_rules": _meal_sql(),
    "address_keys": ADDRESS_SQL,
    "korean_dates": DATES_SQL,
    "page_links": LINKS_SQL,
    "json_keys": JSON_SQL,
    "workdays": WORKDAYS_SQL,
    "text_norms": NORMS_SQL,
    "shuffled_places": SHUFFLED_SQL,
    "unique_photos": PHOTOS_SQL,
}
