"""Table-driven cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from placebook.functions import address as adr
from placebook.functions import classify, scalars, text


@pytest.fixture(scope="module")
def one(spark):
    """The value of an expression over one row of named values."""

    def value(expr, **cols):
        row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'long'}" for k, v in cols.items())) if cols else spark.range(1)
        return row.select(expr().alias("v")).collect()[0]["v"]

    return value


@pytest.mark.parametrize(
    "address, region, key",
    [
        ("서울특별시 중구 무교로 21", "서울", "서울|중구|도로|무교로|21"),
        ("서울특별시 중구 세종대로 20길 23", "서울", "서울|중구|도로|세종대로20길|23"),
        ("서울특별시 중구 태평로1가 31-20", "서울", "서울|중구|지번|태평로1가|31-20"),
        ("경기도 수원시 팔달구 인계동 1113-1", "경기", "경기|수원시 팔달구|지번|인계동|1113-1"),
        ("세종특별자치시 세종특별자치시 한누리대로 2130", "세종", "세종||도로|한누리대로|2130"),
        ("서울특별시 중구 세종대로 지하 101", "서울", "서울|중구|도로|세종대로|지하101"),
        ("전남광주통합특별시 북구 우치로 100", "광주", "광주|북구|도로|우치로|100"),
        ("부산광역시 중구 중앙대로 1", "대구", None),
        ("경기도 무교로 21", "경기", None),
        (None, "경기", None),
        ("", None, None),
    ],
)
def test_address_keys(spark, address, region, key):
    row = adr.with_address(spark.createDataFrame([(address, region)], "address string, region string")).collect()[0]
    assert row["address_key"] == key


def test_southwest_addresses_need_a_district(spark):
    df = spark.createDataFrame([("세종특별자치시 한누리대로 2130", "세종"), ("전남광주시 담양군 추성로 5", "전남")], "address string, region string")
    assert [r["address_key"] for r in adr.with_address(df, variant="southwest").collect()] == [None, "전남|담양군|도로|추성로|5"]


def test_locations(spark):
    df = spark.createDataFrame([("열빈 (광화문점) (서울 종로구 새문안로 92)",), ("스타벅스 (서울 중구 무교로 1)",), (None,)], "location string")
    rows = adr.with_location(df).collect()
    assert rows[0]["loc_key"] == "서울|종로구|새문안로|92"
    assert rows[0]["loc_name"].startswith("열빈 (광화문점)")
    assert rows[1]["loc_key"] is None and rows[2]["loc_key"] is None


def test_names(one):
    assert one(lambda: text.norm_text("a"), a="㈜ Café-1호점") == "주café1호점"
    assert one(lambda: text.client_name("a"), a="(주) 주식회사 한 식당 ㈜") == "한식당"
    assert one(lambda: text.registry_name("a"), a="주식회사 A&amp;B 식당(주)") == "ab식당"
    assert one(lambda: text.place_name("a"), a="Foo [2층] 본점(강남)") == "foo"
    assert one(lambda: text.clean_text("a"), a=None) == ""
    assert one(lambda: text.last_word("a"), a=" 경제실  경제정책과 ") == "경제정책과"
    assert one(lambda: text.code_point_sum("a"), a="신흥관") == 149317


@pytest.mark.parametrize("told, day", [("'26. 8. 4.", dt.date(2026, 8, 4)), ("20260230", None), ("2025년 3월 9일", dt.date(2025, 3, 9)), (None, None)])
def test_korean_dates(one, told, day):
    assert one(lambda: scalars.korean_date("a"), a=told) == day


def test_other_dates(one):
    assert one(lambda: scalars.sheet_date("a"), a=45000.0) == dt.date(2023, 3, 15)
    assert one(lambda: scalars.sheet_date("a"), a=1.0) is None
    assert one(lambda: scalars.months_before(F.lit("2026-08-31").cast("date"), 18)) == dt.date(2025, 2, 28)
    assert one(lambda: scalars.strict_date("a"), a="2026-02-30 12:00") is None


def test_amounts(one):
    assert one(lambda: scalars.decimal_amount("a"), a="₩12,345.9원") == 12345
    assert one(lambda: scalars.decimal_amount("a"), a="x") == 0
    assert one(lambda: scalars.digits_amount("a"), a="1,200원") == 1200


def test_merchants_and_meals(one):
    assert one(lambda: classify.many_merchants("a"), a="가연, 서로히") is True
    assert one(lambda: classify.many_merchants("a"), a="본가(중구, 무교로)") is False
    assert one(lambda: classify.meal_purpose("a"), a="") is False
    assert one(lambda: classify.meal_purpose_2("a"), a="") is True


def test_runs_of_words(one):
    hay = F.array(*map(F.lit, "abc"))
    assert one(lambda: adr.contains_run(hay, F.array(F.lit("b"), F.lit("c")))) is True
    assert one(lambda: adr.contains_run(hay, F.array(F.lit("a"), F.lit("c")))) is False


def test_addresses_match(one):
    tokens = lambda a: adr.address_tokens(F.lit(a))
    assert one(lambda: tokens("세종특별자치시 세종시 한누리대로 12번지")) == ["세종", "한누리대로", "12"]
    assert one(lambda: adr.same_address(tokens("서울특별시 중구 무교로 21"), tokens("서울 중구 무교로 21"))) is True
    assert one(lambda: adr.same_address(tokens("서울특별시 중구 무교로 21-1"), tokens("서울 중구 무교로 21"))) is False
    assert one(lambda: adr.same_address(tokens("부산 중구 무교로 21"), tokens("서울 중구 무교로 21"))) is False


@pytest.mark.parametrize(
    "name, category, curated, word",
    [
        ("시원냉면", "음식점 > 한식", None, "naengmyeon"),
        ("홍길동네", "음식점 > 일식 > 돈까스", None, "tonkatsu"),
        ("바다", "음식점 > 해물,생선", None, "seafood platter"),
        ("집", "음식점 > 삼겹살", None, "samgyeopsal"),
        ("시원냉면", "한식", ["탕수육"], "naengmyeon"),
        ("집", "한식", ["탕수육"], "tangsuyuk"),
        ("신흥관", "음식점 > 중식", None, "jjambbong"),
    ],
)
def test_photo_queries(one, name, category, curated, word):
    found = one(lambda: classify.photo_query("n", "c", F.lit(None).cast("array<string>") if curated is None else F.array(*map(F.lit, curated))), n=name, c=category)
    assert word in found


def test_departments(one):
    assert one(lambda: classify.canonical_department("a"), a="운영지원과장님") == "운영지원과"
    assert one(lambda: classify.title_department("a"), a="2026년 8월 업무추진비 (AI혁신과)") == "AI혁신과"
    assert one(lambda: classify.valid_department("a"), a="업무추진비 집행내역") is False
    assert one(lambda: classify.leaf_department("a"), a="본청 > 감사담당관실") == "감사담당관"


def test_hash_of_a_rotation(one):
    assert one(lambda: text.fnv1a64("a"), a="a") % 2**64 == 0xAF63DC4C8601EC8C
    assert one(lambda: text.rotation("a", 7), a="a") == 0xAF63DC4C8601EC8C % 7


def test_distances(one):
    assert abs(one(lambda: scalars.great_circle(F.lit(37.0), F.lit(127.0), F.lit(37.0001), F.lit(127.0))) - 11.12) < 0.01
    assert one(lambda: scalars.great_circle(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == float("inf")
    assert one(lambda: scalars.coordinate("a", 33, 39), a="40") is None


@pytest.mark.parametrize(
    "told, hint, out",
    [
        ("홍길동, 서울 중구 무교로 21", None, "서울특별시 중구 무교로 21"),
        ("(우) 04524 부산시 중구 중앙대로 1/김철수", None, "부산광역시 중구 중앙대로 1"),
        ("수원시 팔달구 인계동 1113", "경기", "경기도 수원시 팔달구 인계동 1113"),
        ("무교로 21", None, "무교로 21"),
        ("", "경기", None),
        (None, None, None),
    ],
)
def test_repaired_addresses(one, told, hint, out):
    assert one(lambda: adr.repaired("a", None if hint is None else F.lit(hint)), a=told) == out


@pytest.mark.parametrize(
    "place, address, out",
    [
        ("본가 (중구 무교로 21)", None, ("본가", "중구 무교로 21")),
        ("본가(2호점)", "서울 중구 무교로 21", ("본가(2호점)", "서울 중구 무교로 21")),
        ("본가, 중구 무교로 21", None, ("본가", "중구 무교로 21")),
        ("본가", None, ("본가", None)),
    ],
)
def test_places_and_addresses(one, place, address, out):
    assert tuple(one(lambda: adr.place_and_address("a", None if address is None else F.lit(address)), a=place)) == out
