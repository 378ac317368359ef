"""Scans, registries, downloads and what replaces tables: files as users have them."""

import datetime as dt
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from placebook.functions import address
from placebook.operators import resolve
from placebook.sources import connectors, registries, sinks, tables


def test_ledger_in_ms949_with_bad_bytes_and_a_stray_quote(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_bytes('""문서고유id",집행장소,집행목적\n"1","가, ""나""","식사"\n"2","둘\n째",'.encode("cp949") + b'"\x80\xff"\n')
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        df = tables.read_ledger(spark, str(path), "MS949")
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert df.columns == ["문서고유id", "집행장소", "집행목적"]
    assert got[0] == ("1", '가, "나"', "식사") and got[1][:2] == ("2", "둘\n째") and "�" in got[1][2]
    with pytest.raises(ValueError, match="columns are missing"):
        tables.checked_columns(df, ["집행금액"])


def test_json_lines_keep_their_numbers_and_tell_objects(spark, tmp_path):
    import gzip

    (tmp_path / "a").mkdir()
    with gzip.open(tmp_path / "a" / "records.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"region": "서울", "isMeal": true}\n\n   \n[1, 2]\n{"region": \n"text"\n{"region": null, "other": 1}\n')
    path = tables.preferred_path([str(tmp_path / "a" / "records.jsonl"), str(tmp_path / "a" / "records.jsonl.gz")])
    got = sorted((r["line"], r["is_object"], r["row"]["region"] if r["is_object"] else None) for r in tables.read_json_lines(spark, path).collect())
    assert got == [(1, True, "서울"), (4, False, None), (5, False, None), (6, False, None), (7, True, None)]
    assert tables.preferred_path(["/x/other"]) is None


def test_side_files_may_lack_or_be_broken(spark, tmp_path):
    schema = "a int, b array<string>"
    assert tables.read_optional(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "bad.json").write_text("{no json")
    assert [tuple(r) for r in tables.read_optional(spark, str(tmp_path / "bad.json"), schema).collect()] in ([], [(None, None)])
    (tmp_path / "good.json").write_text('{"a": 1,\n "b": ["x"]}')
    assert [tuple(r) for r in tables.read_optional(spark, str(tmp_path / "good.json"), schema).collect()] == [(1, ["x"])]


def test_registry_of_archives(spark):
    head = "상가업소번호,상호명,지점명,상권업종대분류명,지번주소,도로명주소,경도,위도\n"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("소상공인_서울_202606.csv", ("﻿" + head + '1,가,본점,음식,lot,road,127.0,37.5\n2,나,,소매,lot,road,127.0,37.5\n3,"다, 라",,음식,lot,,126.9,37.4\n4,마,,음식,lot,,,37.4\n5,바,,음식,lot,,150.0,37.4\n').encode())
        z.writestr("readme.txt", "x")
    files = spark.createDataFrame([("a.zip", out.getvalue())], "path string, content binary")
    got = sorted(tuple(r) for r in tables.registry_of_zips(files).collect())
    assert got == [("1", "가", "본점", "road", "서울", 37.5, 127.0), ("3", "다, 라", "", "lot", "서울", 37.4, 126.9)]


HEAD = "상가업소번호,상호명,지점명,상권업종중분류명,상권업종소분류명,시도명,시군구명,지번주소,도로명주소\n"


def test_three_kinds_of_registries(spark, tmp_path):
    (tmp_path / "경기.csv").write_text(
        "﻿" + HEAD + " 1 ,(주)가연,인계점,한식,백반,경기도,수원시 팔달구,lot 1,경기도 경기도 수원시 팔달구 인계로 12\n2,가연,,한식,백반,경기도,수원시 팔달구,경기도 수원시 팔달구 인계동 5-1,\n3,나무,,카페,커피,경기도,수원시,x,인계로 9\n"
        ",무,,한식,백반,경기도,수원시,x,인계로 9\n5,,,한식,백반,경기도,수원시,x,인계로 9\n6,다,,한식,백반,경기도,북구,,\n7,라,,한식,백반,경기도,광산구,인계로,인계로\n", encoding="utf-8",
    )
    rows = registries.read_registry(spark, str(tmp_path / "경기.csv"))
    central = {r["business_id"]: r for r in registries.central_registry(rows, F.lit("경기")).collect()}
    assert sorted(central) == ["1", "2", "3"]
    assert (central["1"]["region"], central["1"]["address"], central["1"]["name_key"], central["1"]["full_key"], central["1"]["pair_key"]) == ("경기", "경기도 수원시 팔달구 인계로 12", "가연", "가연인계점", "가연\u001f인계점")
    assert central["2"]["address"] == "경기도 수원시 팔달구 인계동 5-1" and central["2"]["full_key"] == "" and central["3"]["address"] == "경기도 인계로 9"
    asked = spark.createDataFrame([(1, "가연 (인계점)"), (2, "가연"), (3, "가연인계점"), (4, "없음")], "query_id int, name string")
    told = resolve.cascade(registries.central_query_keys(asked), registries.central_registry(rows, F.lit("경기")), registries.CENTRAL_LEVELS)
    assert {r["query_id"]: (r["outcome"], r["resolved_address"]) for r in told.collect()} == {
        1: ("resolved", "경기도 수원시 팔달구 인계로 12"), 2: ("ambiguous", None), 3: ("resolved", "경기도 수원시 팔달구 인계로 12"), 4: ("not_found", None),
    }
    checked = {r["business_id"]: r["keys"] for r in registries.checked_registry(rows, F.lit("경기")).collect()}
    assert "3" not in checked and checked["1"] == ["(주)가연 인계점", "(주)가연인계점", "(주)가연 인계", "(주)가연인계"] and checked["2"] == ["가연"]
    whole = {r["business_id"]: r["region"] for r in registries.integrated_registry(rows, F.lit("전남광주")).collect()}
    assert whole["7"] == "광주" and whole["1"] == "전남"


def test_evidence_and_matched_addresses(spark):
    lines = spark.createDataFrame(
        [('{"businessID": "1", "name": "가연", "branch": "중앙점", "address": "부산광역시 중구 중앙대로 1"}',), ('{"상호명": "나", "도로명주소": "대구 중구 공평로 88", "region": "대구", "sourceURL": "https://x"}',), ('{"name": "", "address": "부산"}',), ("no json",)], "raw string"
    )
    got = sorted((r["name"], r["region"], r["source_url"], len(r["keys"])) for r in registries.evidence_registry(lines, source="https://official").collect())
    assert got == [("가연", "부산", "https://official", 4), ("나", "대구", "https://x", 1)]
    records = spark.createDataFrame([(2, "b", "r", "n", "a", "late"), (1, "b", "r", "n", "a", None), (3, None, "r", "m", "a", "x"), (4, "c", "r", "n", "", "x"), (5, "d", "r", "n", "a", "y")], "ordinal int, addressSourceID string, region string, name string, address string, addressMatch string")
    matched = registries.matched_addresses(records)
    assert [tuple(r) for r in matched.collect()][0] == ("", "r", "m", "a", "x") and sorted(tuple(r) for r in matched.collect())[1:] == [("b", "r", "n", "a", "verified"), ("d", "r", "n", "a", "y")]
    assert sorted((r["name_key"], r["address"]) for r in registries.matched_registry(matched).collect()) == [("m", "a"), ("n", "a")]


def test_daily_ledgers_have_the_day_of_their_file(spark):
    grid = spark.createDataFrame(
        [("in/ulsan_2026-08-04.html", "t", 1, ["2025-01-01"]), ("in/x.html", "t", 1, ["on", "a"]), ("in/x.html", "t", 2, ["2026-08-05 and 2026-08-06"]), ("in/ulsan_chief_2026-08-04.html", "t", 1, ["x"]), ("in/y.html", "t", 1, ["x"]), ("in/ulsan_2026-13-99.html", "t", 1, ["x"])],
        "doc string, sheet string, row_no int, cells array<string>",
    )
    got = {(r["doc"], r["row_no"]): r["day"] for r in tables.daily_ledger(grid).collect()}
    assert got == {("in/ulsan_2026-08-04.html", 1): dt.date(2026, 8, 4), ("in/x.html", 1): dt.date(2026, 8, 5), ("in/x.html", 2): dt.date(2026, 8, 5), ("in/y.html", 1): None, ("in/ulsan_2026-13-99.html", 1): None}


def test_downloads_tell_where_they_come_from(spark):
    asked = []

    def post(url, form):
        asked.append((url, form))
        return b"a,b\n1,2\n", {"Content-Type": "text/csv", "Set-Cookie": "secret", "Date": "today"}

    row = connectors.downloaded(spark, "https://x/download", {"infId": "1"}, post, now=lambda: "2026-09-13T00:00:00+09:00").collect()[0]
    assert asked == [("https://x/download", {"infId": "1"})] and row["headers"] == {"Content-Type": "text/csv", "Date": "today"}
    assert (row["bytes"], row["sha256"], row["fetched_at"], bytes(row["content"])) == (8, hashlib.sha256(b"a,b\n1,2\n").hexdigest(), "2026-09-13T00:00:00+09:00", b"a,b\n1,2\n")
    with pytest.raises(ValueError, match="not a safe link"):
        connectors.http_post("http://x", {})


def test_caches_by_content_keep_equal_files_once(tmp_path):
    calls = []
    fetch = connectors.cached(lambda url: calls.append(url) or b"same", str(tmp_path), by_content=True)
    assert [fetch(u) for u in ("https://a", "https://b", "https://a")] == [b"same"] * 3 and calls == ["https://a", "https://b"]
    assert sum(p.read_bytes() == b"same" for p in tmp_path.iterdir()) == 1


def test_collecting_into_a_folder(spark, tmp_path):
    class Site:
        region, institution = "서울", "i"

        def discover(self, fetch):
            return [connectors.Document(f"https://x/{i}", f"d{i}") for i in range(7)]

    got = connectors.collect(spark, Site(), lambda url: url.encode(), batch=3, folder=str(tmp_path / "docs"))
    assert sorted((r["path"], bytes(r["content"]).decode()) for r in got.collect()) == [(f"d{i}", f"https://x/{i}") for i in range(7)]

    class Empty(Site):
        def discover(self, fetch):
            return []

    assert connectors.collect(spark, Empty(), lambda url: b"", folder=str(tmp_path / "none")).count() == 0


def test_pages_of_a_list_end(spark):
    pages = {1: connectors.Page([{"id": i} for i in range(5)], False), 2: connectors.Page([{"id": i, "late": True} for i in range(3, 9)], False), 3: connectors.Page([{"id": 1}], False), 4: connectors.Page([{"id": 99}], False)}
    read = []
    got = connectors.paged(lambda n: read.append(n) or pages[n])
    assert [x["id"] for x in got] == list(range(9)) and read == [1, 2, 3] and "late" not in got[3]
    many = connectors.paged(lambda n: connectors.Page([{"id": n * 10 + i} for i in range(8)], False))
    assert [x["id"] for x in many] == [*range(10, 18), *range(20, 25)]
    assert len(connectors.paged(lambda n: connectors.Page([{"id": n}], n == 2))) == 2


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "ids")
    sinks.replace_table(spark.createDataFrame([("a", "1"), ("b", "2")], "id string, photo string"), path)
    new = spark.createDataFrame([("b", "3"), ("c", "4"), ("c", "5")], "id string, photo string")
    sinks.replace_table(sinks.upsert_ids(spark.read.schema("id string, photo string").json(path), new), path)
    assert sorted(tuple(r) for r in spark.read.json(path).select("id", "photo").collect()) == [("a", "1"), ("b", "3"), ("c", "5")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ids"]


def test_needed_departments_and_allowed_regions(spark):
    df = spark.createDataFrame([("서울시", "총무과"), ("전남광주", " "), ("부산", None)], "region string, department string")
    assert sinks.department_needed(df, True).count() == 1 and sinks.department_needed(df, False).count() == 3
    allowed = lambda *a: [r["ok"] for r in df.select(address.allowed_region("region", list(a)).alias("ok")).collect()]
    assert allowed("서울") == [True, False, False] and allowed("광주") == [False, True, False] and allowed("전남", "부산") == [False, True, True]


def test_words_that_no_text_contains(spark):
    assert spark.range(1).select(address.first_contained(F.lit("x"), ["a", "b"]).alias("w")).collect()[0]["w"] is None
