"""Small tables with ties, gates and order."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from placebook.functions import scalars
from placebook.operators import merge, places, quality, resolve, serve
from placebook.sources import grids, sinks, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_mode_keeps_the_first_seen_and_zero_weights_never_win(spark):
    df = spark.createDataFrame([(1, i, n, w) for i, (n, w) in enumerate([("A", 1), ("B", 1), ("B", 1), ("A", 1), ("C", 0)])], "k int, o int, v string, w int")
    assert rows(places.most_common(df, ["k"], "v", F.col("o"), "m", F.col("w")), "m") == [("A",)]


def test_newest_urls_are_distinct_and_ten(spark):
    df = spark.createDataFrame([(1, f"u{i % 12}", dt.date(2026, 1, 1 + i % 12), i) for i in range(13)], "k int, u string, d date, o int")
    urls = places.newest_urls(df, ["k"], "u", "d", F.col("o")).collect()[0]["urls"]
    assert urls == [f"u{i}" for i in range(11, 1, -1)]


def test_median_is_whole(spark):
    df = spark.createDataFrame([(0,), (10,), (15,)], "a long")
    assert df.agg(places.whole_median(F.col("a")).alias("m")).collect()[0]["m"] == 12


def test_dedup_stage(spark):
    df = spark.createDataFrame([("k", 1, False), ("k", 2, True)], "key string, o int, ok boolean")
    rules = [("bad", F.col("ok"))]
    assert rows(quality.validated(df, rules, ["key"], [F.col("o")]).fillna("-"), "o", "reject_reason") == [(1, "bad"), (2, "-")]
    assert rows(quality.validated(df, rules, ["key"], [F.col("o")], before=0).fillna("-"), "o", "reject_reason") == [(1, "bad"), (2, "duplicate")]


def test_only_the_first_reason(spark):
    df = quality.with_reason(spark.range(1), [("region", F.lit(False)), ("date", F.lit(None).cast("boolean"))])
    assert df.collect()[0]["reject_reason"] == "region"


def test_missing_keys_tell_null_from_absent(spark):
    df = spark.createDataFrame([('{"a": null}',), ("[1]",)], "j string").select(quality.missing_keys(F.col("j"), ["a", "b"]).alias("m"))
    assert [r["m"] for r in df.collect()] == [["b"], None]


def test_ambiguous_levels_do_not_fall_through(spark):
    registry = spark.createDataFrame([("b", "p", "x"), ("b", "q", "y")], "branch string, plain string, address string")
    queries = spark.createDataFrame([(1, "b", "p")], "query_id int, qb string, qp string")
    assert rows(resolve.cascade(queries, registry, [("qb", "branch"), ("qp", "plain")]), "outcome") == [("ambiguous",)]


def test_same_address_twice_is_one_address_but_two_rows(spark):
    registry = spark.createDataFrame([("n", "x"), ("n", "x")], "name string, address string")
    queries = spark.createDataFrame([(1, "n")], "query_id int, q string")
    assert rows(resolve.cascade(queries, registry, [("q", "name")]), "outcome") == [("resolved",)]
    assert rows(resolve.cascade(queries, registry, [("q", "name")], count_rows=True), "outcome") == [("ambiguous",)]


def test_recovery_by_uniqueness_and_distance(spark):
    schema = "record_id int, business_id int, full_name string, address_key string, office_distance double, is_exact boolean"
    df = spark.createDataFrame(
        [
            (1, 1, "a", "k1", 2900.0, True), (1, 2, "a", "k2", 3100.0, True), (2, 3, "a", "k1", 9e9, True), (3, 4, "a", "", 1.0, True), (4, 5, "a", "k1", 5000.0, False),
            (5, 6, "b", "k1", 100.0, True), (5, 7, "b", "k1", 9000.0, True), (6, 8, "c", "k1", None, True), (6, 9, "d", "k1", None, True), (7, 10, "a", "k1", None, False),
            (8, 11, "e", "k", 10.0, False), (9, 12, "f", "k1", 100.0, True), (9, 13, "f", "k2", 50.0, True), (9, 14, "f", "k2", 9000.0, True),
        ], schema,
    )
    records = spark.createDataFrame([(i,) for i in range(1, 11)], "record_id int")
    got = {r["record_id"]: r for r in resolve.recovered(records, df).collect()}
    assert {i: (r["method"], r["business_id"], r["office_metres"]) for i, r in got.items() if r["method"]} == {
        1: ("exact-name-near-institution", 1, 2900), 2: ("normalized-name-unique-in-region", 3, None), 5: ("normalized-name-unique-in-region", 7, None),
        8: ("abbreviated-name-near-institution", 11, 10), 9: ("exact-name-near-institution", 12, 100),
    }
    # the last row of a name and address counts, records without a candidate are pending, too
    assert {i: [c["business_id"] for c in r["candidates"]] for i, r in got.items() if not r["method"]} == {3: [], 4: [], 6: [8, 9], 7: [], 10: []}


def test_recovery_lists_twenty_candidates(spark):
    df = spark.createDataFrame([(1, i, f"n{i}", "k", None, True) for i in range(50)], "record_id int, business_id int, full_name string, address_key string, office_distance double, is_exact boolean")
    assert [c["business_id"] for c in resolve.recovered(df.select("record_id").distinct(), df).collect()[0]["candidates"]] == list(range(20))


def test_cascade_is_that_of_a_lookup_for_each_query(spark):
    import random

    rng = random.Random(3)
    entries = [(rng.choice("abc"), rng.choice(["", "p", "q"]), f"{rng.choice('xyz')} street {rng.randrange(3)}") for _ in range(40)]
    asked = [(i, rng.choice(["a", "b", "", "n"]), rng.choice(["p", "q", "m", None]), rng.choice(["x", "y", "street 1", None])) for i in range(60)]
    registry, queries = spark.createDataFrame(entries, "first string, second string, address string"), spark.createDataFrame(asked, "query_id int, q1 string, q2 string, d string")

    def plain(one, count_rows):
        for key, at in ((one[1], 0), (one[2], 1)):
            hits = [e[2] for e in entries if key and e[at] == key]
            if hits:
                size = len if count_rows else lambda x: len(set(x))
                near = [h for h in hits if one[3] and one[3] in h]
                return hits[0] if size(hits) == 1 else near[0] if size(near) == 1 else "ambiguous"
        return "not_found"

    for count_rows in (False, True):
        out = resolve.cascade(queries, registry, [("q1", "first"), ("q2", "second")], district="d", count_rows=count_rows)
        got = {r["query_id"]: r["resolved_address"] or r["outcome"] for r in out.collect()}
        assert got == {one[0]: plain(one, count_rows) for one in asked}


def test_bands_and_cells_lose_no_pair(spark):
    import math
    import random

    rng = random.Random(5)
    left, right = ([(i, rng.choice("ab"), rng.randint(-30, 60)) for i in range(80)] for _ in range(2))
    got = resolve.band_join(spark.createDataFrame(left, "l int, road string, n int"), spark.createDataFrame(right, "r int, road string, m int"), "road", "n", "m")
    assert rows(got, "l", "r") == sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and abs(a[2] - b[2]) <= 10)
    points = [(i, rng.choice("ab"), 37 + rng.random() / 50, 127 + rng.random() / 50) for i in range(200)]
    a, b = spark.createDataFrame(points, "i int, k string, a double, b double"), spark.createDataFrame(points, "j int, k string, c double, d double")
    d = scalars.great_circle("a", "b", "c", "d")
    near = resolve.within_reach(a, b, ["k"], ("a", "b", "c", "d"), d, 300.0)

    def metres(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    assert rows(near, "i", "j") == sorted((p[0], q[0]) for p in points for q in points if p[1] == q[1] and metres(p, q) <= 300)


def _flat_metres(a, b, c, d):
    import math

    return 6371000 * math.hypot(math.radians(a - c), math.radians(b - d) * math.cos(math.radians((a + c) / 2)))


def test_nearest_office_equals_brute_force(spark):
    import random

    rng = random.Random(8)
    anywhere = lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180))
    city = lambda: (37 + rng.randrange(9) / 50, 127 + rng.randrange(9) / 50)
    offices = [(i, rng.choice("ab"), *rng.choice((anywhere, city))()) for i in range(60)] + [(99, "a", None, 127.0)]
    asked = [(i % 7, i, rng.choice("abc"), *rng.choice((anywhere, city))()) for i in range(200)] + [(0, 900, "a", None, 127.0), (0, 901, "a", 90.0, -180.0)]
    out = resolve.nearest_office(spark.createDataFrame(asked, "record_id int, business_id int, k string, lat double, lon double"), spark.createDataFrame(offices, "office_id int, k string, office_lat double, office_lon double"), ["k"])
    want = []
    for _, i, k, a, b in asked:
        near = min(((_flat_metres(a, b, c, d), o) for o, other, c, d in offices if other == k and c is not None and a is not None), default=(None, None))
        want.append((i, near[1], near[0] and round(near[0], 3)))
    assert sorted(rows(out.withColumn("d", F.round("office_distance", 3)), "business_id", "office_id", "d")) == sorted(want)


def _most_rows(spark, df):
    """The most rows that a join of the executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in name and plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
    return most


def test_nearest_office_measures_no_nation_whole(spark):
    """20,000 candidates and 2,000 offices of one institution would be 40 million pairs."""
    at = lambda n, s: [F.col("id").alias(n), F.lit(1).alias("k"), (35 + F.rand(s)).alias("lat"), (127 + F.rand(s + 1)).alias("lon")]
    asked = spark.range(20000).select(F.lit(0).alias("record_id"), *at("business_id", 1))
    offices = spark.range(2000).select(*at("office_id", 5)).withColumnsRenamed({"lat": "office_lat", "lon": "office_lon"})
    assert _most_rows(spark, resolve.nearest_office(asked, offices, ["k"])) < 4_000_000


def test_offices_use_their_road_only_without_their_address(spark):
    offices = spark.createDataFrame([(1, "r|5", "r", 5), (2, "r|6", "r", 6), (3, "", "r", 5), (4, "q|1", "q", None)], "office_id int, address_key string, road_key string, number int")
    registry = spark.createDataFrame([(10, "r|5", "r", 5, 37.0, 127.0), (11, "r|15", "r", 15, 37.0, 127.0), (12, "r|17", "r", 17, 37.0, 127.0)], "business_id int, address_key string, road_key string, number int, lat double, lon double")
    same, near = "same-official-road-address", "nearby-road-address-search-center"
    assert rows(resolve.office_evidence(offices, registry), "office_id", "business_id", "coordinate_method") == [(1, 10, same), (2, 10, near), (2, 11, near)]


def test_score_lead(spark):
    df = spark.createDataFrame([(1, "a", 120), (1, "b", 120), (2, "c", 135), (2, "d", 120), (3, "e", 100)], "k int, c string, s int")
    assert rows(resolve.clear_lead(df, "k", "s"), "k", "c") == [(2, "c"), (3, "e")]


PHOTOS = "request int, ordinal int, id string, photo_id string, photo_url string, photos array<struct<id: string, url: string>>, spare array<struct<id: string, url: string>>"


def test_photos_are_dealt_out_once(spark):
    one, same, two, spare = ("one", "u1"), ("duplicate", "u1"), ("two", "u2"), ("s", "u9")
    df = spark.createDataFrame(
        [
            (1, 0, "a", None, None, [one, same, two], [spare]), (1, 1, "b", None, None, [one, same, two], [spare]), (1, 2, "c", None, None, [one, two], [spare]),
            (1, 3, "d", None, None, None, [spare]), (2, 0, "a", "own", "u1", [], []), (2, 1, "b", "x", "u1", [same, two], []), (2, 2, "c", None, "u7", [], []), (2, 3, "d", "u7", "u8", [], None),
        ], PHOTOS,
    )
    got = {(r["request"], r["id"]): (r["photo_id"], r["photo_url"], r["kept"]) for r in serve.unique_photos(df).collect()}
    assert got == {
        (1, "a"): ("one", "u1", False), (1, "b"): ("two", "u2", False), (1, "c"): ("s", "u9", False), (1, "d"): (None, None, False),
        (2, "a"): ("own", "u1", True), (2, "b"): ("two", "u2", False), (2, "c"): ("u7", "u7", True), (2, "d"): (None, None, False),
    }


def test_answers(spark):
    df = spark.createDataFrame([(2, "b", 1.5), (1, "a", None)], "ordinal int, id string, distance double")
    body = serve.response(df, "source", "d").collect()[0]["body"]
    assert body == '{"restaurants":[{"id":"a"},{"id":"b","distance":1.5}],"source":"source","disclaimer":"d"}'
    answers = spark.createDataFrame([(200, body), (503, "x"), (None, None), (200, "no json")], "status int, body string")
    got = serve.decoded_response(answers, "id string, distance double").collect()
    assert sorted((r["id"] or "-", r["error"] or "-") for r in got) == [("-", "badResponse 503"), ("-", "decoding"), ("-", "transport"), ("a", "-"), ("b", "-")]


def test_prioritised_places_number_every_row(spark):
    rows = [(i, None if i % 7 == 0 else i * 37 % 50, i % 3 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "ordinal long, distance int, hit boolean")
    got = [r["ordinal"] for r in serve.prioritised_places(df, F.col("hit")).orderBy("place").collect()]
    expected = sorted(rows, key=lambda r: (not r[2], (serve.FAR if r[1] is None else r[1]) if r[2] else 0, r[0]))
    assert got == [r[0] for r in expected]
    assert [r["ordinal"] for r in serve.prioritised(df, F.col("hit")).collect()] == got


def test_prioritised_keeps_order_without_matches(spark):
    df = spark.createDataFrame([(2, 5), (1, 9)], "ordinal int, distance int")
    assert [r["ordinal"] for r in serve.prioritised(df, F.lit(False)).collect()] == [1, 2]


def test_catalog_match_needs_exactly_one(spark):
    day = dt.date(2026, 1, 1)
    catalog = spark.createDataFrame([(1, "서울", "한식당", None, "서울특별시 중구 무교로 21", day), (2, "서울", "두집", None, "서울 중구 무교로 3", day), (3, "서울", "두집", None, "서울특별시 중구 무교로 3", day)], "catalog_id int, region string, name string, name_variants array<string>, address string, last_date date")
    asked = spark.createDataFrame([("a", "(주)한식당", "서울 중구 무교로 21", ""), ("b", "두집", "서울 중구 무교로 3", "")], "id string, name string, road_address string, address string")
    assert [(r["id"], r["catalog_id"]) for r in serve.catalog_match(asked, catalog, F.lit("2026-06-01").cast("date")).orderBy("id").collect()] == [("a", 1), ("b", None)]


def test_upsert_and_years(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(merge.last_wins(old, spark.createDataFrame([("b", 3)], "k string, v int"), ["k"]), "k", "v") == [("a", 1), ("b", 3)]
    bundled = spark.createDataFrame([(dt.date(2025, 1, 1), "x"), (dt.date(2026, 1, 1), "y")], "day date, name string")
    assert rows(serve.override_years(bundled, spark.createDataFrame([(dt.date(2026, 5, 5), "z")], "day date, name string")), "name") == [("x",), ("z",)]


def test_holiday_shapes(spark):
    docs = ['{"2026": {"2026-01-01": ["신정"]}}', '{"2026-01-01": ["신정"], "x": ["y"]}', '{"2026-01-01": "신정"}']
    df = spark.createDataFrame([(d,) for d in docs], "d string").select(tables.holidays(F.col("d")).alias("h"))
    assert [[(str(x["day"]), x["name"]) for x in r["h"]] for r in df.collect()] == [[("2026-01-01", "신정")]] * 3


def xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="8월"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>집행일시</t></si><si><t>집행장소</t></si><si><t>금액</t></si><si><t>소계</t></si></sst>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            '<worksheet xmlns="m"><sheetData>'
            '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
            '<row r="2"><c r="A2" t="inlineStr"><is><t>2026-08-04</t></is></c><c r="B2" t="inlineStr"><is><t>행복식당</t></is></c><c r="C2"><v>12000</v></c></row>'
            '<row r="3"><c r="B3" t="inlineStr"><is><t>다른집</t></is></c><c r="C3"><v>5</v></c></row>'
            '<row r="4"><c r="A4" t="s"><v>3</v></c></row>'
            '</sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>',
        )
    return out.getvalue()


def test_documents_to_ledgers(spark):
    page = "<html><table><tr><th>집행일자</th><th>장소</th><th>금액</th></tr><tr><td>2026.8.5</td><td>가<br>나</td><td>1</td></tr></table></html>".encode()
    files = spark.createDataFrame([("a.xlsx", xlsx()), ("b.html", page), ("c.pdf", b"%PDF-1.4"), ("d.xlsx", b"PK\x03\x04broken")], "path string, content binary")
    grid = grids.read_grids(files)
    told = grids.ledger_rows(grid)
    assert rows(told.filter("error is null"), "doc", "date", "place", "amount") == [("a.xlsx", "2026-08-04", "다른집", "5"), ("a.xlsx", "2026-08-04", "행복식당", "12000"), ("b.html", "2026.8.5", "가 나", "1")]
    assert sorted(r["doc"] for r in grid.filter("error is not null").collect()) == sorted(r["doc"] for r in told.filter("error is not null").collect()) == ["c.pdf", "d.xlsx"]


def test_files_that_are_no_ledgers(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/hwp+zip")
        z.writestr("Contents/section0.xml", '<s xmlns="m"><tbl><tr><tc><t>장소</t></tc></tr><tr><tc><t>식당</t></tc></tr></tbl></s>')
    files = [("x.xlsx", b"<!DOCTYPE html><html><head></head><body>404</body></html>"), ("y.xls", b"\x9b DRMONE  locked"), ("z.bin", out.getvalue()), ("w.dat", xlsx()), ("v.zip", b"PK\x03\x04nothing"), ("u", b""), ("t", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    kinds = rows(df.select("path", grids.kind_of(F.col("content"), F.col("path")).alias("k")), "path", "k")
    assert kinds == [("t", "text"), ("u", "text"), ("v.zip", "zip"), ("w.dat", "xlsx"), ("x.xlsx", "html"), ("y.xls", "locked"), ("z.bin", "hwpx")]
    found = grids.read_grids(df)
    errors = {r["doc"]: r["error"] for r in found.filter("error is not null").collect()}
    assert errors["x.xlsx"] == "ValueError: a web page without a table" and errors["y.xls"] == "ValueError: no reader for locked"
    assert sorted(errors) == ["t", "u", "v.zip", "x.xlsx", "y.xls"] and found.filter("doc = 'z.bin'").count() == 2


GRID = "doc string, sheet string, row_no int, cells array<string>, error string"


def test_headers_by_words_of_all_kinds(spark):
    grid = spark.createDataFrame(
        [
            ("a", "s", 1, ["2026년 8월 업무추진비", None]), ("a", "s", 2, ["집행일", "상호", "적요", "지출액", "주소"]), ("a", "s", 3, ["2026-08-04", "행복식당", "오찬", "1,000", "중구 무교로 21"]),
            ("a", "s", 4, ["합계", "", "", "1,000", ""]), ("b", "s", 1, ["사용일시", "업 소\n명", "소재지(주소)", "집행 금액"]), ("b", "s", 2, ["2026-08-05", "가연", "서구 탄방로 1", "5"]),
            ("c", "s", 1, ["집행일자", "금액", "목적"]), ("c", "s", 2, ["2026-08-05", "5", "회의"]), ("d", "s", 1, ["연번", "주소"]), ("d", "s", 2, ["일자", "장소"]), ("d", "s", 3, ["2026-08-06", "나무집"]),
        ], GRID.replace(", error string", ""),
    ).withColumn("error", F.lit(None).cast("string"))
    got = rows(grids.ledger_rows(grid).fillna("-"), "doc", "date", "place", "purpose", "amount", "address", "error")
    assert got == [
        ("a", "2026-08-04", "행복식당", "오찬", "1,000", "중구 무교로 21", "-"), ("b", "2026-08-05", "가연", "-", "5", "서구 탄방로 1", "-"),
        ("c", "-", "-", "-", "-", "-", "no header row"), ("d", "2026-08-06", "나무집", "-", "-", "-", "-"),
    ]


def test_units_of_sheets(spark):
    sheets = {
        ("a", "Sheet1"): [["□ 부서(기관명) :  노인복지과(노인복지과장)"], ["일자", "장소"]],
        ("b", "8월"): [["업무추진비"], ["소속부서", "", "-", "환경보건안전과"], ["일자", "장소"]],
        ("c", "운영지원과"): [["일자", "장소"]],
        ("d", "Sheet2"): [["부서 : 업무추진비"], ["일자", "장소"]],
        ("e", "총무과"): [["담당부서: 회계과 김철수"], ["일자", "장소"]],
    }
    grid = spark.createDataFrame([(d, s, i, cells, None) for (d, s), lines in sheets.items() for i, cells in enumerate(lines, 1)], GRID)
    got = rows(grids.sheet_departments(grid), "doc", "department", "evidence")
    assert got == [("a", "노인복지과", "header"), ("b", "환경보건안전과", "header"), ("c", "운영지원과", "sheet"), ("e", "회계과", "header")]
    told = spark.createDataFrame([("c", "운영지원과", 2, ["2026-08-04", "식당"], None)], GRID)
    assert rows(grids.ledger_rows(grid.unionByName(told)).filter("error is null"), "doc", "department") == [("c", "운영지원과")]


def test_manifest_rejects_other_bytes(spark):
    import hashlib

    files = spark.createDataFrame([("/x/a", b"1"), ("/x/b", b"2")], "path string, content binary")
    manifest = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest(), "u"), ("b", "00", "u"), ("c", "00", "u")], "file_name string, sha256 string, url string")
    assert rows(tables.checked_by_manifest(files, manifest).fillna("-"), "file_name", "error") == [("a", "-"), ("b", "sha256 differs"), ("c", "missing")]


def test_private_columns_do_not_survive(spark):
    df = spark.createDataFrame([("1", "과", "2026", "8", "2026-08-04", "행복식당 (서울 중구 무교로 21)", "간담회 홍길동", "1", "https://x", "010-1234-5678")], [*tables.KEPT_COLUMNS, "전화"])
    out = sinks.reduced_ledger(df)
    assert out.columns == tables.KEPT_COLUMNS
    assert out.collect()[0]["집행목적"] == "식사"


def test_catalog_match_compares_equal_addresses_once(spark):
    """2,000 restaurants and 300 places of one name on one road would be 600,000 pairs."""
    place = lambda k, n: [F.lit("본점").alias("name"), F.concat(F.lit("서울 중구 무교로 "), F.col(k) % n).alias("told")]
    catalog = spark.range(300).select(F.col("id").alias("catalog_id"), F.lit("서울").alias("region"), *place("id", 299), F.lit(None).cast("array<string>").alias("name_variants"), F.lit(dt.date(2026, 1, 1)).alias("last_date"))
    asked = spark.range(2000).select("id", *place("id", 400), F.lit("").alias("address")).withColumnRenamed("told", "road_address")
    out = serve.catalog_match(asked, catalog.withColumnRenamed("told", "address"), F.lit("2026-06-01").cast("date"))
    want = sorted((i, i % 400 if 0 < i % 400 < 299 else None) for i in range(2000))
    assert sorted((r["id"], r["catalog_id"]) for r in out.collect()) == want
    assert _most_rows(spark, out) <= 2000


def test_crowded_rows_meet_nobody(spark):
    import random

    rng = random.Random(3)
    spot = lambda: rng.choice(((37 + rng.random() / 100, 127 + rng.random() / 100), (rng.uniform(36, 38), rng.uniform(126, 128))))
    a, b = ([(i, rng.choice("ab"), *spot()) for i in range(n)] for n in (300, 400))
    left, right = spark.createDataFrame(a, "i int, k string, a double, b double"), spark.createDataFrame(b, "j int, k string, c double, d double")
    at = ("a", "b", "c", "d")
    few = resolve.uncrowded(left, right, ["k"], at, 9000.0)
    pairs = lambda df: resolve.within_reach(df, right, ["k"], at, scalars.great_circle(*at), 9000.0)
    whole = rows(resolve.only_match(pairs(left), "i"), "i", "j")
    assert whole and rows(resolve.only_match(pairs(few), "i"), "i", "j") == whole
    n = {r["i"]: r["n"] for r in pairs(left).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    gone = set(range(300)) - {r["i"] for r in few.collect()}
    assert len(gone) > 100 and all(n[i] > 1 for i in gone) and pairs(few).count() < pairs(left).count() / 20


def test_any_key_facts_make_no_pairs(spark):
    registry = spark.range(1000).select(F.col("id").alias("business_id"), (F.col("id") % 2).alias("region"), F.lit("b").alias("branch"), F.when(F.col("id") == 4, "b").otherwise("f").alias("full_name"), (F.col("id") % 10).alias("address"))
    records = spark.range(1002).select(F.col("id").alias("record_id"), (F.col("id") % 2).alias("region"), F.when(F.col("id") < 1000, "b").when(F.col("id") == 1000, "f").otherwise("x").alias("query"))
    keys = F.array("branch", "full_name")
    out = resolve.any_key_facts(records, registry, F.col("query"), keys, ["region"])
    few = records.filter("record_id >= 990")
    pairs = resolve.by_any_key(few, registry, F.array("query"), keys, ["region"]).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("address").alias("m"), F.min("business_id").alias("f"))
    assert rows(out.filter("record_id >= 990"), "record_id", "n", "n_addresses", "first_business") == rows(pairs, "record_id", "n", "m", "f")
    assert _most_rows(spark, out) == 1001


def test_prefixes_meet_only_whole_beginnings(spark):
    import random

    rng = random.Random(4)
    word = lambda: "sam" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
    asked, own = ([(i, rng.randint(0, 1), word()) for i in range(n)] for n in (150, 200))
    own += [(900, 0, "sa"), (901, 0, "abc")]
    records, registry = spark.createDataFrame(asked, "record_id int, region int, query string"), spark.createDataFrame(own, "business_id int, region int, full_name string")
    exact = spark.createDataFrame([(3,), (3,), (5,)], "record_id int")
    alike = lambda a, b: (a.startswith(b) or b.startswith(a)) and min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 5
    out = resolve.prefix_candidates(records, registry, exact)
    want = sorted((i, j) for i, r, a in asked for j, s, b in own if i not in (3, 5) and r == s and alike(a, b))
    assert rows(out, "record_id", "business_id") == want
    assert _most_rows(spark, out) <= len(want)


def test_office_band_meets_houses_and_not_customers(spark, tmp_path):
    """1,000 suppliers and 2,000 customers of one nation: by pairs 140,000 rows."""
    from placebook.plans import resolving

    spark.range(1000).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(2000).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    out = resolving.office_band(spark, str(tmp_path))
    at = lambda i: [c for c in range(2000) if abs(i % 300 - c % 300) <= 10]
    assert rows(out, "s_suppkey", "n", "first_customer") == [(i, len(at(i)), at(i)[0]) for i in range(1000)]
    assert _most_rows(spark, out) < 10_000


def test_office_locations_meet_points_and_not_customers(spark, tmp_path):
    """700 suppliers and 23,100 customers, three at a point and house, of one nation: by pairs a million rows."""
    from placebook.plans import resolving

    spark.range(700).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(0, 69300, 3).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    out = resolving.office_locations(spark, str(tmp_path))
    for t in ("supplier", "customer"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).coalesce(1).write.parquet(str(tmp_path / f"{t}.one"))
    con = __import__("duckdb").connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.one/*.parquet'")
    want = con.sql(f"SELECT office_id, coordinate_method, n_points, spread FROM ({resolving.LOCATIONS_SQL})").fetchall()
    assert rows(out, "office_id", "coordinate_method", "n_points", "spread") == sorted(want)
    assert _most_rows(spark, out) < 400_000


def test_weighted_centres_are_those_of_the_rows(spark):
    points = [(i % 3, 37 + i % 5 / 1000, 127 + i % 4 / 1000) for i in range(200)]
    df = spark.createDataFrame(points, "k int, lat double, lon double")
    told = ("k", "n_points", F.round("c_lat", 9).alias("a"), F.round("c_lon", 9).alias("b"), F.round("spread", 3).alias("c"))
    whole = resolve.centres(df, ["k"]).select(*told)
    short = resolve.centres(df.groupBy("k", "lat", "lon").agg(F.count(F.lit(1)).alias("w")), ["k"], weight="w").select(*told)
    names = ("k", "n_points", "a", "b", "c")
    assert rows(whole, *names) == rows(short, *names) != []
