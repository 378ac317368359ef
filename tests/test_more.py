"""Catalog documents, photos, connectors and redaction."""

import datetime as dt

from pyspark.sql import functions as F

from placebook.functions import photos, scalars, text
from placebook.operators import documents
from placebook.sources import connectors


def test_catalog_is_checked_as_a_whole_and_by_row(spark):
    place = '{"name": "a", "address": "b", "departmentCount": 1, "lastPaymentDate": "2026-01-01", "sourceURL": "https://x/1"}'
    bad = '{"name": " ", "address": "b", "departmentCount": 1, "lastPaymentDate": "2026-01-01", "sourceURL": "https://x/1"}'
    doc = '{"schemaVersion": %d, "generatedAt": "2026-01-01T00:00:00Z", "coverageDescription": "c", "sourceURLs": ["https://x"], "restaurants": [%s, %s]}'
    df = spark.createDataFrame([(doc % (1, place, bad),), (doc % (2, place, place),), ("no json",)], "document string")
    assert [r["name"] for r in documents.load_catalog(df).collect()] == ["a"]


def test_urls_of_regions(spark):
    rows = [
        ('{"서울특별시": ["https://s/1", {"k": "https://s/2"}], "부산": "https://b"}', "서울", ["https://s/1", "https://s/2"]),
        ('{"regions": [{"region": "부산시", "u": "https://b"}, {"region": "서울", "u": "https://s"}]}', "서울", ["https://s"]),
        ('{"a": "https://x", "b": "http://no", "https://key": 1}', "서울", ["https://x"]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "d string, r string")
    got = df.select(documents.region_urls(F.col("d"), F.col("r")).alias("u")).collect()
    assert [r["u"] for r in got] == [r[2] for r in rows]


def test_photos(spark):
    base = dict(id="1", url="https://p/1", thumbnail=None, foreign_landing_url="https://s/1", width=900, height=600, license="CC0", license_url=None, creator=None, title="Cold noodle", mature=False, query="naengmyeon korean cold noodles")
    change = [{}, {"mature": True}, {"width": 500}, {"width": 600, "height": 900}, {"license": "nc"}, {"license": "by"}, {"license": "by", "creator": "c", "license_url": "https://l"}, {"url": "http://x"}, {"title": "Rice"}]
    schema = "id string, url string, thumbnail string, foreign_landing_url string, width int, height int, license string, license_url string, creator string, title string, mature boolean, query string"
    df = spark.createDataFrame([tuple((base | c | {"id": str(i)}).values()) for i, c in enumerate(change)], schema)
    assert sorted(r["id"] for r in photos.fitting_titles(photos.usable_photos(df)).collect()) == ["0", "6"]


def test_redaction_and_postings(spark):
    df = spark.createDataFrame([("홍길동, 행복식당 051-123-4567", "2024년 2분기 업무추진비"), ("행복한식당/홍길동", "2026년 8월"), ("x", "없음")], "name string, title string")
    rows = df.select(text.redact("name").alias("n"), scalars.posting_before("title", F.lit("2024-09-13").cast("date")).alias("b")).collect()
    assert [(r["n"], r["b"]) for r in rows] == [("행복식당", True), ("행복한식당", False), ("x", False)]


def test_connectors(spark, tmp_path):
    calls = []

    def fetch(url):
        calls.append(url)
        if url.endswith("bad"):
            raise OSError("no")
        return b"data of " + url.encode()

    doc = lambda u, n="업무추진비": connectors.Document(f"https://x/{u}", n)
    pages = {1: [doc("a"), doc("b", "other")], 2: [doc("c"), doc("bad")], 3: [doc("a")]}
    site = connectors.PagedSite("서울", "i", "{page}", lambda page: pages[int(page.split()[-1])], keyword="업무추진비")
    got = connectors.collect(spark, site, connectors.with_retries(fetch, tries=2, sleep=lambda s: None)).collect()
    assert [(r["url"][-1], r["error"]) for r in got] == [("a", None), ("c", None), ("d", "no")]
    once = connectors.cached(fetch, str(tmp_path))
    before = len(calls)
    assert once("https://x/q") == once("https://x/q") and len(calls) == before + 1


def test_saved_outputs_and_evidence(spark):
    a = spark.createDataFrame([("1", "서울", "old"), (None, "서울", "n")], "recordID string, region string, name string")
    b = spark.createDataFrame([("1", "서울", "new"), ("2", "부산", "x")], "recordID string, region string, name string")
    assert sorted(r["name"] for r in documents.saved_outputs([a, b]).collect()) == ["n", "old", "x"]
    assert sorted(r["name"] for r in documents.preserved(a, b, ["서울"]).collect()) == ["new", "x"]
    row = spark.range(1).select(documents.department_of(F.lit(" "), F.lit("s"), F.lit("p")).alias("d")).collect()[0]["d"]
    assert (row["department"], row["evidence"]) == ("s", "sheet")


def test_fresh_positions_and_eligibility(spark):
    now = F.lit(dt.datetime(2026, 1, 1, 12, 0, 0))
    row = spark.range(1).select(
        photos.fresh_position(F.lit(5.0), F.lit(dt.datetime(2026, 1, 1, 11, 56, 0)), now).alias("a"),
        photos.fresh_position(F.lit(-1.0), F.lit(dt.datetime(2026, 1, 1, 11, 56, 0)), now).alias("b"),
        photos.fresh_position(F.lit(5.0), F.lit(dt.datetime(2026, 1, 1, 11, 54, 0)), now).alias("c"),
        documents.eligible(F.lit("2025-01-01"), F.lit("2026-06-01").cast("date")).alias("d"),
    ).collect()[0]
    assert tuple(row) == (True, False, False, True)


def test_parts_of_the_whole_queries_hold_every_payment(spark, monkeypatch):
    from placebook.operators import documents, merge
    from placebook.plans import more, payments

    data = "/root/testdata/sf0.001"
    n, seen = payments.payments(spark, data).count(), []
    for module, name in ((merge, "last_wins"), (documents, "preserved")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda a, b, *rest, real=real: seen.append((a, b)) or real(a, b, *rest))
    payments.sources_last_wins_whole(spark, data)
    more.preserved_regions_whole(spark, data)
    (a, b), (old, new) = seen
    assert sum(x.agg({"n": "sum"}).collect()[0][0] for x in (a, b)) == n
    assert old.count() + new.count() == n
