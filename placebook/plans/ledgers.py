"""Queries of the first steps: scans, headers, registries, rules for text, and what is written."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as adr
from ..functions import classify, photos, scalars, text
from ..operators import documents, merge, places, ranking, resolve, serve
from ..operators.ranking import RANGE_ROWS
from ..session import scratch_dir
from ..sources import grids, registries, sinks, tables
from .surrogates import MONTHS, SQL_AS_OF, P, as_of, cases, expected_sql, payments, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- scans


def ledger_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sheets of three layouts and one without a header, read by their header words."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name", "c_mktsegment", F.col("c_custkey").alias("n"), (F.col("c_nationkey") % 4).alias("kind"), "c_nationkey")
    doc, day = F.concat(F.lit("d"), F.col("c_nationkey")), F.concat(F.lit("day "), "k")
    rows = c.select(
        doc.alias("doc"), F.lit("s").alias("sheet"), (F.col("n") + 10).cast("int").alias("row_no"),
        F.when(F.col("kind") == 0, F.array(day, "c_name", "c_mktsegment", "k", F.concat(F.lit("addr "), "k"))).when(F.col("kind") == 1, F.array("k", F.concat(F.lit("addr "), "k"), "c_name", day))
        .when(F.col("kind") == 2, F.array(F.lit("x"), day, F.lit(" "), "c_name")).otherwise(F.array("c_name", "k")).alias("cells"),
    )
    heads = [["집행일", "상호", "적요", "지출액", "주소"], ["집행 금액", "소재지(주소)", "업소명", "사용일시"], ["연번", "일자", "내용", "거래처\n명"], ["이름", "값"]]
    nations = c.select("kind", "c_nationkey").distinct()
    head = nations.select(doc.alias("doc"), F.lit("s").alias("sheet"), F.lit(3).alias("row_no"), F.get(F.array(*[F.array(*map(F.lit, h)) for h in heads]), F.col("kind").cast("int")).alias("cells"))
    told = grids.ledger_rows(rows.unionByName(head).withColumn("error", F.lit(None).cast("string")))
    return told.select("doc", F.coalesce("row_no", F.lit(0)).alias("row_no"), "date", "place", "purpose", "amount", "address", "error")


HEADERS_SQL = """SELECT 'd' || c_nationkey AS doc, (c_custkey + 10)::INT AS row_no, 'day ' || c_custkey AS date, c_name AS place, CASE WHEN c_nationkey % 4 = 0 THEN c_mktsegment END AS purpose,
 CASE WHEN c_nationkey % 4 < 2 THEN CAST(c_custkey AS VARCHAR) END AS amount, CASE WHEN c_nationkey % 4 < 2 THEN 'addr ' || c_custkey END AS address, NULL::VARCHAR AS error FROM customer WHERE c_nationkey % 4 < 3
UNION ALL SELECT DISTINCT 'd' || c_nationkey, 0, NULL, NULL, NULL, NULL, NULL, 'no header row' FROM customer WHERE c_nationkey % 4 = 3"""


def daily_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of daily files whose name has the day, of files that tell it in a cell, and of lists."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    kind = F.dayofmonth("day") % 3
    doc = F.when(kind == 0, F.concat(F.lit("in/ulsan_"), "day", F.lit(".html"))).when(kind == 1, F.concat(F.lit("in/file"), F.date_format("day", "yyyyMMdd"), F.lit(".html"))).otherwise(F.concat(F.lit("in/chief_"), "day", F.lit(".html")))
    cells = F.when(kind == 1, F.array(F.concat(F.lit("on "), "day"), "k")).otherwise(F.array(F.lit("on 1999-01-01"), "k"))
    grid = o.select(doc.alias("doc"), F.lit("t").alias("sheet"), F.col("o_orderkey").cast("int").alias("row_no"), cells.alias("cells"))
    return tables.daily_ledger(grid).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


DAILY_SQL = "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE day(CAST(o_orderdate AS DATE)) % 3 <> 2 GROUP BY 1"


def ledger_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a packed ledger with a stray quote before its header, and read again as text."""
    path = _folder(spark, "ledger")
    c = table(spark, sf_dir, "customer")
    quoted = lambda col: F.concat(F.lit('"'), F.replace(F.col(col).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = c.select(F.col("c_custkey").alias("at"), F.concat_ws(",", *[quoted(x) for x in ("c_custkey", "c_name", "c_mktsegment", "c_acctbal")]).alias("value"))
    head = spark.createDataFrame([(-1, '""문서고유id",집행장소,집행목적,집행금액')], "at long, value string")
    # one file, as its header is its first line
    head.unionByName(lines).repartition(1).sortWithinPartitions("at").select("value").write.option("compression", "gzip").text(path)
    told = tables.read_ledger(spark, path)
    told = tables.checked_columns(told, ["문서고유id", "집행장소", "집행목적", "집행금액"])
    return told.select(F.col("문서고유id").alias("id"), F.col("집행장소").alias("place"), F.col("집행목적").alias("purpose"), scalars.decimal_amount("집행금액").alias("amount"))


LEDGER_SCAN_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS place, c_mktsegment AS purpose, CAST(trunc(c_acctbal) AS BIGINT) AS amount FROM customer"


def json_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines among blank lines, arrays and what is no JSON."""
    path = _folder(spark, "lines")
    k = F.col("c_custkey")
    raw = F.when(k % 11 == 0, "  ").when(k % 13 == 0, "[1]").when(k % 17 == 0, '{"region": ').otherwise(F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("region"), F.lit(True).alias("isMeal"))))
    c = table(spark, sf_dir, "customer")
    parts = max(1, math.ceil(c.count() / RANGE_ROWS))  # told by the file's footers
    c.repartitionByRange(parts, "c_custkey").sortWithinPartitions("c_custkey").select(raw.alias("value")).write.option("compression", "gzip").text(path)
    told = tables.read_json_lines(spark, path, through=True)
    return told.select("line", "is_object", F.when(F.col("is_object"), F.col("row.name")).alias("name"), F.when(F.col("is_object"), F.col("row.region")).alias("region"))


JSON_SCAN_SQL = """WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS line FROM customer)
SELECT line, c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AS is_object, CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 THEN c_name END AS name,
 CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 THEN c_mktsegment END AS region FROM r WHERE c_custkey % 11 <> 0"""


def optional_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose items are a list, one object, an empty string or absent."""
    k = F.col("c_custkey")
    one = lambda i: F.concat(F.lit('{"contentid":"'), (k + i).cast("string"), F.lit('"}'))
    item = F.when(k % 4 == 0, F.concat(F.lit('{"item":['), one(0), F.lit(","), one(1), F.lit("]}"))).when(k % 4 == 1, F.concat(F.lit('{"item":'), one(0), F.lit("}"))).when(k % 4 == 2, F.lit('""')).otherwise(F.lit("{}"))
    doc = F.concat(F.lit('{"response":{"body":{"items":'), item, F.lit("}}}"))
    found = tables.optional_items(doc, "$.response.body.items.item", "struct<contentid: string>")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(found, lambda x: x["contentid"]), ",").alias("ids"))


ITEMS_SQL = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey || ',' || (c_custkey + 1) WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS ids FROM customer"


def holiday_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of feeds in three shapes, and the years that a newer feed takes over."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), "n_name")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("k") * 40).cast("string")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    listed = F.concat(q(day), F.lit(":["), q(F.col("n_name")), F.lit(',"x"]'))
    doc = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"2024":{'), listed, F.lit("}}"))).when(F.col("k") % 3 == 1, F.concat(F.lit("{"), listed, F.lit("}"))).otherwise(F.concat(F.lit("{"), q(day), F.lit(":"), q(F.col("n_name")), F.lit(',"no day":"y"}')))
    bundled = n.select(F.explode(tables.holidays(doc)).alias("h")).select("h.day", "h.name")
    return serve.override_years(bundled, spark.createDataFrame([("2025-05-05", "새로")], "day string, name string").withColumn("day", F.col("day").cast("date")))


FEEDS_SQL = """WITH n AS (SELECT n_nationkey AS k, n_name, CAST(DATE '2024-01-01' + INTERVAL (n_nationkey * 40) DAY AS DATE) AS day FROM nation)
SELECT day, n_name AS name FROM n WHERE year(day) <> 2025 UNION ALL SELECT day, 'x' FROM n WHERE k % 3 <> 2 AND year(day) <> 2025 UNION ALL SELECT DATE '2025-05-05', '새로'"""

# ---------------------------------------------------------------- registries


def _registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a registry file: the same names at several addresses, some with branches, some cafés, some without an address."""
    k = F.col("p_partkey")
    number = (k % 90).cast("string")
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("상가업소번호"), F.concat(F.lit(" (주)"), F.lit("Place "), (k % 400).cast("string")).alias("상호명"), F.when(k % 3 == 0, F.concat(F.lit("B"), (k % 5).cast("string"), F.lit("점"))).otherwise("").alias("지점명"),
        F.when(k % 10 == 0, "카페").otherwise("한식").alias("상권업종중분류명"), F.lit("기타").alias("상권업종소분류명"), F.lit("경기도").alias("시도명"),
        F.when(k % 4 == 0, "북구").when(k % 4 == 1, "나주시").otherwise("수원시 팔달구").alias("시군구명"), F.concat(F.lit("경기도 수원시 팔달구 인계동 "), number).alias("지번주소"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat(F.lit("경기도 경기도 수원시 팔달구 무교로 "), number)).when(k % 7 == 2, F.concat(F.lit("무교로 "), number)).otherwise(F.concat(F.lit("경기도 수원시 팔달구 무교로 "), number)).alias("도로명주소"),
    )


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "registry")
    _registry_rows(spark, sf_dir).write.csv(path, header=True)
    return registries.read_registry(spark, path)


REG = """t AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id, 'place' || (p_partkey % 400) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'b' || (p_partkey % 5) || '점' ELSE '' END AS branch,
 CASE WHEN p_partkey % 7 = 0 THEN '경기도 수원시 팔달구 인계동 ' || (p_partkey % 90) WHEN p_partkey % 7 = 2 THEN '경기도 무교로 ' || (p_partkey % 90) ELSE '경기도 수원시 팔달구 무교로 ' || (p_partkey % 90) END AS address FROM part)"""


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the first kind from its file; customers look up a name, with a branch at its end or a district."""
    registry = registries.central_registry(_registry(spark, sf_dir), F.lit("경기"))
    k = F.col("c_custkey")
    name = F.concat(F.lit("Place "), (k % 450).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(" (B"), (k % 5).cast("string"), F.lit("점)"))).otherwise(""))
    asked = table(spark, sf_dir, "customer").select(k.alias("query_id"), name.alias("name"), F.when(k % 5 == 0, F.concat(F.lit("무교로 "), (k % 9).cast("string"))).alias("district"))
    asked = registries.central_query_keys(asked)
    return resolve.cascade(asked, registry, registries.CENTRAL_LEVELS, district="district").select("query_id", "resolved_address", "outcome")


LOOKUP_SQL = f"""WITH {REG}, q AS (SELECT c_custkey AS query_id, 'place' || (c_custkey % 450) || CASE WHEN c_custkey % 2 = 0 THEN '(b' || (c_custkey % 5) || '점)' ELSE '' END AS q_full,
   CASE WHEN c_custkey % 2 = 0 THEN 'place' || (c_custkey % 450) || '|b' || (c_custkey % 5) || '점' END AS q_pair, CASE WHEN c_custkey % 5 = 0 THEN '무교로 ' || (c_custkey % 9) END AS d FROM customer),
 l AS (SELECT name || branch AS key, 0 AS level, address FROM t WHERE branch <> '' AND false UNION ALL SELECT name || branch, 0, address FROM t WHERE branch <> '' UNION ALL SELECT name || '|' || branch, 1, address FROM t WHERE branch <> '' UNION ALL SELECT name, 2, address FROM t),
 a AS (SELECT query_id, d, 0 AS level, q_full AS key FROM q UNION ALL SELECT query_id, d, 1, q_pair FROM q WHERE q_pair IS NOT NULL UNION ALL SELECT query_id, d, 2, q_full FROM q),
 h AS (SELECT query_id, a.level, count(DISTINCT address) AS n, min(address) AS one, count(DISTINCT address) FILTER (contains(address, d)) AS n_in, min(address) FILTER (contains(address, d)) AS inside FROM a JOIN l ON a.level = l.level AND a.key = l.key GROUP BY query_id, a.level),
 f AS (SELECT query_id, arg_min(struct_pack(n := n, one := one, n_in := n_in, inside := inside), level) AS s FROM h GROUP BY query_id),
 o AS (SELECT q.query_id, CASE WHEN s.n = 1 THEN s.one WHEN s.n_in = 1 THEN s.inside END AS resolved_address, s IS NOT NULL AS hit FROM q LEFT JOIN f USING (query_id))
SELECT query_id, resolved_address, CASE WHEN NOT hit THEN 'not_found' WHEN resolved_address IS NULL THEN 'ambiguous' ELSE 'resolved' END AS outcome FROM o"""


def registry_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the second kind: no cafés; a spelling that two addresses have resolves nothing."""
    registry = registries.checked_registry(_registry(spark, sf_dir), F.lit("경기"))
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.concat(F.lit("(주)Place "), (k % 450).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("B"), (k % 5).cast("string"))).otherwise("")).alias("name"))
    return resolve.without_conflicts(asked, registry, F.array("name"), F.col("keys")).select("query_id", "resolved_address")


CONFLICTS_SQL = """WITH t AS (SELECT p_partkey AS k, '(주)Place ' || (p_partkey % 400) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'B' || (p_partkey % 5) || '점' ELSE '' END AS branch,
  CASE p_partkey % 7 WHEN 0 THEN '경기도 수원시 팔달구 인계동 ' WHEN 1 THEN '경기도 경기도 수원시 팔달구 무교로 ' WHEN 2 THEN '무교로 ' ELSE '경기도 수원시 팔달구 무교로 ' END || (p_partkey % 90) AS address FROM part WHERE p_partkey % 10 <> 0),
 l AS (SELECT unnest(CASE WHEN branch = '' THEN [name, replace(name, ' ', '')] ELSE [name || ' ' || branch, name || branch, name || ' ' || left(branch, 2), name || left(branch, 2)] END) AS key, address FROM t),
 u AS (SELECT key, min(address) AS address FROM l GROUP BY key HAVING count(DISTINCT address) = 1)
SELECT c_custkey AS query_id, u.address AS resolved_address FROM customer LEFT JOIN u ON u.key = '(주)Place ' || (c_custkey % 450) || CASE WHEN c_custkey % 2 = 0 THEN 'B' || (c_custkey % 5) ELSE '' END"""


def registry_integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of the third kind: the integrated city's rows go to the region of their district."""
    k = F.col("business_id").cast("long")
    told = registries.integrated_registry(_registry(spark, sf_dir), F.when(k % 2 == 0, "전남광주").otherwise("전북"))
    return told.groupBy("region", "name_key").agg(F.count(F.lit(1)).alias("n"), F.min("full_key").alias("full_key"))


INTEGRATED_SQL = """SELECT CASE WHEN p_partkey % 2 = 1 THEN '전북' WHEN p_partkey % 4 = 0 THEN '광주' ELSE '전남' END AS region, '주place' || (p_partkey % 400) AS name_key, count(*) AS n,
 min(CASE WHEN p_partkey % 3 = 0 THEN '주place' || (p_partkey % 400) || 'b' || (p_partkey % 5) || '점' ELSE '' END) AS full_key FROM part GROUP BY 1, 2"""


def matched_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched addresses kept once, by the first record, and how many names they give a registry."""
    k = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").select(
        k.alias("ordinal"), F.when(k % 4 != 0, (k % 300).cast("string")).alias("addressSourceID"), F.concat(F.lit("r"), k % 3).alias("region"), F.concat(F.lit("n"), k % 50).alias("name"),
        F.when(k % 9 != 0, F.concat(F.lit("a"), k % 20)).alias("address"), F.when(k % 5 != 0, F.concat(F.lit("m"), k)).alias("addressMatch"),
    )
    matched = registries.matched_addresses(records)
    names = registries.matched_registry(matched).groupBy("region").agg(F.count(F.lit(1)).alias("n_names"))
    return matched.join(names, "region").select("addressSourceID", "region", "name", "address", "addressMatch", "n_names")


MATCHED_SQL = """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 300 AS VARCHAR) ELSE '' END AS i, 'r' || (o_orderkey % 3) AS region, 'n' || (o_orderkey % 50) AS name, 'a' || (o_orderkey % 20) AS address FROM orders WHERE o_orderkey % 9 <> 0),
 m AS (SELECT i, region, name, address, CASE WHEN min(k) % 5 <> 0 THEN 'm' || min(k) ELSE 'verified' END AS m FROM r GROUP BY ALL), n AS (SELECT region, count(DISTINCT (name, address)) AS n_names FROM r GROUP BY region)
SELECT i AS "addressSourceID", region, name, address, m AS "addressMatch", n_names FROM m JOIN n USING (region)"""


def catalog_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as restaurants, matched to suppliers as catalog places by name and by the words of their addresses."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    n = lambda k: (k % 40).cast("string")
    catalog = table(spark, sf_dir, "supplier").select(
        s.alias("catalog_id"), F.when(s % 3 == 2, "부산").otherwise("서울").alias("region"), F.concat(F.lit("Place "), s % 60).alias("name"), F.when(s % 4 == 0, F.array(F.concat(F.lit("(주)Other "), s % 60))).alias("name_variants"),
        F.concat(F.when(s % 3 == 0, "서울특별시 중구 무교로 ").when(s % 3 == 1, "중구 무교로 ").otherwise("부산광역시 중구 무교로 "), n(s), F.when(s % 2 == 0, " 2층").otherwise("")).alias("address"),
        F.when(s % 10 != 9, F.lit("2026-05-01")).otherwise("2020-01-01").cast("date").alias("last_date"),
    )
    asked = table(spark, sf_dir, "customer").select(
        c.alias("id"), F.concat(F.when(c % 4 == 0, "Other ").otherwise("(주) Place "), c % 60).alias("name"),
        F.concat(F.when(c % 5 < 3, "서울 중구 무교로 ").otherwise("부산 중구 무교로 "), n(c), F.when(c % 7 == 0, " 9층").otherwise("")).alias("road_address"), F.when(c % 7 == 0, F.concat(F.lit("서울시 중구 무교로 "), n(c))).alias("address"),
    )
    return serve.catalog_match(asked, catalog, F.lit("2026-06-01").cast("date")).select("id", "catalog_id")


CATALOG_MATCH_SQL = """WITH k AS (SELECT s_suppkey AS catalog_id, CASE WHEN s_suppkey % 3 = 2 THEN '부산' ELSE '서울' END AS region, unnest(CASE WHEN s_suppkey % 4 = 0 THEN ['place' || (s_suppkey % 60), 'other' || (s_suppkey % 60)] ELSE ['place' || (s_suppkey % 60)] END) AS name,
   CASE s_suppkey % 3 WHEN 0 THEN '서울' WHEN 2 THEN '부산' ELSE '' END AS own, ' 중구 무교로 ' || (s_suppkey % 40) || CASE WHEN s_suppkey % 2 = 0 THEN ' 2층 ' ELSE ' ' END AS rest FROM supplier WHERE s_suppkey % 10 <> 9),
 a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'place' END || (c_custkey % 60) AS name, CASE WHEN c_custkey % 5 < 3 THEN '서울' ELSE '부산' END AS region,
   ' 중구 무교로 ' || (c_custkey % 40) || CASE WHEN c_custkey % 7 = 0 THEN ' 9층 ' ELSE ' ' END AS rest FROM customer UNION ALL
   SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'place' END || (c_custkey % 60), '서울', ' 중구 무교로 ' || (c_custkey % 40) || ' ' FROM customer WHERE c_custkey % 7 = 0),
 h AS (SELECT id, catalog_id FROM a JOIN k USING (name) WHERE a.region = k.region AND contains(k.rest, a.rest)), o AS (SELECT id, min(catalog_id) AS catalog_id FROM h GROUP BY id HAVING count(DISTINCT catalog_id) = 1)
SELECT c_custkey AS id, catalog_id FROM customer LEFT JOIN o ON id = c_custkey"""

# ---------------------------------------------------------------- rules for text, told by cases

PLACED = [
    ("경기도 수원시 팔달구 인계로 12-3", "인천", "경기", "경기도 수원시 팔달구 인계로 12-3"),
    ("수원시 팔달구 인계로 12", None, "경기", "경기도 수원시 팔달구 인계로 12"),
    ("(식당) 유성구 대학로 99 외 2곳", None, "대전", "대전광역시 유성구 대학로 99"),
    ("중구 무교로 21", "인천", "인천", "인천광역시 중구 무교로 21"),
    ("중구 무교로 21", None, None, None),
    ("서구 둔산로 100", "서울", None, None),
    ("세종특별자치시 세종시 한누리대로 2130", None, "세종", "세종특별자치시 한누리대로 2130"),
    ("한누리대로 2130", "세종", "세종", None),
    ("대전 서구 둔산동 1234", None, "대전", "대전광역시 서구 둔산동 1234"),
    ("경기도 인계로 12", None, None, None),
    ("경기도 수원시 인계동", None, None, None),
    ("충청북도 충청북도 청주시 상당로 82", None, "충북", "충청북도 청주시 상당로 82"),
]


def placed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses put into a province by what they name, or by a hint for districts that several have."""
    rows = adr.with_placed(cases(spark, sf_dir, [x[:2] for x in PLACED]), "in0", F.col("in1"))
    return rows.select("s_suppkey", "placed_region", "placed_address", adr.district_hint("in0").alias("district"))


DISTRICTS_TOLD = ["수원시", "수원시", "유성구", "중구", "중구", "서구", None, None, "서구", None, "수원시", "청주시"]
PLACED_SQL = expected_sql(placed_region=[x[2] if x[3] else None for x in PLACED], placed_address=[x[3] for x in PLACED], district=DISTRICTS_TOLD)

MENDED = [
    # address, default, region, mended, key
    ("광주 북구 우치로 100", "전남", "광주", "광주광역시 북구 우치로 100", "광주|북구|도로|우치로|100"),
    ("전주시 완산구 효자로 225", "전남", "전북", "전북특별자치도 전주시 완산구 효자로 225", "전북|전주시 완산구|도로|효자로|225"),
    ("홍길동, 전남 나주시 빛가람로 1 외 2명", "전북", "전남", "전라남도 나주시 빛가람로 1", "전남|나주시|도로|빛가람로|1"),
    ("전남광주통합특별시 광산구 상무대로 5", "전북", "광주", "전남광주통합특별시 광산구 상무대로 5", "광주|광산구|도로|상무대로|5"),
    ("전남광주통합특별시 나주시 빛가람로 7", "전북", "전남", "전남광주통합특별시 나주시 빛가람로 7", "전남|나주시|도로|빛가람로|7"),
    ("가연 앞 제주시 연동 312-1", "제주", "제주", "제주특별자치도 제주시 연동 312-1", "제주|제주시|지번|연동|312-1"),
    ("우치로 100", "광주", None, None, None),
    ("부산 중구 중앙대로 1", "전남", None, None, None),
    ("중구 무교로 21", "전북", "전북", "전북특별자치도 중구 무교로 21", "전북|중구|도로|무교로|21"),
    ("중구 무교로 21", "서울", None, None, None),
    ("", "전남", None, None, None),
    (None, "전남", None, None, None),
]


def mended_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the southwest with their region in front, by what they name or by the ledger's region."""
    rows = adr.with_mended(cases(spark, sf_dir, [x[:2] for x in MENDED]).withColumn("sigungu", F.lit("own")), "in0", "in1")
    return rows.select("s_suppkey", "mended_region", "mended_address", "mended_key", "sigungu")


MENDED_SQL = expected_sql(mended_region=[x[2] for x in MENDED], mended_address=[x[3] for x in MENDED], mended_key=[x[4] for x in MENDED], sigungu=["own"])

NAMES_TOLD = [
    # written, norm_text, registry_name, business_name, place_name, display_name, client_name
    ("（주）행복 식당", "주행복식당", "행복식당", "（주）행복식당", "행복식당", "（주）행복 식당", "행복식당"),
    ("주식회사 ＡＢＣ Ltd.", "주식회사abcltd", "abcltd", "ａｂｃltd.", "주식회사abcltd", "ＡＢＣ Ltd.", "abcltd."),
    ("Tom &amp; Jerry 본점", "tomampjerry본점", "tomjerry본점", "tom&jerry본점", "tomampjerry", "Tom & Jerry 본점", "tom&amp;jerry본점"),
    ('"가연" 외 2곳', "가연외2곳", "가연외2곳", '가연"외2곳', "가연외2곳", '가연"', '"가연"외2곳'),
    ("롯데 (서울 중구 소공로 1)", "롯데서울중구소공로1", "롯데서울중구소공로1", "롯데(서울중구소공로1)", "롯데", "롯데", "롯데(서울중구소공로1)"),
    ("", "", "", "", "", "", ""),
]


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name by each of the rules that compare or show it."""
    rules = {"norm": text.norm_text, "registry": text.registry_name, "business": text.business_name, "place": text.place_name, "shown": text.display_name, "client": text.client_name}
    return cases(spark, sf_dir, [(x[0],) for x in NAMES_TOLD]).select("s_suppkey", *[f("in0").alias(k) for k, f in rules.items()])


NAME_RULES_SQL = expected_sql(**{k: [x[i] for x in NAMES_TOLD] for i, k in enumerate(("norm", "registry", "business", "place", "shown", "client"), 1)})

UNITS_TOLD = [
    # department, valid, general, canonical, leaf, personal
    ("운영지원과장", True, False, "운영지원과", "운영지원과장", True),
    ("[도시재생과]", False, False, "도시재생과", "[도시재생과]", False),
    ("기획조정실 > 예산담당관실", True, False, "기획조정실 > 예산담당관실", "예산담당관", False),
    ("시책추진업무추진비", False, True, "시책추진업무추진비", "시책추진업무추진비", False),
    ("홍길동 과장", True, False, "홍길동 과", "홍길동 과장", True),
    ("Sheet1", False, True, "Sheet1", "Sheet1", False),
    ("□ 노인복지과(노인복지과장)", True, False, "노인복지과", "□ 노인복지과(노인복지과장)", False),
    ("", False, True, "", "", False),
]


def unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"valid": classify.valid_department, "general": classify.general_department, "canonical": classify.canonical_department, "leaf": classify.leaf_department, "personal": classify.personal}
    return cases(spark, sf_dir, [(x[0],) for x in UNITS_TOLD]).select("s_suppkey", *[f("in0").alias(k) for k, f in rules.items()])


UNIT_RULES_SQL = expected_sql(**{k: [x[i] for x in UNITS_TOLD] for i, k in enumerate(("valid", "general", "canonical", "leaf", "personal"), 1)})

PURPOSES_TOLD = [
    # purpose, unit, institution
    ("[총무과] 직원 간담회", "총무과", "시"), ("안전총괄과 업무협의 오찬", "안전총괄과", "시"), ("중부소방서 격려", "중부소방서", "중부소방서"), ("간담회", None, "시"), ("(홍길동 과장) 오찬", None, "시"),
]


def purpose_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that a purpose names, and the institution that it is."""
    rows = cases(spark, sf_dir, [(x[0],) for x in PURPOSES_TOLD]).withColumn("unit", classify.purpose_department("in0"))
    return rows.select("s_suppkey", "unit", classify.institution(F.coalesce("unit", F.lit("")), F.lit("시")).alias("institution"))


PURPOSE_UNITS_SQL = expected_sql(unit=[x[1] for x in PURPOSES_TOLD], institution=[x[2] for x in PURPOSES_TOLD])

TITLES_TOLD = [("2024년 2분기 업무추진비", True), ("2026년 8월 집행내역", False), ("2024년 3월", True), ("2025년 공개", False), ("2023년도 4분기", True), ("업무추진비", False)]


def old_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a period that ended before the cutoff, by their titles."""
    rows = cases(spark, sf_dir, [(x[0],) for x in TITLES_TOLD])
    return rows.select("s_suppkey", scalars.posting_before("in0", F.lit("2024-09-13").cast("date")).alias("old"))


OLD_POSTINGS_SQL = expected_sql(old=[x[1] for x in TITLES_TOLD])

REDACTED_TOLD = [("홍길동, 행복식당 051-123-4567", "행복식당"), ("행복한식당/홍길동", "행복한식당"), ("가연 02 123 4567", "가연"), ("가연", "가연")]


def redacted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.redacted(cases(spark, sf_dir, [(x[0],) for x in REDACTED_TOLD]), ["in0"]).withColumnRenamed("in0", "name")


REDACTED_SQL = expected_sql(name=[x[1] for x in REDACTED_TOLD])

LOCATIONS_TOLD = [
    ("행복식당 (서울 중구 무교로 21)", "행복식당", "서울|중구|무교로|21", "중구"), ("가연(마포구 세종대로 20길 3) 외 2곳", "가연", "서울|마포구|세종대로20길|3", "마포구"), ("스타벅스 (서울 중구 무교로 1)", None, None, None),
    ("가연 (경기도 수원시 무교로 2)", None, None, None), ("행복식당", None, None, None), ("홍길동, 본가 (종로구 종로 1)", "본가", "서울|종로구|종로|1", "종로구"),
]


def ledger_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of ledgers as name, address key and district."""
    return adr.with_location(cases(spark, sf_dir, [(x[0],) for x in LOCATIONS_TOLD]), "in0").select("s_suppkey", "loc_name", "loc_key", "loc_district")


LEDGER_PLACES_SQL = expected_sql(loc_name=[x[1] for x in LOCATIONS_TOLD], loc_key=[x[2] for x in LOCATIONS_TOLD], loc_district=[x[3] for x in LOCATIONS_TOLD])


def reduced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows without what is private, and the meals whose address can't be read."""
    purposes = ["직원 간담회", "커피 구입", "업무협의 오찬"]
    rows = cases(spark, sf_dir, [(x[0], purposes[i % 3]) for i, x in enumerate(LOCATIONS_TOLD)])
    k = F.col("s_suppkey").cast("string")
    ledger = rows.select(k.alias("문서고유id"), F.lit("총무과").alias("전체부서명"), F.lit("2026").alias("해당년도"), F.lit("8").alias("해당월"), F.lit("2026-08-04 12:00").alias("집행일시"), F.col("in0").alias("집행장소"), F.col("in1").alias("집행목적"), F.lit("1000").alias("집행금액"), F.concat(F.lit("https://d/"), k).alias("문서url"), k.alias("전화"))
    kept = sinks.reduced_ledger(ledger).select(F.col("문서고유id").cast("long").alias("s_suppkey"), F.col("집행장소").alias("place"), F.col("집행목적").alias("purpose"))
    open_ = sinks.unresolved_ledger(ledger, F.lit(1)).select(F.split("recordID", ":")[0].cast("long").alias("s_suppkey"), F.col("name").alias("unresolved"), F.col("addressHint").alias("hint"))
    return kept.join(open_, "s_suppkey", "left")


REDUCED_SQL = expected_sql(
    place=["행복식당 (서울 중구 무교로 21)", "가연 (마포구 세종대로20길 3)", "", "", "", "본가 (종로구 종로 1)"], purpose=["식사", "", "식사", "식사", "", "식사"],
    unresolved=[None, None, None, "가연", None, None], hint=[None, None, None, "서울특별시 ", None, None],
)

# ---------------------------------------------------------------- dates, amounts, order


def amounts_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts and days as they are written in cells: with separators, as serials, with noise."""
    o = table(spark, sf_dir, "orders")
    won = F.concat(F.format_number("o_totalprice", 2), F.lit("원"))
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")) + 8000
    return o.select(
        "o_orderkey", scalars.decimal_amount(won).alias("amount"), scalars.digits_amount(F.concat(F.lit("금 "), F.col("o_orderkey").cast("string"), F.lit(" 원"))).alias("digits"),
        scalars.sheet_date(serial).alias("sheet_day"), scalars.strict_date(F.concat(day.cast("string"), F.lit("T00:00"))).alias("strict_day"), scalars.strict_date(F.date_format(day, "yyyy/MM/dd")).alias("no_day"),
        scalars.separated_date(F.date_format(day, "yyyy. M. d.")).alias("separated_day"), scalars.months_before(day, 5).alias("before"),
    )


AMOUNTS_SQL = """SELECT o_orderkey, CAST(trunc(round(o_totalprice, 2)) AS BIGINT) AS amount, o_orderkey AS digits, CAST(CAST(o_orderdate AS DATE) + INTERVAL 8000 DAY AS DATE) AS sheet_day, CAST(o_orderdate AS DATE) AS strict_day, CAST(NULL AS DATE) AS no_day,
 CAST(o_orderdate AS DATE) AS separated_day, CAST(CAST(o_orderdate AS DATE) - INTERVAL 5 MONTH AS DATE) AS before FROM orders"""


def sorted_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the order in which they are written, as the place of each within its region."""
    p = payments(spark, sf_dir).select("record_id", "region", "institution", "payment_date")
    parts = math.ceil(table(spark, sf_dir, "lineitem").count() / RANGE_ROWS)  # told by the file's footers
    placed = ranking.numbered_within(p, ["region"], [F.col("institution").asc_nulls_first(), F.col("payment_date").desc(), F.col("record_id")], "place", parts, few=True)
    return placed.select("record_id", F.col("place").cast("long").alias("place"))


SORTED_SQL = f"WITH {P} SELECT record_id, row_number() OVER (PARTITION BY region ORDER BY institution, payment_date DESC, record_id) AS place FROM p"


def fresh_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose newest payment is of the last months, and those that a client may show on the day."""
    facts = payments(spark, sf_dir).filter(F.col("payment_date") <= as_of()).groupBy("place_key").agg(F.max("payment_date").alias("last_date"), F.count(F.lit(1)).alias("n"))
    return places.fresh(facts, as_of(), 1).select("place_key", "last_date", "n", documents.eligible(F.col("last_date").cast("string"), F.add_months(as_of(), MONTHS)).alias("eligible"))


FRESH_SQL = f"""WITH {P}, f AS (SELECT place_key, max(payment_date) AS last_date, count(*) AS n FROM p WHERE payment_date <= {SQL_AS_OF} GROUP BY place_key)
SELECT place_key, last_date, n, last_date >= {SQL_AS_OF} AS eligible FROM f WHERE last_date >= CAST({SQL_AS_OF} - INTERVAL 1 MONTH AS DATE)"""


def first_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places grouped by their names without white space; shown as first seen, with the best of their addresses."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("shop"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(""), F.col("o_custkey") % 50, F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(""))
    rows = o.select(F.regexp_replace(name, r"\s+", "").alias("group"), name.alias("name"), F.concat(F.when(F.col("o_orderkey") % 7 == 0, "서울 중구 ").when(F.col("o_orderkey") % 5 == 0, "서울 ").otherwise(""), F.lit("a"), F.col("o_orderkey") % 4).alias("address"), "o_orderkey")
    first = rows.groupBy("group").agg(F.min_by("name", "o_orderkey").alias("first_name"))
    best = places.most_common(rows, ["group"], "address", F.col("o_orderkey"), "best_address", prefer=adr.address_rank("address"))
    return first.join(best, "group")


SPELLINGS_SQL = """WITH r AS (SELECT 'shop' || (o_custkey % 50) AS grp, 'shop' || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END || (o_custkey % 50) || CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE '' END AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN '서울 중구 ' WHEN o_orderkey % 5 = 0 THEN '서울 ' ELSE '' END || 'a' || (o_orderkey % 4) AS address, o_orderkey AS k FROM orders),
 f AS (SELECT grp, arg_min(name, k) AS first_name FROM r GROUP BY grp), a AS (SELECT grp, address, count(*) AS n, min(k) AS first FROM r GROUP BY ALL),
 b AS (SELECT grp, address, row_number() OVER (PARTITION BY grp ORDER BY contains(address, '중구') DESC, contains(address, '서울') DESC, length(address) DESC, n DESC, first) AS k FROM a)
SELECT f.grp AS "group", first_name, address AS best_address FROM f JOIN b ON f.grp = b.grp AND k = 1"""


def versions_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions compared by number, telephone links, labels of regions, texts of coverage."""
    s = table(spark, sf_dir, "supplier")
    version = F.concat(F.lit("1."), F.col("s_suppkey") % 30, F.lit("."), F.col("s_suppkey") % 7)
    return s.select(
        "s_suppkey", (text.version_key(version) >= text.version_key(F.lit("1.9.3"))).alias("new_enough"), text.phone_link(F.concat(F.lit("+82 2-"), "s_suppkey")).alias("link"),
        classify.region_label(F.array(F.lit("서울"), F.lit(" "), F.lit("서울"), F.concat(F.lit("구 "), F.col("s_nationkey").cast("string")))).alias("label"),
        merge.coverage_text(F.lit("서울"), F.col("s_suppkey") % 3, F.col("s_suppkey") % 2, F.lit("a"), F.lit("b")).alias("coverage"),
    )


VERSIONS_SQL = """SELECT s_suppkey, s_suppkey % 30 > 9 OR (s_suppkey % 30 = 9 AND s_suppkey % 7 >= 3) AS new_enough, 'tel:+822' || s_suppkey AS link, '서울 구 ' || s_nationkey AS label,
 CASE WHEN s_suppkey % 2 > 0 THEN '서울: ' || (s_suppkey % 3) || ' places, ' || (s_suppkey % 2) || ' payments, a to b' ELSE '서울: no records' END AS coverage FROM supplier"""


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources, institutions, departments and places the allowed regions have, in whichever spelling they are."""
    p = payments(spark, sf_dir)
    spelled = F.when(F.col("region") == "ASIA", "서울시").when(F.col("region") == "EUROPE", "전남광주").when(F.col("region") == "AFRICA", "부산광역시").otherwise(F.col("region"))
    kept = p.withColumn("spelled", spelled).filter(adr.allowed_region("spelled", ["서울", "광주"]))
    return kept.groupBy("spelled").agg(*[F.countDistinct(c).alias(f"n_{c}") for c in ("source_url", "institution", "department", "place_key")])


SOURCE_COUNTS_SQL = f"""WITH {P} SELECT CASE region WHEN 'ASIA' THEN '서울시' ELSE '전남광주' END AS spelled, count(DISTINCT source_url) AS n_source_url, count(DISTINCT institution) AS n_institution, count(DISTINCT department) AS n_department,
 count(DISTINCT place_key) AS n_place_key FROM p WHERE region IN ('ASIA', 'EUROPE') GROUP BY 1"""


def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a provider, the new ones in place of the old; what its terms don't allow is not kept."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    known = c.filter("c_custkey % 3 <> 0").select(k.alias("id"), F.concat(F.lit("p"), k).alias("place_id"), F.lit("old").alias("photo_id"))
    new = c.filter("c_custkey % 2 = 0").select(k.alias("id"), F.concat(F.lit("q"), k).alias("place_id"), F.lit("new").alias("photo_id"))
    saved = sinks.upsert_ids(known, new.unionByName(new.withColumn("place_id", F.lit("a"))))
    told = saved.withColumn("provider", F.when(F.col("id") % 5 == 0, "fsq").otherwise("own"))
    told = sinks.without_provider(told, "fsq", ["photo_id"])
    m = sinks.without_keys(F.create_map(F.lit("place"), F.col("place_id"), F.lit("shards"), F.lit("x")), ["shards"])
    return told.select("id", "photo_id", F.to_json(m).alias("kept"))


STORED_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS photo_id, '{"place":"' || CASE WHEN c_custkey % 2 = 0 THEN 'q' ELSE 'p' END || c_custkey || '"}' AS kept
FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0"""


def photo_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that may be shown, by licence, size, link and author, whose title says what is looked for; positions that are fresh."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.when(k % 11 != 0, F.concat(F.lit("https://p/"), k)).otherwise("http://p").alias("url"), F.lit(None).cast("string").alias("thumbnail"), F.concat(F.lit("https://s/"), k).alias("foreign_landing_url"),
        (800 + k % 300).cast("int").alias("width"), F.lit(700).alias("height"), F.when(k % 3 == 0, "CC0").when(k % 3 == 1, "by").otherwise("nc").alias("license"), F.lit("https://l").alias("license_url"), F.when(k % 2 == 0, "c").alias("creator"),
        F.when(k % 4 == 0, "Rice").otherwise("Cold noodle").alias("title"), (k % 13 == 0).alias("mature"), F.lit("naengmyeon korean cold noodles").alias("query"),
    )
    return photos.fitting_titles(photos.usable_photos(rows)).select(F.col("id").cast("long").alias("id"), "licence", "attribution")


PHOTO_CANDIDATES_SQL = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'cc0' ELSE 'by' END AS licence, CASE WHEN c_custkey % 2 = 0 THEN '사진: c · ' ELSE '' END || CASE c_custkey % 3 WHEN 0 THEN 'CC0' ELSE 'BY' END || ' · Openverse' AS attribution
FROM customer WHERE c_custkey % 11 <> 0 AND 800 + c_custkey % 300 >= 900 AND c_custkey % 3 < 2 AND (c_custkey % 3 = 0 OR c_custkey % 2 = 0) AND c_custkey % 4 <> 0 AND c_custkey % 13 <> 0"""


QUERIES = {f.__name__: f for f in (
    ledger_headers, daily_ledgers, ledger_scan, json_line_scan, optional_items, holiday_feeds, registry_lookup, registry_conflicts, registry_integrated, matched_places, catalog_matches, placed_addresses, mended_addresses,
    name_rules, unit_rules, purpose_units, old_postings, redacted_names, ledger_places, reduced_rows, amounts_and_dates, sorted_payments, fresh_places, first_spellings, versions_and_links, source_counts, stored_ids, photo_candidates,
)}
SQL = {
    "ledger_headers": HEADERS_SQL,
    "daily_ledgers": DAILY_SQL,
    "ledger_scan": LEDGER_SCAN_SQL,
    "json_line_scan": JSON_SCAN_SQL,
    "optional_items": ITEMS_SQL,
    "holiday_feeds": FEEDS_SQL,
    "registry_lookup": LOOKUP_SQL,
    "registry_conflicts": CONFLICTS_SQL,
    "registry_integrated": INTEGRATED_SQL,
    "matched_places": MATCHED_SQL,
    "catalog_matches": CATALOG_MATCH_SQL,
    "placed_addresses": PLACED_SQL,
    "mended_addresses": MENDED_SQL,
    "name_rules": NAME_RULES_SQL,
    "unit_rules": UNIT_RULES_SQL,
    "purpose_units": PURPOSE_UNITS_SQL,
    "old_postings": OLD_POSTINGS_SQL,
    "redacted_names": REDACTED_SQL,
    "ledger_places": LEDGER_PLACES_SQL,
    "reduced_rows": REDUCED_SQL,
    "amounts_and_dates": AMOUNTS_SQL,
    "sorted_payments": SORTED_SQL,
    "fresh_places": FRESH_SQL,
    "first_spellings": SPELLINGS_SQL,
    "versions_and_links": VERSIONS_SQL,
    "source_counts": SOURCE_COUNTS_SQL,
    "stored_ids": STORED_SQL,
    "photo_candidates": PHOTO_CANDIDATES_SQL,
}
