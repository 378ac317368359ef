"""Queries over catalogs: documents, links, manifests, saved outputs, writers, and the variants of place aggregation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as adr
from ..functions import photos, scalars, text
from ..operators import documents, merge, places, quality
from ..session import scratch_dir
from ..sources import sinks, tables
from .surrogates import P, as_of, payments, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def place_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by (name, institution), an empty department counting as one, with the share of meals."""
    p = payments(spark, sf_dir).withColumn("department", F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.col("department")))
    facts = places.place_facts(p, ["name", "institution"], empty_counts=True)
    meals = p.groupBy("name", "institution").agg(F.count_if("is_meal").alias("n_meals"))
    return places.ranked_places(facts.join(meals, ["name", "institution"])).select("name", "institution", "record_count", "department_count", "median_amount", "first_date", "last_date", "n_meals")


VARIANTS_SQL = f"""WITH {P} SELECT name, institution, count(*) AS record_count, count(DISTINCT CASE WHEN l_partkey % 5 = 0 THEN '' ELSE department END)::INT AS department_count, CAST(floor(median(amount) FILTER (amount > 0)) AS BIGINT) AS median_amount,
 min(payment_date) AS first_date, max(payment_date) AS last_date, count(*) FILTER (is_meal) AS n_meals FROM p GROUP BY name, institution"""


def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one catalog document, read back with its checks: places without a name, with a bad link or a bad day go."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("rank"), F.when(k % 11 == 0, " ").otherwise(F.col("s_name")).alias("name"), F.concat(F.lit("addr "), k).alias("address"), F.when(k % 2 == 0, "서울").alias("region"), (k % 7).cast("int").alias("departmentCount"),
        F.when(k % 13 == 0, "2026-02-30").otherwise("2026-01-01").alias("lastPaymentDate"), F.when(k % 17 == 0, "http://x/").otherwise(F.concat(F.lit("https://x/"), k)).alias("sourceURL"),
    )
    doc = merge.catalog_document(rows, "2026-09-13T00:00:00Z", "all", ["https://x"])
    faulty = merge.catalog_document(rows, "2026-09-13T00:00:00Z", " ", ["https://x"])
    return documents.load_catalog(doc.unionByName(faulty)).select("name", "address", "region", "departmentCount", "lastPaymentDate", "sourceURL")


ROUND_TRIP_SQL = """SELECT s_name AS name, 'addr ' || s_suppkey AS address, CASE WHEN s_suppkey % 2 = 0 THEN '서울' END AS region, (s_suppkey % 7)::INT AS "departmentCount", '2026-01-01' AS "lastPaymentDate", 'https://x/' || s_suppkey AS "sourceURL"
FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0"""


def harvested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe links anywhere in JSON documents of several shapes, and those of one region."""
    k = F.col("s_suppkey")
    url = lambda name: F.concat(F.lit(f'"https://{name}/'), k, F.lit('"'))
    doc = F.when(k % 3 == 0, F.concat(F.lit('{"서울특별시": ['), url("s"), F.lit(","), url("s"), F.lit('], "부산": '), url("b"), F.lit("}")))
    doc = doc.when(k % 3 == 1, F.concat(F.lit('{"regions": [{"region": "부산시", "u": '), url("b"), F.lit('}, {"region": "서울", "u": {"v": '), url("t"), F.lit("}}]}"))).otherwise(F.concat(F.lit('{"a": '), url("x"), F.lit(', "b": "http://no", "https://key": 1}')))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("doc"))
    return rows.select("s_suppkey", F.array_join(documents.https_urls(F.col("doc")), " ").alias("links"), F.array_join(documents.region_urls(F.col("doc"), F.lit("서울")), " ").alias("seoul"))


HARVESTED_SQL = """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'https://s/' || s_suppkey || ' https://b/' || s_suppkey WHEN 1 THEN 'https://b/' || s_suppkey || ' https://t/' || s_suppkey ELSE 'https://x/' || s_suppkey END AS links,
 CASE s_suppkey % 3 WHEN 0 THEN 'https://s/' WHEN 1 THEN 'https://t/' ELSE 'https://x/' END || s_suppkey AS seoul FROM supplier"""


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each customer's rotation through three, seven and eleven choices begins."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.fnv1a64("c_name").alias("hash"), *[text.rotation("c_name", n).cast("int").alias(f"of_{n}") for n in (3, 7, 11)])


ROTATIONS_SQL = """WITH h AS (SELECT c_custkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS u FROM customer)
SELECT c_custkey, CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END::BIGINT AS hash, (u % 3)::INT AS of_3, (u % 7)::INT AS of_7, (u % 11)::INT AS of_11 FROM h"""


def replayed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a manifest: those that lack, those with other bytes, and the rest with the source that their digest tells."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    files = c.filter("c_custkey % 10 <> 3").select(F.concat(F.lit("/cache/f"), k).alias("path"), F.col("c_name").cast("binary").alias("content"))
    manifest = c.select(F.concat(F.lit("f"), k).alias("file_name"), F.when(k % 7 == 0, "00").otherwise(F.upper(F.sha2(F.col("c_name").cast("binary"), 256))).alias("sha256"), F.concat(F.when(k % 4 == 0, "http").otherwise("https"), F.lit("://x/"), k).alias("url"))
    told = tables.checked_by_manifest(files, manifest).withColumn("sha256", F.sha2("content", 256))
    sources = manifest.select(F.lower("sha256").alias("sha256"), "url")
    known = documents.provenance(sources, told.select("file_name", "sha256", "error")).filter("error is null").select(F.col("file_name").alias("f"), F.col("url").alias("source"))
    return told.join(known, F.col("file_name") == F.col("f"), "left").select("file_name", "error", "source")


MANIFEST_SQL = """SELECT 'f' || c_custkey AS file_name, CASE WHEN c_custkey % 10 = 3 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'sha256 differs' END AS error,
 CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 7 <> 0 AND c_custkey % 4 <> 0 THEN 'https://x/' || c_custkey END AS source FROM customer"""


def saved_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two saved outputs, the first of each id; records without an id get one from their fields."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.when(k % 9 != 0, (k % 700).cast("string")).alias("recordID"), F.lit("r").alias("region"), F.lit("i").alias("institution"), F.when(k % 9 == 0, F.concat(F.lit("n"), k % 27)).otherwise("x").alias("name"), F.lit("a").alias("address"), F.lit("2026-01-01").alias("paymentDate"), (k % 2).alias("part"),
    )
    out = documents.saved_outputs([c.filter("part = 1").drop("part"), c.filter("part = 0").drop("part")])
    return out.groupBy("shard_no").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("recordID") == 64).alias("n_made"))


SAVED_SQL = """WITH c AS (SELECT CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 700 AS VARCHAR) ELSE 'n' || (c_custkey % 27) END AS id, c_custkey % 9 = 0 AS made, 1 - c_custkey % 2 AS shard FROM customer),
 f AS (SELECT id, made, min(shard) AS shard FROM c GROUP BY ALL) SELECT shard::INT AS shard_no, count(*) AS n, count(*) FILTER (made) AS n_made FROM f GROUP BY shard"""


def ledger_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the department of their document, by id and by an id that a cell contains."""
    k = F.col("c_custkey")
    metadata = table(spark, sf_dir, "supplier").select(F.concat(F.lit("DOC"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("document_id"), F.col("s_name").alias("department"))
    files = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("no. "), F.lit("DOC"), F.lpad((k % 300).cast("string"), 6, "0"), F.lit(" / 2026")).alias("cell"))
    return documents.with_metadata(files, metadata, contained="cell").select("c_custkey", "department")


METADATA_SQL = "SELECT c_custkey, s_name AS department FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 300"


def written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as sorted JSON lines and as CSV of some columns, and read again."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.lit("private").alias("phone"))
    lines, csv = _folder(spark, "records"), _folder(spark, "table")
    sinks.write_json_lines(rows.drop("phone"), lines, ["id"])
    sinks.write_csv(rows, csv, ["id", "c_name"])
    read = spark.read.schema("id long, c_name string, segment string").json(lines)
    return read.join(spark.read.csv(csv, header=True).select(F.col("id").cast("long").alias("id"), F.col("c_name").alias("csv_name")), "id")


WRITTEN_SQL = "SELECT c_custkey AS id, c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, c_name AS csv_name FROM customer"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as they are written, and positions that are fresh and known well enough."""
    k = F.col("c_custkey")
    told = F.when(k % 5 == 0, "x").when(k % 5 == 1, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.concat((k % 90).cast("string"), F.lit(".25")))
    now = F.lit("2026-01-01 12:00:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(now) - (k % 600) + 60)
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.coordinate(told, -90, 90).alias("latitude"), photos.fresh_position((k % 4 - 1).cast("double"), at, now).alias("fresh"))


POSITIONS_SQL = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN c_custkey <= 90 THEN c_custkey::DOUBLE END ELSE c_custkey % 90 + CASE WHEN c_custkey % 90 + 0.25 <= 90 THEN 0.25::DOUBLE END END AS latitude,
 c_custkey % 4 >= 1 AND c_custkey % 600 BETWEEN 60 AND 360 AS fresh FROM customer"""


def provider_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two places' addresses agree: equal, or the shorter of six characters or more within the longer."""
    k = F.col("c_custkey")
    ours = F.array(F.concat(F.lit("무교로"), k % 50), F.lit(""))
    theirs = F.array(F.when(k % 2 == 0, F.concat(F.lit("중구무교로"), k % 50)).otherwise(F.concat(F.lit("무교로"), k % 7)), F.lit(""))
    return table(spark, sf_dir, "customer").select("c_custkey", adr.same_provider_address(ours, theirs).alias("same"))


PROVIDER_ADDRESSES_SQL = """WITH a AS (SELECT c_custkey, '무교로' || (c_custkey % 50) AS a, CASE WHEN c_custkey % 2 = 0 THEN '중구무교로' || (c_custkey % 50) ELSE '무교로' || (c_custkey % 7) END AS b FROM customer)
SELECT c_custkey, a = b OR (least(length(a), length(b)) >= 6 AND (contains(a, b) OR contains(b, a))) AS same FROM a"""


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage of all regions as nested JSON, with what lies in the future left out."""
    p = payments(spark, sf_dir).filter(F.col("payment_date") <= as_of())
    stats = merge.region_stats(p.filter("region <> 'AFRICA'"))
    dim = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    every = merge.all_regions(dim, stats)
    nested = F.struct(F.col("row_count").alias("rows"), F.col("place_count").alias("places"), F.struct(F.col("first_date").cast("string").alias("from"), F.col("last_date").cast("string").alias("to")).alias("period"))
    return every.select("region", "is_covered", F.to_json(nested).alias("coverage"))


REPORT_SQL = f"""WITH {P}, s AS (SELECT region, count(*) AS n, count(DISTINCT place_key) AS m, min(payment_date) AS a, max(payment_date) AS b FROM p WHERE payment_date <= DATE '2001-06-30' AND region <> 'AFRICA' GROUP BY region)
SELECT r_name AS region, s.region IS NOT NULL AS is_covered, CASE WHEN s.region IS NULL THEN '{{"rows":0,"places":0,"period":{{}}}}' ELSE '{{"rows":' || n || ',"places":' || m || ',"period":{{"from":"' || a || '","to":"' || b || '"}}}}' END AS coverage FROM region LEFT JOIN s ON r_name = s.region"""


def shortened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, or the names of their parts if they are long; what lacks in each."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.repeat(F.lit("x"), 60).alias("text")))).otherwise(F.to_json(F.struct(F.col("user_id").alias("user")))).alias("doc"))
    return e.select("event_id", merge.summarised(F.col("doc"), 50).alias("short"), F.array_join(quality.missing_keys(F.col("doc"), ["type", "user"]), ",").alias("missing"))


SHORTENED_SQL = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"keys":["type","user","text"],"length":' || (length(event_type) + length(CAST(user_id AS VARCHAR)) + 60 + 29) || '}' ELSE '{"user":' || user_id || '}' END AS short,
 CASE WHEN event_id % 2 = 0 THEN '' ELSE 'type' END AS missing FROM events"""

QUERIES = {f.__name__: f for f in (place_variants, catalog_round_trip, harvested_links, rotations, replayed_manifest, saved_outputs, ledger_metadata, written_and_read, positions, provider_addresses, coverage_report, shortened_documents)}
SQL = {
    "place_variants": VARIANTS_SQL,
    "catalog_round_trip": ROUND_TRIP_SQL,
    "harvested_links": HARVESTED_SQL,
    "rotations": ROTATIONS_SQL,
    "replayed_manifest": MANIFEST_SQL,
    "saved_outputs": SAVED_SQL,
    "ledger_metadata": METADATA_SQL,
    "written_and_read": WRITTEN_SQL,
    "positions": POSITIONS_SQL,
    "provider_addresses": PROVIDER_ADDRESSES_SQL,
    "coverage_report": REPORT_SQL,
    "shortened_documents": SHORTENED_SQL,
}
