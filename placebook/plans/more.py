"""More queries: periods, refreshes, evidence, reminders, situations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, fixed
from ..functions.scalars import minute_of_day
from ..operators import documents, merge, serve
from .serving import _menus, _told_sql
from .surrogates import P, choice, payments, sql_choice, table


def region_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.period(payments(spark, sf_dir), ["region"])
    return out.select("region", "first_date", "last_date", F.array_join("departments", "|").alias("departments"), F.array_join("institutions", "|").alias("institutions"), F.size("source_urls").cast("long").alias("n_urls"))


PERIOD_SQL = f"""WITH {P} SELECT region, min(payment_date) AS first_date, max(payment_date) AS last_date, string_agg(DISTINCT department, '|' ORDER BY department) AS departments,
 string_agg(DISTINCT institution, '|' ORDER BY institution) AS institutions, count(DISTINCT source_url) AS n_urls FROM p GROUP BY region"""


def curated_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the curated label of their nation, if it has one."""
    curated = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.lower("n_name").alias("curated"))
    return serve.with_curated(table(spark, sf_dir, "customer"), curated, "c_nationkey").select("c_custkey", "curated")


CURATED_SQL = "SELECT c_custkey, lower(n_name) AS curated FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 = 0"


def refreshed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account values replaced where a newer one is there."""
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("value"))
    return serve.refreshed(old, new, "c_custkey", "value")


REFRESHED_SQL = "SELECT c_custkey, coalesce(CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END, c_acctbal) AS value FROM customer LEFT JOIN supplier ON s_suppkey * 3 = c_custkey"


def preserved_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir)
    old, new = rows.filter("l_partkey % 2 = 0"), rows.filter("l_partkey % 2 = 1 and region in ('ASIA', 'EUROPE')")
    return documents.preserved(old, new, ["ASIA", "EUROPE"]).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


PRESERVED_SQL = f"""WITH {P} SELECT region, count(*) AS n, sum(amount)::BIGINT AS total FROM p WHERE (l_partkey % 2 = 0 AND region NOT IN ('ASIA', 'EUROPE')) OR (l_partkey % 2 = 1 AND region IN ('ASIA', 'EUROPE')) GROUP BY region"""


def preserved_regions_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions collected anew in place of their old rows; the two parts hold all payments together."""
    rows = payments(spark, sf_dir)
    anew = "l_partkey % 2 = 1 and region in ('ASIA', 'EUROPE')"
    return documents.preserved(rows.filter(f"not ({anew})"), rows.filter(anew), ["ASIA", "EUROPE"]).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


PRESERVED_WHOLE_SQL = f"""WITH {P} SELECT region, count(*) AS n, sum(amount)::BIGINT AS total FROM p WHERE region NOT IN ('ASIA', 'EUROPE') OR l_partkey % 2 = 1 GROUP BY region"""


def department_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir)
    told = documents.department_of(F.when(F.col("l_partkey") % 3 == 0, F.col("department")), F.when(F.col("l_partkey") % 2 == 0, F.col("institution")), F.when(F.col("l_partkey") % 5 == 0, F.col("region")))
    return rows.select(told.alias("d")).groupBy("d.evidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("d.department").alias("n_departments"))


EVIDENCE_SQL = f"""WITH {P} SELECT CASE WHEN l_partkey % 3 = 0 THEN 'row' WHEN l_partkey % 2 = 0 THEN 'sheet' WHEN l_partkey % 5 = 0 THEN 'posting' ELSE 'none' END AS evidence, count(*) AS n,
 count(DISTINCT CASE WHEN l_partkey % 3 = 0 THEN department WHEN l_partkey % 2 = 0 THEN institution WHEN l_partkey % 5 = 0 THEN region ELSE '' END) AS n_departments FROM p GROUP BY 1"""


def reminder_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(minute_of_day(F.hour("ts"), F.minute("ts"), F.lit(30)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


REMINDER_SQL = "SELECT ((hour(ts) * 60 + minute(ts) - 30) % 1440 + 1440) % 1440 AS minute, count(*) AS n FROM events GROUP BY 1"


def menu_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many restaurants have a dish for each situation, and the first one's dish."""
    rows = _menus(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(s).alias("situation"), classify.menu_for(F.col("menus"), s).alias("menu")) for s in fixed.SITUATIONS])
    return rows.select("id", F.explode(each).alias("x")).select("id", "x.*").filter("menu is not null").groupBy("situation").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _situation_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{s}' AS situation, count(DISTINCT id) AS n, min(id) AS first_id FROM e WHERE regexp_matches(menu, '{'|'.join(w)}') HAVING count(*) > 0" for s, w in fixed.SITUATIONS.items())
    return f"{_told_sql()} {parts}"


TITLES = ["2026년 8월 업무추진비 (AI혁신과)", "[운영지원과장] 8월 집행내역", "탄소중립경제과 업무추진비", "업무추진비 공개"]
TITLE_UNITS = ["AI혁신과", "운영지원과", "탄소중립경제과", None]


def title_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", choice(TITLES, "s_suppkey").alias("title"))
    return rows.select("s_suppkey", classify.title_department("title").alias("department"))


TITLE_SQL = "SELECT s_suppkey, ([" + ", ".join("NULL" if u is None else f"'{u}'" for u in TITLE_UNITS) + "])[s_suppkey % 4 + 1] AS department FROM supplier"
REASONS = ["a", "b", "c"]


def reason_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of two shards merged by key, as text."""
    from ..operators.quality import as_map

    e = table(spark, sf_dir, "events").withColumn("reason", choice(REASONS, "user_id"))
    two = merge.in_order([e.filter("event_id % 2 = 0").groupBy("reason").count(), e.filter("event_id % 2 = 1").groupBy("reason").count()])
    return as_map(two.groupBy("reason").agg(F.sum("count").alias("n")), "reason", "n", "m").select(F.to_json("m").alias("counters"))


REASON_SQL = f"""WITH r AS (SELECT {sql_choice(REASONS, "user_id")} AS reason, count(*) AS n FROM events GROUP BY 1) SELECT '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS counters FROM r"""

QUERIES = {f.__name__: f for f in (region_period, curated_menus, refreshed_values, preserved_regions, preserved_regions_whole, department_evidence, reminder_minutes, menu_situations, title_departments, reason_map)}
SQL = {
    "region_period": PERIOD_SQL,
    "curated_menus": CURATED_SQL,
    "refreshed_values": REFRESHED_SQL,
    "preserved_regions": PRESERVED_SQL,
    "preserved_regions_whole": PRESERVED_WHOLE_SQL,
    "department_evidence": EVIDENCE_SQL,
    "reminder_minutes": REMINDER_SQL,
    "menu_situations": _situation_sql(),
    "title_departments": TITLE_SQL,
    "reason_map": REASON_SQL,
}
