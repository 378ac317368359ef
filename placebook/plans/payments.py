"""Queries over payments: validation, dedup, aggregation, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import in_window, is_https
from ..operators import merge, places, quality
from .surrogates import MONTHS, SQL_AS_OF, SQL_FROM, P, as_of, payments, table


def _order():
    return [F.col("ordinal"), F.col("amount"), F.col("l_quantity")]


def _rules():
    return [
        ("not_meal", F.col("is_meal")),
        ("bad_url", is_https("source_url")),
        ("future", F.col("payment_date") <= as_of()),
        ("too_old", F.col("payment_date") >= F.add_months(as_of(), -MONTHS)),
        ("small_amount", F.col("amount") >= 2000),
    ]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per place over the last 18 months: payments, departments, dates, median, newest document; ranked."""
    rows = payments(spark, sf_dir).filter(F.col("is_meal") & in_window("payment_date", as_of(), MONTHS))
    facts = places.place_facts(rows, ["place_key", "name"])
    out = facts.withColumn("departments", F.array_join("departments", "|"))
    return places.ranked_places(out).select("place_key", "name", "record_count", "department_count", "departments", "first_date", "last_date", "median_amount", "newest_url")


FLAGSHIP_SQL = f"""WITH {P}
SELECT place_key, name, count(*) AS record_count, count(DISTINCT department)::INT AS department_count,
       string_agg(DISTINCT department, '|' ORDER BY department) AS departments, min(payment_date) AS first_date, max(payment_date) AS last_date,
       CAST(floor(median(amount) FILTER (amount > 0)) AS BIGINT) AS median_amount,
       arg_max(source_url, (payment_date, -ordinal)) AS newest_url
FROM p WHERE is_meal AND payment_date BETWEEN {SQL_FROM} AND {SQL_AS_OF} GROUP BY place_key, name"""

CHECKS = f"""CASE WHEN NOT is_meal THEN 'not_meal' WHEN payment_date > {SQL_AS_OF} THEN 'future' WHEN payment_date < {SQL_FROM} THEN 'too_old' WHEN amount < 2000 THEN 'small_amount' END"""


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reason a row; copies of a record are found after all rules."""
    return quality.histogram(quality.validated(payments(spark, sf_dir), _rules(), ["record_id"], _order()).withColumn("reject_reason", F.coalesce("reject_reason", F.lit("accepted"))))


REJECT_SQL = f"""WITH {P}, c AS (SELECT *, {CHECKS} AS why FROM p),
d AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY record_id, why IS NULL ORDER BY ordinal, amount, l_quantity) > 1 THEN 'duplicate' ELSE why END AS r FROM c)
SELECT coalesce(r, 'accepted') AS reject_reason, count(*) AS n_rows FROM d GROUP BY ALL"""


def reject_reasons_early_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but copies are found after the first two rules: a bad first copy claims the record."""
    return quality.histogram(quality.validated(payments(spark, sf_dir), _rules(), ["record_id"], _order(), before=2).withColumn("reject_reason", F.coalesce("reject_reason", F.lit("accepted"))))


EARLY_SQL = f"""WITH {P}, c AS (SELECT *, {CHECKS} AS why, is_meal AS early FROM p),
d AS (SELECT *, early AND row_number() OVER (PARTITION BY record_id, early ORDER BY ordinal, amount, l_quantity) > 1 AS copy FROM c)
SELECT CASE WHEN NOT early THEN 'not_meal' WHEN copy THEN 'duplicate' ELSE coalesce(why, 'accepted') END AS reject_reason, count(*) AS n_rows FROM d GROUP BY ALL"""


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.keep_one(payments(spark, sf_dir), ["record_id"], _order())
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


DEDUP_FIRST_SQL = f"""WITH {P}, d AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ordinal, amount, l_quantity) AS r FROM p)
SELECT region, count(*) AS n, sum(amount)::BIGINT AS total FROM d WHERE r = 1 GROUP BY region"""


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each region and record, with the place of the first."""
    order = [c.desc() for c in _order()]
    rows = payments(spark, sf_dir)
    first = rows.groupBy("region", "record_id").agg(F.min("ordinal").alias("first_ordinal"))
    return quality.keep_one(rows, ["region", "record_id"], order).join(first, ["region", "record_id"]).groupBy("region").agg(F.sum("amount").alias("total"), F.sum(F.col("first_ordinal") % 1000).alias("firsts"))


DEDUP_LAST_SQL = f"""WITH {P}, d AS (SELECT *, row_number() OVER (PARTITION BY region, record_id ORDER BY ordinal DESC, amount DESC, l_quantity DESC) AS r, min(ordinal) OVER (PARTITION BY region, record_id) AS f FROM p)
SELECT region, sum(amount)::BIGINT AS total, sum(f % 1000)::BIGINT AS firsts FROM d WHERE r = 1 GROUP BY region"""


def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.most_common(payments(spark, sf_dir), ["place_key"], "department", F.col("ordinal"), "top_department")


MODE_SQL = f"""WITH {P}, c AS (SELECT place_key, department, count(*) AS n, min(ordinal) AS f FROM p GROUP BY ALL)
SELECT place_key, arg_max(department, (n, -f)) AS top_department FROM c GROUP BY place_key"""


def newest_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = places.newest_urls(payments(spark, sf_dir), ["place_key"], "source_url", "payment_date", F.col("ordinal"))
    return out.select("place_key", F.size("urls").alias("n_urls"), F.array_join("urls", " ").alias("urls"))


NEWEST_SQL = f"""WITH {P}, u AS (SELECT place_key, source_url, max((payment_date, -ordinal)) AS a FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY a DESC, source_url) AS k FROM u)
SELECT place_key, count(*)::INT AS n_urls, string_agg(source_url, ' ' ORDER BY k) AS urls FROM r WHERE k <= 10 GROUP BY place_key"""


def complete_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.complete_month(payments(spark, sf_dir).filter("is_meal"), department="place_key")


COMPLETE_SQL = f"""WITH {P}, b AS (SELECT date_trunc('month', payment_date) AS m, count(DISTINCT place_key) AS n, max(payment_date) AS d FROM p WHERE is_meal GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY m DESC) AS r, max(d) OVER () AS latest FROM b),
x AS (SELECT CASE WHEN count(*) >= 7 THEN CAST(median(n) FILTER (r BETWEEN 2 AND 7) AS DOUBLE) ELSE 0.0::DOUBLE END AS base FROM o)
SELECT max(base) AS base, strftime(coalesce(max(m) FILTER (CAST(last_day(CAST(m + INTERVAL 1 MONTH AS DATE)) AS DATE) <= latest AND n >= 0.95 * base), max(m)), '%Y-%m') AS complete_month FROM o, x"""


def month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments(spark, sf_dir).groupBy(F.date_format("payment_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("department").alias("n_departments"))


MONTH_SQL = f"""WITH {P} SELECT strftime(payment_date, '%Y-%m') AS month, count(*) AS n_rows, count(DISTINCT department) AS n_departments FROM p GROUP BY 1"""


def last_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest N + 2 months of the month map."""
    return month_counts(spark, sf_dir).orderBy(F.col("month").desc()).limit(MONTHS + 2)


LAST_MONTHS_SQL = MONTH_SQL + f" ORDER BY month DESC LIMIT {MONTHS + 2}"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir).filter(in_window("payment_date", as_of(), 1) & (F.col("region") != "ASIA"))
    dim = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"))
    return merge.all_regions(dim, merge.region_stats(rows))


def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)


REGION_SQL = f"""WITH {P}, s AS (SELECT region, count(*) AS row_count, count(DISTINCT institution) AS institution_count, count(DISTINCT place_key) AS place_count,
  min(payment_date) AS first_date, max(payment_date) AS last_date FROM p WHERE region <> 'ASIA' AND payment_date BETWEEN CAST({SQL_AS_OF} - INTERVAL 1 MONTH AS DATE) AND {SQL_AS_OF} GROUP BY region)
SELECT r_name AS region, coalesce(row_count, 0) AS row_count, coalesce(institution_count, 0) AS institution_count, coalesce(place_count, 0) AS place_count,
  first_date, last_date, coalesce(row_count, 0) > 0 AS is_covered FROM region LEFT JOIN s ON r_name = region"""


def national_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.national(_regions(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, "|") for c in ("covered_regions", "missing_regions")})


NATIONAL_SQL = f"""WITH g AS ({REGION_SQL})
SELECT sum(row_count)::BIGINT AS row_count, sum(place_count)::BIGINT AS place_count, coalesce(string_agg(region, '|' ORDER BY region) FILTER (is_covered), '') AS covered_regions,
  coalesce(string_agg(region, '|' ORDER BY region) FILTER (NOT is_covered), '') AS missing_regions, bool_and(is_covered) AS complete FROM g"""


def parse_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"dated": F.col("payment_date") <= as_of(), "meal": F.col("is_meal"), "matched": F.col("l_partkey") % 3 != 0, "accepted": F.col("amount") >= 2000}
    return quality.funnel(payments(spark, sf_dir), ["region"], stages)


FUNNEL_SQL = f"""WITH {P} SELECT region, count(*) AS n_rows, count(*) FILTER (payment_date <= {SQL_AS_OF}) AS dated,
  count(*) FILTER (payment_date <= {SQL_AS_OF} AND is_meal) AS meal, count(*) FILTER (payment_date <= {SQL_AS_OF} AND is_meal AND l_partkey % 3 <> 0) AS matched,
  count(*) FILTER (payment_date <= {SQL_AS_OF} AND is_meal AND l_partkey % 3 <> 0 AND amount >= 2000) AS accepted FROM p GROUP BY region"""


def pending_not_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payments(spark, sf_dir)
    accepted = rows.filter((F.col("l_linestatus") == "F") & F.col("is_meal")).select("record_id").distinct()
    return rows.filter("is_meal").join(accepted, "record_id", "left_anti").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


PENDING_SQL = f"""WITH {P}, a AS (SELECT DISTINCT record_id FROM p WHERE l_linestatus = 'F' AND is_meal)
SELECT region, count(*) AS n, sum(amount)::BIGINT AS total FROM p WHERE is_meal AND record_id NOT IN (SELECT record_id FROM a) GROUP BY region"""


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one half of the shards with what the other half adds to them."""
    rows = payments(spark, sf_dir).withColumns({"key": F.col("place_key") % 70, "variant": F.concat(F.lit("v"), F.col("place_key") % 35)})

    def half(part: DataFrame, offset: int) -> DataFrame:
        facts = part.groupBy("place_key", "key").agg(
            F.count(F.lit(1)).alias("record_count"), F.array_sort(F.collect_set("department")).alias("departments"),
            F.array_sort(F.collect_set("variant")).alias("name_variants"), F.min("payment_date").alias("first_date"), F.max("payment_date").alias("last_date"),
        )
        return facts.select((F.col("place_key") + offset).alias("ordinal"), F.col("key").alias("address_key"), "record_count", "departments", "name_variants", "first_date", "last_date")

    out = merge.upsert(half(rows.filter("place_key % 4 < 2"), 0), half(rows.filter("place_key % 4 >= 1"), 0))
    return out.select("ordinal", "origin", "address_key", "record_count", F.array_join("departments", "|").alias("departments"), F.array_join("name_variants", "|").alias("name_variants"), "first_date", "last_date")


UPSERT_SQL = f"""WITH {P}, r AS (SELECT *, place_key % 70 AS key, 'v' || (place_key % 35) AS variant FROM p),
b AS (SELECT place_key AS ordinal, key, count(*) AS n, min(payment_date) AS f, max(payment_date) AS t FROM r WHERE place_key % 4 < 2 GROUP BY place_key, key),
m AS (SELECT place_key AS ordinal, key, count(*) AS n, min(payment_date) AS f, max(payment_date) AS t FROM r WHERE place_key % 4 >= 1 GROUP BY place_key, key),
bv AS (SELECT DISTINCT place_key AS ordinal, key, variant FROM r WHERE place_key % 4 < 2), mv AS (SELECT DISTINCT place_key AS ordinal, key, variant FROM r WHERE place_key % 4 >= 1),
h AS (SELECT mv.ordinal AS more, min(bv.ordinal) AS base FROM mv JOIN bv ON mv.key = bv.key AND mv.variant = bv.variant GROUP BY 1),
o AS (SELECT ordinal AS place, ordinal AS unit, 'base' AS origin, 0 AS side FROM b UNION ALL SELECT base, more, 'base', 1 FROM h UNION ALL SELECT ordinal, ordinal, 'added', 1 FROM m WHERE ordinal NOT IN (SELECT more FROM h)),
d AS (SELECT DISTINCT o.place, o.origin, r.department FROM o JOIN r ON r.place_key = o.unit), v AS (SELECT DISTINCT o.place, o.origin, r.variant FROM o JOIN r ON r.place_key = o.unit),
n AS (SELECT o.place, o.origin, sum(coalesce(b.n, m.n))::BIGINT AS record_count, min(coalesce(b.f, m.f)) AS first_date, max(coalesce(b.t, m.t)) AS last_date FROM o LEFT JOIN b ON side = 0 AND b.ordinal = unit LEFT JOIN m ON side = 1 AND m.ordinal = unit GROUP BY 1, 2)
SELECT place AS ordinal, origin, place % 70 AS address_key, record_count, (SELECT string_agg(department, '|' ORDER BY department) FROM d WHERE d.place = n.place AND d.origin = n.origin) AS departments,
 (SELECT string_agg(variant, '|' ORDER BY variant) FROM v WHERE v.place = n.place AND v.origin = n.origin) AS name_variants, first_date, last_date FROM n"""


def catalog_upsert_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a quarter of the payments, and all others added to them one after another: additions meet earlier additions, in chains."""
    facts = payments(spark, sf_dir).groupBy("place_key").agg(
        F.count(F.lit(1)).alias("record_count"), F.array_sort(F.collect_set("department")).alias("departments"), F.min("payment_date").alias("first_date"), F.max("payment_date").alias("last_date"),
    )
    k = F.col("place_key")
    names = F.array(F.concat(F.lit("v"), k % 33), F.concat(F.lit("w"), F.floor(k / 70) % 7), F.concat(F.lit("x"), F.floor(k / 7) % 11))
    rows = facts.select(k.alias("ordinal"), (k % 70).alias("address_key"), "record_count", "departments", names.alias("name_variants"), "first_date", "last_date")
    out = merge.upsert_in_order(rows.filter("ordinal % 9 = 0"), rows.filter("ordinal % 9 > 0"))
    return out.select("ordinal", "origin", "address_key", "record_count", F.array_join("departments", "|").alias("departments"), F.array_join("name_variants", "|").alias("name_variants"), "first_date", "last_date")


CHAINS_SQL = f"""WITH RECURSIVE {P}, u AS (
  SELECT place_key AS ordinal, CASE WHEN place_key % 9 = 0 THEN 0 ELSE 1000000000 END + place_key AS node, place_key % 70 AS key, count(*) AS n, min(payment_date) AS f, max(payment_date) AS t, list(DISTINCT department) FILTER (department IS NOT NULL) AS d,
    ['v' || (place_key % 33), 'w' || (place_key // 70 % 7), 'x' || (place_key // 7 % 11)] AS vs FROM p GROUP BY place_key
), x AS (SELECT node, key, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM u),
b AS (SELECT *, lag(node) OVER (PARTITION BY key, v ORDER BY node) AS up FROM x),
q AS (SELECT node, CASE WHEN node >= 1000000000 THEN arg_min(up, i) FILTER (up IS NOT NULL) END AS up FROM b GROUP BY node),
r AS (SELECT node, node AS root FROM q WHERE up IS NULL UNION ALL SELECT q.node, r.root FROM q JOIN r ON q.up = r.node)
SELECT root % 1000000000 AS ordinal, CASE WHEN root < 1000000000 THEN 'base' ELSE 'added' END AS origin, any_value(key) AS address_key, sum(n)::BIGINT AS record_count, coalesce(array_to_string(list_sort(list_distinct(flatten(list(d)))), '|'), '') AS departments,
  array_to_string(list_sort(list_distinct(flatten(list(vs)))), '|') AS name_variants, min(f) AS first_date, max(t) AS last_date FROM r JOIN u USING (node) GROUP BY root"""


def sources_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by URL; where the newer half has one, its row."""
    rows = payments(spark, sf_dir)
    by = lambda part: part.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"), F.max("payment_date").alias("last_date"))
    return merge.last_wins(by(rows.filter("place_key % 2 = 0")), by(rows.filter("place_key % 2 = 1 and l_partkey % 2 = 0")), ["source_url"])


LAST_WINS_SQL = f"""WITH {P}, a AS (SELECT source_url, count(*) AS n, max(payment_date) AS last_date FROM p WHERE place_key % 2 = 0 GROUP BY 1),
b AS (SELECT source_url, count(*) AS n, max(payment_date) AS last_date FROM p WHERE place_key % 2 = 1 AND l_partkey % 2 = 0 GROUP BY 1)
SELECT * FROM a WHERE source_url NOT IN (SELECT source_url FROM b) UNION ALL SELECT * FROM b"""


def sources_last_wins_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by URL; where the newer half has one, its row. The halves hold all payments together."""
    rows = payments(spark, sf_dir)
    by = lambda part: part.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"), F.max("payment_date").alias("last_date"))
    return merge.last_wins(by(rows.filter("not (place_key % 2 = 1 and l_partkey % 2 = 0)")), by(rows.filter("place_key % 2 = 1 and l_partkey % 2 = 0")), ["source_url"])


LAST_WINS_WHOLE_SQL = f"""WITH {P}, a AS (SELECT source_url, count(*) AS n, max(payment_date) AS last_date FROM p WHERE place_key % 2 = 0 OR l_partkey % 2 = 1 GROUP BY 1),
b AS (SELECT source_url, count(*) AS n, max(payment_date) AS last_date FROM p WHERE place_key % 2 = 1 AND l_partkey % 2 = 0 GROUP BY 1)
SELECT * FROM a WHERE source_url NOT IN (SELECT source_url FROM b) UNION ALL SELECT * FROM b"""


def ordered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.ordered_distinct(payments(spark, sf_dir).withColumn("unit", F.concat_ws("/", "department", "institution")), ["region"], "unit", F.col("ordinal"), "units")
    return out.select("region", F.array_join("units", "|").alias("units"))


ORDERED_SQL = f"""WITH {P}, u AS (SELECT region, department || '/' || institution AS unit, min(ordinal) AS f FROM p GROUP BY ALL)
SELECT region, string_agg(unit, '|' ORDER BY f, unit) AS units FROM u GROUP BY region"""


def pages_until_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of a list of parts: pages before the first that shows nothing new."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 200).alias("item"))
    return quality.pages_until_repeat(pages, "page", "item").select("page", "item")


PAGES_SQL = """WITH i AS (SELECT l_orderkey AS page, l_partkey % 200 AS item FROM lineitem), f AS (SELECT item, min(page) AS page FROM i GROUP BY item),
n AS (SELECT DISTINCT page FROM i), s AS (SELECT min(page) AS stop FROM n WHERE page NOT IN (SELECT page FROM f))
SELECT page, item FROM f, s WHERE stop IS NULL OR page < stop"""

QUERIES = {
    "place_ranking": flagship,
    "reject_reasons": reject_reasons,
    "reject_reasons_early_dedup": reject_reasons_early_dedup,
    "dedup_first": dedup_first,
    "dedup_last": dedup_last,
    "mode_first_seen": mode_first_seen,
    "newest_urls": newest_urls,
    "complete_month": complete_month,
    "month_counts": month_counts,
    "last_months": last_months,
    "region_coverage": region_coverage,
    "national_rollup": national_rollup,
    "parse_funnel": parse_funnel,
    "pending_not_accepted": pending_not_accepted,
    "catalog_upsert": catalog_upsert,
    "catalog_upsert_chains": catalog_upsert_chains,
    "sources_last_wins": sources_last_wins,
    "sources_last_wins_whole": sources_last_wins_whole,
    "ordered_distinct_units": ordered_urls,
    "pages_until_repeat": pages_until_repeat,
}
SQL = {
    "place_ranking": FLAGSHIP_SQL,
    "reject_reasons": REJECT_SQL,
    "reject_reasons_early_dedup": EARLY_SQL,
    "dedup_first": DEDUP_FIRST_SQL,
    "dedup_last": DEDUP_LAST_SQL,
    "mode_first_seen": MODE_SQL,
    "newest_urls": NEWEST_SQL,
    "complete_month": COMPLETE_SQL,
    "month_counts": MONTH_SQL,
    "last_months": LAST_MONTHS_SQL,
    "region_coverage": REGION_SQL,
    "national_rollup": NATIONAL_SQL,
    "parse_funnel": FUNNEL_SQL,
    "pending_not_accepted": PENDING_SQL,
    "catalog_upsert": UPSERT_SQL,
    "catalog_upsert_chains": CHAINS_SQL,
    "sources_last_wins": LAST_WINS_SQL,
    "sources_last_wins_whole": LAST_WINS_WHOLE_SQL,
    "ordered_distinct_units": ORDERED_SQL,
    "pages_until_repeat": PAGES_SQL,
}
