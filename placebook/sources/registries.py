"""Business registries of three kinds as tables with name, branch and address keys, and caches of what was matched before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.address import integrated_region, with_placed
from ..functions.text import business_name, contains_any, norm_text

#: The columns of a registry file and what they are called here.
REGISTRY_COLUMNS = {
    "상가업소번호": "business_id", "상호명": "name", "지점명": "branch", "상권업종중분류명": "middle_category", "상권업종소분류명": "sub_category",
    "시도명": "province", "시군구명": "sigungu", "지번주소": "lot_address", "도로명주소": "road_address",
}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file or a folder of them, all text, trimmed; columns that a file lacks are null, others are left out."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    return df.select(*[(F.trim(c) if c in df.columns else F.lit(None).cast("string")).alias(name) for c, name in REGISTRY_COLUMNS.items()])


def _entries(rows: DataFrame) -> DataFrame:
    """Rows with an id, a name and an address, the road's before the lot's."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = rows.withColumns({c: text(c) for c in ("business_id", "name", "branch", "sigungu")}).withColumn("address", F.coalesce(F.nullif(text("road_address"), F.lit("")), text("lot_address")))
    return rows.filter((F.col("name") != "") & (F.col("address") != ""))


def central_registry(rows: DataFrame, hint: Column) -> DataFrame:
    """First kind: addresses placed in a province, with the keys name_key, full_key (name and branch) and pair_key; '' where there is none."""
    told = with_placed(_entries(rows).filter("business_id <> ''"), "address", hint, validated=True)
    # exploding drops the rows that aren't placed and, unlike a filter, computes the place once
    placed = F.when(F.col("placed_region").isNotNull(), F.array(F.struct("placed_region", "placed_address")))
    told = told.withColumn("_placed", F.explode(placed)).withColumns({"region": F.col("_placed.placed_region"), "address": F.col("_placed.placed_address")})
    told = told.drop("_placed", "placed_region", "placed_address")
    name, branch = business_name("name"), F.when(F.col("branch") != "", business_name("branch"))
    full = F.when(F.col("branch") != "", business_name(F.concat("name", "branch")))
    pair = F.when((name != "") & (branch != ""), F.concat_ws("\u001f", name, branch))
    return told.withColumns({"name_key": name, "full_key": F.coalesce(full, F.lit("")), "pair_key": F.coalesce(pair, F.lit(""))})


def central_query_keys(df: DataFrame, name: str = "name") -> DataFrame:
    """The keys that a name is looked up by in the first kind, in this order: q_full, q_pair (a branch at its end), q_name."""
    base, branch = business_name(F.regexp_extract(name, fixed.BRANCH, 1)), business_name(F.regexp_extract(name, fixed.BRANCH, 2))
    whole = business_name(name)
    return df.withColumns({"q_full": whole, "q_pair": F.when((base != "") & (branch != ""), F.concat_ws("\u001f", base, branch)).otherwise(""), "q_name": whole})


#: Priority of the first kind's keys, as operators.resolve.cascade takes them.
CENTRAL_LEVELS = [("q_full", "full_key"), ("q_pair", "pair_key"), ("q_name", "name_key")]


def spelled_keys(name: Column | str, branch: Column | str) -> Column:
    """Second kind: a name and its branch with and without a space, and without the branch's last 점; a name alone with and without its spaces."""
    n, b = (F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) for c in (name, branch))
    short = F.when(b.endswith("점") & (F.length(b) > 1), F.regexp_replace(b, "점$", ""))
    with_branch = F.array_compact(F.array(F.concat(n, F.lit(" "), b), F.concat(n, b), F.concat(n, F.lit(" "), short), F.concat(n, short)))
    return F.array_distinct(F.filter(F.when(b != "", with_branch).otherwise(F.array(n, F.replace(n, F.lit(" "), F.lit("")))), lambda k: k != ""))


def checked_registry(rows: DataFrame, region: Column) -> DataFrame:
    """Second kind: restaurants alone, with all spellings of their names as ``keys``; for operators.resolve.without_conflicts."""
    out = contains_any("middle_category", fixed.CATEGORIES_OUT) | contains_any("sub_category", fixed.CATEGORIES_OUT)
    return _entries(rows).filter(~out).withColumns({"region": region, "keys": spelled_keys("name", "branch")})


def integrated_registry(rows: DataFrame, target: Column) -> DataFrame:
    """Third kind: rows of the integrated city go to the region of their district; name_key and full_key without marks of any kind."""
    entries = _entries(rows).filter("business_id <> ''")
    region = F.when(target.isin(fixed.INTEGRATED), F.coalesce(integrated_region(F.col("sigungu"), others=True), F.lit("전남"))).otherwise(target)
    full = F.when(F.col("branch") != "", norm_text(F.concat("name", "branch"))).otherwise("")
    return entries.withColumns({"region": region, "name_key": norm_text("name"), "full_key": full})


MATCHED = ["addressSourceID", "region", "name", "address", "addressMatch"]


def matched_addresses(records: DataFrame, order: str = "ordinal") -> DataFrame:
    """What was matched, for reuse: the first record of each source id, region, name and address, by region, name and address."""
    key = MATCHED[:4]
    rows = records.filter(F.coalesce("address", F.lit("")) != "").withColumns({c: F.coalesce(c, F.lit("")) for c in key})
    first = rows.groupBy(*key).agg(F.min_by(F.coalesce(F.nullif("addressMatch", F.lit("")), F.lit("verified")), order).alias("addressMatch"))
    return first.select(*MATCHED).orderBy("region", "name", "address")


def matched_registry(matched: DataFrame) -> DataFrame:
    """Matched addresses as a registry of the first kind without branches: each address of a name once."""
    rows = matched.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in MATCHED[:4]}).filter("region <> '' and name <> '' and address <> ''")
    rows = rows.withColumn("name_key", business_name("name")).filter("name_key <> ''")
    one = rows.groupBy("region", "name_key", "address").agg(F.min(F.struct("name", "addressSourceID")).alias("_one"))
    return one.select(F.col("_one.addressSourceID").alias("business_id"), F.col("_one.name").alias("name"), F.lit("").alias("branch"), "region", "address", "name_key", F.lit("").alias("full_key"), F.lit("").alias("pair_key"))


def evidence_registry(lines: DataFrame, column: str = "raw", source: str = "") -> DataFrame:
    """JSON lines of evidence, with either set of names, as a registry of the second kind; a region that is not told is that of the address."""
    told = lambda *names: F.trim(F.coalesce(*[F.nullif(F.get_json_object(column, f"$['{n}']"), F.lit("")) for n in names], F.lit("")))
    rows = lines.select(
        told("businessID", "상가업소번호").alias("business_id"), told("name", "상호명").alias("name"), told("branch", "지점명").alias("branch"),
        told("address", "도로명주소", "지번주소").alias("address"), told("region").alias("region"), F.coalesce(F.nullif(told("sourceURL"), F.lit("")), F.lit(source)).alias("source_url"),
    )
    named = F.coalesce(*[F.when(contains_any("address", [fixed.REGION_SPELLINGS[r][0], r]), r) for r in fixed.REGIONS], F.lit(""))
    rows = rows.withColumn("region", F.when(F.col("region") != "", F.col("region")).otherwise(named))
    return rows.filter("region <> '' and name <> '' and address <> ''").withColumn("keys", spelled_keys("name", "branch"))
