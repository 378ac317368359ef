"""Regional results merged into one catalog, with coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ranking import previous


def in_order(frames: list[DataFrame], number: str = "shard_no") -> DataFrame:
    """Tables one after another; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(number, F.lit(i)) for i, f in enumerate(frames)])


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, the new row."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merged_lists(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def upsert(base: DataFrame, more: DataFrame, key: str = "address_key", variants: str = "name_variants") -> DataFrame:
    """Base places with what ``more`` adds to them, and the places of ``more`` that the base lacks.

    A place of ``more`` belongs to the first base place (smallest ordinal) that has its
    key and one of its name variants. Counts add up, lists unite, dates widen. Places of
    ``more`` are matched against the base only, never against one another.
    """
    left = more.select(F.col("ordinal").alias("_more"), key, F.explode(variants).alias("_v"))
    right = base.select(F.col("ordinal").alias("_base"), key, F.explode(variants).alias("_v"))
    hit = left.join(right, [key, "_v"]).groupBy("_more").agg(F.min("_base").alias("_base"))
    added = more.join(hit, more["ordinal"] == hit["_more"], "left")
    sums = (
        added.filter(F.col("_base").isNotNull())
        .groupBy("_base")
        .agg(
            F.sum("record_count").alias("_n"),
            F.array_distinct(F.flatten(F.collect_list("departments"))).alias("_d"),
            F.array_distinct(F.flatten(F.collect_list(variants))).alias("_names"),
            F.min("first_date").alias("_from"),
            F.max("last_date").alias("_to"),
        )
    )
    united = base.join(sums, base["ordinal"] == sums["_base"], "left").withColumns(
        {
            "record_count": F.col("record_count") + F.coalesce("_n", F.lit(0)),
            "departments": merged_lists(F.col("departments"), F.col("_d")),
            variants: merged_lists(F.col(variants), F.col("_names")),
            "first_date": F.least("first_date", "_from"),
            "last_date": F.greatest("last_date", "_to"),
        }
    )
    kept = united.select(*base.columns).withColumn("origin", F.lit("base"))
    new = added.filter(F.col("_base").isNull()).select(*base.columns).withColumn("origin", F.lit("added"))
    return kept.unionByName(new)


def roots(pointers: DataFrame) -> DataFrame:
    """(node, root) of (node, up): where each node ends up, by doubling pointers until none moves; a root points to itself."""
    while True:
        far = pointers.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
        moved = written(pointers.join(far, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up"), (F.col("_u") != F.col("up")).alias("moved")), "roots")
        pointers = moved.select("node", "up")
        if not moved.filter("moved").limit(1).count():
            return pointers.withColumnRenamed("up", "root")


def upsert_in_order(base: DataFrame, more: DataFrame, key: str = "address_key", variants: str = "name_variants") -> DataFrame:
    """As upsert, but the places of ``more`` come one after another and are found by later ones.

    A place looks its variants up in their order; the first that any place before it had,
    with the same key, decides: it joins the place that the last of these joined or is. So
    each place points to one before it, and where the pointers end is the place that it
    becomes part of: a base place, or the first of a chain of additions.
    """
    columns = ["ordinal", key, "record_count", "departments", variants, "first_date", "last_date"]
    node = lambda side: F.struct(F.lit(side).alias("side"), F.col("ordinal").cast("long").alias("ordinal"))
    both = base.select(*columns).withColumn("node", node(0)).unionByName(more.select(*columns).withColumn("node", node(1)))
    names = both.select("node", key, F.posexplode(F.array_distinct(variants)).alias("_i", "_v"))
    held = previous(names, [key, "_v"], [F.col("node")], "node", "_before").filter(F.col("node.side") == 1)
    first = held.filter("_before is not null").groupBy(F.col("node").alias("_n")).agg(F.min_by("_before", "_i").alias("up"))
    pointers = both.select("node").join(first, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("up", "node").alias("up"))
    joined = both.join(roots(pointers).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    out = joined.groupBy("root").agg(
        F.min_by(key, "node").alias(key), F.sum("record_count").alias("record_count"), united("departments").alias("departments"), united(variants).alias(variants),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
    )
    return out.select(F.col("root.ordinal").alias("ordinal"), *columns[1:], F.when(F.col("root.side") == 0, "base").otherwise("added").alias("origin"))


def region_stats(df: DataFrame, region: str = "region", institution: str = "institution", place: str = "place_key", day: str = "payment_date") -> DataFrame:
    return df.groupBy(region).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(institution).alias("institution_count"),
        F.countDistinct(place).alias("place_count"),
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
    )


def all_regions(dim: DataFrame, stats: DataFrame, region: str = "region") -> DataFrame:
    """A row for each region of the dimension; counts of regions without rows are 0."""
    counts = [c for c in stats.columns if c.endswith("_count")]
    return dim.join(stats, region, "left").fillna(0, counts).withColumn("is_covered", F.col(counts[0]) > 0)


def national(regions: DataFrame) -> DataFrame:
    """One row over all regions."""
    covered = F.when(F.col("is_covered"), F.col("region"))
    return regions.agg(
        F.sum("row_count").alias("row_count"),
        F.sum("place_count").alias("place_count"),
        F.array_sort(F.collect_list(covered)).alias("covered_regions"),
        F.array_sort(F.collect_list(F.when(~F.col("is_covered"), F.col("region")))).alias("missing_regions"),
        F.bool_and("is_covered").alias("complete"),
    )


def ordered_distinct(df: DataFrame, group: list[str], value: str, order: Column, out: str) -> DataFrame:
    """Distinct values of each group in the order in which they first came."""
    first = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.min(order).alias("_at"))
    return first.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(out))


def coverage_text(region: Column, places: Column, rows: Column, first: Column, last: Column) -> Column:
    return F.when(rows > 0, F.format_string("%s: %d places, %d payments, %s to %s", region, places, rows, first, last)).otherwise(F.concat(region, F.lit(": no records")))


def summarised(doc: Column, most: int) -> Column:
    """A JSON document as it is, or its top keys if it is longer than ``most`` characters."""
    return F.when(F.length(doc) <= most, doc).otherwise(F.to_json(F.struct(F.json_object_keys(doc).alias("keys"), F.length(doc).alias("length"))))


def catalog_document(places: DataFrame, generated_at: str, coverage: str, urls: list[str]) -> DataFrame:
    """One row: the catalog as JSON. The list of places is what the document is; callers write large ones as tables."""
    fields = [c for c in places.columns if c != "rank"]
    body = places.agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("restaurants"))
    doc = F.struct(
        F.lit(1).alias("schemaVersion"), F.lit(generated_at).alias("generatedAt"), F.lit(coverage).alias("coverageDescription"),
        F.array(*map(F.lit, urls)).alias("sourceURLs"), F.transform("restaurants", lambda x: x.dropFields("rank")).alias("restaurants"),
    )
    return body.select(F.to_json(doc).alias("document"))


def report_markdown(regions: list[dict]) -> str:
    """The coverage table as Markdown; a row for each region."""
    head = ["| Region | Places | Payments | From | To |", "|---|---:|---:|---|---|"]
    return "\n".join(head + [f"| {r['region']} | {r['place_count']} | {r['row_count']} | {r['first_date'] or '-'} | {r['last_date'] or '-'} |" for r in regions])
