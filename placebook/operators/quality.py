"""One reject reason for each row, dedup by stage, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_keys(raw_json: Column, required: list[str]) -> Column:
    """Keys that a JSON object lacks; null for what is no object. A key with the value null is there."""
    return F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(raw_json))


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that fails (is not true), null if none does."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules])


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], out: str = "reject_reason") -> DataFrame:
    return df.withColumn(out, first_failing(rules))


def keep_one(df: DataFrame, keys: list[str], order: list[Column], out: str | None = None) -> DataFrame:
    """The first row of each key in the given order; with ``out`` all rows, marked. Null keys are one key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if out:
        return df.withColumn(out, place == 1)
    # a bound on the rank itself lets the engine cut each key's rows before they are exchanged
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def validated(df: DataFrame, rules: list[tuple[str, Column]], keys: list[str], order: list[Column], before: int | None = None) -> DataFrame:
    """All rows with reject_reason, duplicates among them.

    before=None: rows are compared after all rules, so that a bad copy never claims the
    key. before=n: they are compared after the first n rules; the first of those claims
    the key even if a later rule rejects it.
    """
    n = len(rules) if before is None else before
    staged = df.withColumn("_early", first_failing(rules[:n]) if n else F.lit(None).cast("string"))
    claims = Window.partitionBy(*keys, F.col("_early").isNull()).orderBy(*order)
    staged = staged.withColumn("_copy", F.col("_early").isNull() & (F.row_number().over(claims) > 1))
    late = first_failing(rules[n:]) if rules[n:] else F.lit(None).cast("string")
    return staged.withColumn("reject_reason", F.coalesce("_early", F.when(F.col("_copy"), F.lit("duplicate")), late)).drop("_early", "_copy")


def histogram(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n_rows"))


def as_map(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """One row: the table as a map, by key."""
    return df.filter(F.col(key).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(out))


def funnel(df: DataFrame, group: list[str], stages: dict[str, Column]) -> DataFrame:
    """How many rows of each group reach each stage; a stage counts only rows that reached those before."""
    reached, out = F.lit(True), []
    for name, passes in stages.items():
        reached = reached & F.coalesce(passes, F.lit(False))
        out.append(F.count_if(reached).alias(name))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), *out)


def pages_until_repeat(df: DataFrame, page: str, key: str) -> DataFrame:
    """First occurrences of keys on the pages before the first one without a new key."""
    first = df.withColumn("_new", F.row_number().over(Window.partitionBy(key).orderBy(page)) == 1)
    stop = first.groupBy(page).agg(F.count_if("_new").alias("n")).filter("n = 0").agg(F.min(page).alias("_stop"))
    # one row: the stop page
    return first.filter("_new").crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_new", "_stop")
