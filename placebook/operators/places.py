"""Payments aggregated by place, with explicit ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import medians


def most_common(df: DataFrame, group: list[str], value: str, order: Column, out: str, weight: Column | None = None, prefer: Column | None = None) -> DataFrame:
    """(group, out): the most frequent value, of equally frequent ones the one that came first.

    ``order`` tells which row came first. ``weight``: 0 for rows that are seen but don't
    count. ``prefer``: a rank of the value that comes before its frequency.
    """
    counted = df.groupBy(*group, value).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    rank = [*([prefer.desc()] if prefer is not None else []), F.col("_n").desc(), F.col("_first").asc()]
    best = counted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*rank)))
    return best.filter("_rank = 1").select(*group, F.col(value).alias(out))


def newest_urls(df: DataFrame, group: list[str], url: str, day: str, order: Column, limit: int = 10) -> DataFrame:
    """(group, urls): the newest distinct URLs, newest first; of one day in the given order."""
    by_url = df.groupBy(*group, url).agg(F.max(F.struct(F.col(day).alias("d"), (-order).alias("o"))).alias("_at"))
    ranked = by_url.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_at").desc(), F.col(url))))
    kept = ranked.filter(F.col("_rank") <= limit).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_rank", url))).alias("_l"))
    return kept.select(*group, F.transform("_l", lambda x: x[url]).alias("urls"))


def whole_median(amount: Column) -> Column:
    """The exact median of the positive amounts without decimals, null without any."""
    return F.floor(F.median(F.when(amount > 0, amount))).cast("long")


def place_facts(df: DataFrame, group: list[str], day: str = "payment_date", department: str = "department", amount: str = "amount", url: str = "source_url", order: str = "ordinal", empty_counts: bool = False) -> DataFrame:
    """Counts, departments, dates, median and the newest document of each place, in one aggregation and one of the amounts.

    Departments are a set for each place; its size is bounded by their number, not by the
    payments'. ``empty_counts``: an empty department counts as one.
    """
    unit = F.col(department) if empty_counts else F.nullif(F.col(department), F.lit(""))
    facts = (
        df.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("record_count"),
            F.array_sort(F.collect_set(unit)).alias("departments"),
            F.min(day).alias("first_date"),
            F.max(day).alias("last_date"),
            F.max_by(url, F.struct(F.col(day), -F.col(order))).alias("newest_url"),
        )
        .withColumn("department_count", F.size("departments"))
    )
    middle = medians(df, group, amount, "_median")
    middle = middle.select(*[F.col(g).alias(f"_m{i}") for i, g in enumerate(group)], F.floor("_median").cast("long").alias("median_amount"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_m{i}")) for i, g in enumerate(group)])
    return facts.join(middle, same, "left").drop(*[f"_m{i}" for i in range(len(group))])


def ranked_places(df: DataFrame, name: str = "name") -> DataFrame:
    """By departments, by records, by name in code-point order."""
    return df.orderBy(F.col("department_count").desc(), F.col("record_count").desc(), F.col(name).asc())


def fresh(df: DataFrame, as_of: Column, months: int, last: str = "last_date") -> DataFrame:
    return df.filter(F.col(last) >= F.add_months(as_of, -months))


def complete_month(df: DataFrame, day: str = "payment_date", department: str = "department", share: float = 0.95) -> DataFrame:
    """One row: the base (median departments of the six months before the last) and the last complete month.

    A month is complete if a whole later month has gone by and its departments reach the
    share of the base; the last month if none is. With fewer than seven months the base is 0.
    """
    month = F.trunc(day, "month")
    by = df.groupBy(month.alias("m")).agg(F.countDistinct(department).alias("n"), F.max(day).alias("d"))
    # a row for each month: a window over all of them is a window over the calendar
    every = Window.partitionBy(F.lit(0))
    by = by.withColumns({"r": F.row_number().over(every.orderBy(F.col("m").desc())), "latest": F.max("d").over(every)})
    base = F.median(F.when(F.col("r").between(2, 7), F.col("n")))
    by = by.withColumn("base", F.when(F.count(F.lit(1)).over(every) >= 7, base.over(every)).otherwise(0.0))
    gone = F.last_day(F.add_months("m", 1)) <= F.col("latest")
    return by.agg(
        F.max("base").alias("base"),
        F.date_format(F.coalesce(F.max(F.when(gone & (F.col("n") >= share * F.col("base")), F.col("m"))), F.max("m")), "yyyy-MM").alias("complete_month"),
    )
