"""Positions in a total order, running totals and medians, by sampled ranges: no row count goes through one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of one range stand below this number; above it is the number of the range.
RANGE_BITS = 33
#: Rows of a range where their number is known beforehand.
RANGE_ROWS = 1_000_000


def _ranged(df: DataFrame, order: list[Column], parts: int = 0) -> DataFrame:
    """Rows in ranges of the order, written, with the range and the place in it from 0.

    Spark samples the bounds; the rows are written once, so that every later reading sees
    the same ranges. Rows that are equal in the order share a range: end it with a key.
    """
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, "ranges")
    return rows.withColumns({"_range": F.shiftright("_id", RANGE_BITS), "_at": F.col("_id").bitwiseAND((1 << RANGE_BITS) - 1)}).drop("_id")


def _starts(rows: DataFrame, amount: Column) -> DataFrame:
    """(_of, _start): what the ranges before each one sum up to; a row a range."""
    totals = rows.groupBy(F.col("_range").alias("_of")).agg(F.sum(amount).alias("_n"))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def numbered(df: DataFrame, order: list[Column], out: str, parts: int = 0) -> DataFrame:
    """All rows with their position in the order, from 1, as column ``out``; in so many ranges at least."""
    rows = _ranged(df, order, parts)
    starts = F.broadcast(_starts(rows, F.lit(1)))  # as many rows as there are partitions
    return rows.join(starts, F.col("_range") == F.col("_of")).withColumn(out, F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_of", "_start")


def numbered_within(df: DataFrame, group: list[str], order: list[Column], out: str, parts: int = 0, few: bool = False) -> DataFrame:
    """All rows with their position within their group, from 1; a group of any size is many tasks. Null keys are a group.

    ``parts``: the least number of ranges. ``few``: groups are few, and their starts are broadcast.
    """
    rows = numbered(df, [*[F.col(g).asc_nulls_first() for g in group], *order], out, parts)
    first = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.min(out).alias("_first"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    return rows.join(F.broadcast(first) if few else first, same).withColumn(out, F.col(out) - F.col("_first") + 1).drop("_first", *[f"_g{i}" for i in range(len(group))])


def shuffled(df: DataFrame, key: list[str], seed: int, out: str = "place") -> DataFrame:
    """All rows with their position in a random order that the seed and the key decide."""
    return numbered(df, [F.xxhash64(F.lit(seed), *key), *[F.col(k) for k in key]], out)


def picked(df: DataFrame, group: list[str], key: list[str], seed: int) -> DataFrame:
    """A random row of each group, the same again for the same seed."""
    fields = [c for c in df.columns if c not in group]
    one = df.groupBy(*group).agg(F.min_by(F.struct(*fields), F.struct(F.xxhash64(F.lit(seed), *key), *key)).alias("_p"))
    return one.select(*group, "_p.*")


def medians(df: DataFrame, group: list[str], amount: str, out: str) -> DataFrame:
    """(group, out): the exact median of the positive amounts of each group, null without any.

    Amounts are counted first, so that a group has a row for each different one. The middle
    is found by the running count over ranges of (group, amount): a place with a third of all
    payments is as many tasks as its amounts fill ranges.
    """
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    counts = df.filter(F.col(amount) > 0).groupBy(*keys, F.col(amount).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    names = [f"_g{i}" for i in range(len(group))]
    rows = _ranged(counts, [*[F.col(g).asc_nulls_first() for g in names], F.col("_v")])
    starts = F.broadcast(_starts(rows, F.col("_c")))  # as many rows as there are partitions
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(starts, F.col("_range") == F.col("_of")).withColumn("_to", F.col("_start") + F.sum("_c").over(within)).withColumn("_from", F.col("_to") - F.col("_c"))
    whole = run.groupBy(*[F.col(g).alias(f"_w{g}") for g in names]).agg(F.min("_from").alias("_first"), F.sum("_c").alias("_n"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_w{g}")) for g in names])
    at = run.join(whole, same)
    holds = lambda k: ((F.col("_from") - F.col("_first") <= k) & (k < F.col("_to") - F.col("_first"))).cast("int")
    twice = holds(F.floor((F.col("_n") - 1) / 2)) + holds(F.floor(F.col("_n") / 2))
    middle = at.filter(twice > 0).groupBy(*names).agg((F.sum(F.col("_v") * twice) / 2).alias(out))
    return middle.select(*[F.col(n).alias(g) for n, g in zip(names, group, strict=True)], out)


def previous(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """All rows with the ``value`` of the row before them in their group, null for the first.

    A range takes the row before its first one from the range before, so that a group of any
    size is many tasks.
    """
    rows = _ranged(df, [*[F.col(g).asc_nulls_first() for g in group], *order])
    item = F.struct(*group, F.col(value).alias("_value"))
    lasts = rows.groupBy(F.col("_range").alias("_of")).agg(F.max_by(item, "_at").alias("_last"))
    carried = F.broadcast(lasts.select("_of", F.lag("_last").over(Window.orderBy("_of")).alias("_carry")))  # as many rows as there are partitions
    before = F.when(F.col("_at") == 0, F.col("_carry")).otherwise(F.lag(item).over(Window.partitionBy("_range").orderBy("_at")))
    rows = rows.join(carried, F.col("_range") == F.col("_of")).withColumn("_was", before)
    same = reduce(Column.__and__, [F.col("_was")[g].eqNullSafe(F.col(g)) for g in group])
    return rows.withColumn(out, F.when(F.col("_was").isNotNull() & same, F.col("_was")["_value"])).drop("_range", "_at", "_of", "_carry", "_was")
