"""Helpers shared by the corpus operators: shared scratch tables and split prefix sums."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Words are runs of anything but the space and the control characters 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage; executors lost later cost no recomputation, because the files
    are in shared storage.
    """
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are done.

    They go when the driver's objects for them are collected, which a driver with little to
    do puts off while they fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for names that only live inside of an operator."""
    prefix = "_t_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def prefix_sums(df: DataFrame, group: list[str], slice_col: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come earlier.

    The order is (slice_col, *order). A group is cut into slices, so that a group which
    holds a third of all rows is summed by many tasks: totals of the slices are summed
    first (a table of groups x slices), then each slice sums its own rows. Null keys form
    a group of their own. Other columns pass through.
    """
    # one struct as key: null fields are equal in it, so that the join and the window after
    # it need the same partitioning and the rows are exchanged once
    key, start, total, other = (free_name(df, x) for x in ("_key", "_start", "_total", "_sums_key"))
    rows = df.withColumn(key, F.struct(*group, slice_col))
    sums = rows.groupBy(key).agg(F.sum(value).alias(total))
    before = Window.partitionBy(*[f"{key}.{g}" for g in group]).orderBy(f"{key}.{slice_col}").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias(other), F.coalesce(F.sum(total).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(sums, F.col(key) == F.col(other))
        .withColumn(out, F.col(start) + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop(start, key, other)
    )
