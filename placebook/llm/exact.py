"""Exact dedup by content sort: sampled splitters, external sort, comparison of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Bytes at a text's beginning and end that splitters are made of, besides its length: short, so that the sample on the driver is.
LEAD, TAIL = 32, 16
#: A sort key with more rows or bytes than these is hot: its rows are sorted in so many more parts.
PART_ROWS, PART_BYTES = 1_000, 32_000_000


def sort_key(body: Column) -> list[Column]:
    """The first bytes, the length and the last bytes of a text; equal texts have equal keys."""
    return [F.substring(body, 1, LEAD).alias("lead"), F.octet_length(body).cast("long").alias("len"), F.expr(f"substring(body, -{TAIL}, {TAIL})").alias("tail")]


def content_sort_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    1. Texts as bytes are range-partitioned by splitters that Spark samples from their sort
       keys (first bytes, length, last bytes): all of them bytes of the text, no hash.
    2. In a partition the external sort orders keys, whole texts and ids; a text that is
       not equal to its neighbour before it, byte by byte, begins a group.
    3. Keys with more than ``part_rows`` rows or ``part_bytes`` bytes are counted
       beforehand and only they are cut into parts by a hash of the id, so that a group
       which holds a third of all rows is many tasks. The first row of each group in each
       part carries its whole text, and these texts are compared again in full.

    The SHA-256 is a result column and decides nothing. keep: "min" or "max", the id that
    stays. Null texts count as empty. Rows with equal ids and equal texts are all rows of
    the group; each of those with the kept id is kept. Null ids are never kept unless all
    ids of the group are null. Ids may be of any type that has an order. Other columns
    are ignored. An empty table gives an empty result.
    """
    best = {"min": F.min, "max": F.max}[keep]
    body = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    keyed = body.select("id", "body", *sort_key(F.col("body")))
    key = ["lead", "len", "tail"]
    parts = F.ceil(F.greatest(F.col("m") / part_rows, F.col("m") * F.col("len") / part_bytes)).cast("int")
    # a row for each hot key, so its size is at most that of the table over part_bytes; it is broadcast
    # only if its files are small enough for the engine's own limit, and joined by a sort otherwise
    hot = stored(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).select(*[F.col(k).alias(f"hot_{k}") for k in key], parts.alias("parts")).filter("parts > 1"), "hot")
    salted = (
        keyed.join(hot, [F.col(k) == F.col(f"hot_{k}") for k in key], "left")
        .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0)))
        .select("id", "body", *key, "salt", F.col("parts").isNotNull().alias("hot"))
    )
    key = [*key, "salt"]
    sorted_texts = Window.partitionBy(*key).orderBy("body", "id")
    runs = (
        salted.repartitionByRange(*key)
        .withColumn("new", ~F.col("body").eqNullSafe(F.lag("body").over(sorted_texts)))
        .withColumn("run", F.count_if("new").over(sorted_texts.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .select("id", *key, "run", "new", "hot", F.when(F.col("hot") & F.col("new"), F.col("body")).alias("body"), F.sha2("body", 256).alias("text_sha256"))
    )
    group = Window.partitionBy(*key, "run")
    runs = stored(runs.withColumns({"best": best("id").over(group), "n": F.count(F.lit(1)).over(group)}), "runs")
    discard(hot)
    done = runs.filter("not hot").select("id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
    # a row for each group of each part of a hot key; grouping by the whole text compares it in full
    heads = runs.filter("hot and new").select(*key, "run", "body", "best", "n")
    whole = heads.groupBy("body").agg(best("best").alias("keep_id"), F.sum("n").alias("group_size")).withColumnRenamed("body", "text")
    whole = heads.select(*key, "run", "body").join(whole, F.col("body") == F.col("text")).select(*[F.col(k).alias(f"of_{k}") for k in (*key, "run")], "keep_id", "group_size")
    whole = stored(whole, "whole")
    split = runs.filter("hot").join(whole, [F.col(k) == F.col(f"of_{k}") for k in (*key, "run")]).select("id", "keep_id", "group_size", "text_sha256")
    return done.unionByName(split).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
