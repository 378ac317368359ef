"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, prefix_sums

#: Rows that a logical partition, and a slice of a shard, has on average; the bounds of the
#: partitions' number (powers of two), and the least number of slices of a shard.
PART_ROWS, LEAST_PARTS, MOST_PARTS, LEAST_SLICES = 20_000, 1_024, 16_384, 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from good + bad, by inversion around the mode.

    numpy's own sampler stops at 10^9 rows; this one has no such limit. Its work grows
    with the standard deviation.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    n = good + bad
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    sd = (draws * (good / n) * (bad / n) * max(n - draws, 1) / max(n - 1, 1)) ** 0.5
    reach = int(12 * sd) + 20
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, b - a))


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts[p, s] with the row sums ``parts`` and the column sums ``shards``, as a uniform shuffle has them."""
    if sum(parts) != sum(shards):
        raise ValueError("partitions and shards hold different numbers of rows")
    rng, left = np.random.default_rng(seed), list(shards)
    out = np.zeros((len(parts), len(shards)), dtype=np.int64)
    for p, rows in enumerate(parts):
        rest = sum(left)
        for s in range(len(shards)):
            rest -= left[s]
            out[p, s] = hypergeometric(rng, left[s], rest, rows)
            rows -= int(out[p, s])
        left = [a - int(b) for a, b in zip(left, out[p], strict=True)]
    return out


def hash_of(seed: int, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shuffle_into_shards(df: DataFrame, id_col: str = "doc_id", shards: int = 40, seed: int = 11) -> DataFrame:
    """All rows and columns of ``df`` plus shard (from 0) and slot (gapless from 0 in each shard).

    Rows belong to logical partitions by a hash of all their columns. The driver reads a count
    for each partition and draws how many rows each sends to each shard, with exact sums
    both ways: shard sizes differ by one at most. Each partition permutes its rows (order
    of a second hash) and cuts them by these counts; the rows are exchanged, and each
    shard permutes again (order of a third hash). A shard is permuted by slices, so that
    more tasks than shards share the work; partitions and slices grow in number with the
    table. Whole rows are exchanged twice: once to the logical partitions, which are by content
    and not by file so that the result doesn't depend on how files are split, and once to
    their shards.

    A shard depends on the rows and the seed alone, not on how files are split, so that
    reruns and retried tasks agree. Rows with equal ids, null ones included, are rows of
    their own, spread by their other columns; only rows that are equal in every column share
    a partition and a slice.
    Existing columns named shard or slot are replaced. An empty table gives no rows.
    """
    df = df.select(*[c for c in df.columns if c.lower() not in ("shard", "slot")])
    part, rank, one, piece, tie, which, until = (free_name(df, x) for x in ("_part", "_rank", "_one", "_piece", "_tie", "_p", "_ends"))
    others = [c for c, kind in df.dtypes if c != id_col and not kind.startswith("map")]
    tied = F.xxhash64(F.lit(seed + 1), *others)
    numbered = lambda k: F.pmod(hash_of(seed, id_col, tied), F.lit(k)).cast("int")
    counts = dict(df.groupBy(numbered(MOST_PARTS).alias(part)).count().collect())  # MOST_PARTS rows at most
    rows = sum(counts.values())
    n = MOST_PARTS
    while n > LEAST_PARTS and rows < n * PART_ROWS:
        n //= 2
    sizes = [sum(counts.get(p, 0) for p in range(first, MOST_PARTS, n)) for first in range(n)]
    slices = max(LEAST_SLICES, rows // (shards * PART_ROWS))
    keyed = df.withColumn(part, numbered(n))
    matrix = communication_matrix(sizes, [rows // shards + (s < rows % shards) for s in range(shards)], seed)
    ends = df.sparkSession.createDataFrame(
        [(p, [int(x) for x in matrix[p].cumsum()]) for p in range(n)],
        T.StructType([T.StructField(which, T.IntegerType()), T.StructField(until, T.ArrayType(T.LongType()))]),
    )
    local = Window.partitionBy(part).orderBy(hash_of(seed + 2, id_col), id_col, tied)
    sent = (
        keyed.withColumn(rank, F.row_number().over(local) - 1)
        .join(F.broadcast(ends), F.col(part) == F.col(which))  # MOST_PARTS x shards numbers at most
        .withColumn("shard", F.size(F.filter(until, lambda e: e <= F.col(rank))))
        .drop(which, until, part, rank)
        .withColumn(piece, F.pmod(hash_of(seed + 3, id_col, F.xxhash64(F.lit(seed + 6), *others)), F.lit(slices)).cast("int"))
        .withColumn(one, F.lit(1).cast("long"))
        .withColumn(tie, hash_of(seed + 4, id_col))
    )
    placed = prefix_sums(sent, ["shard"], piece, [tie, id_col, F.xxhash64(F.lit(seed + 5), *others)], one, "slot")
    return placed.drop(piece, one, tie)
