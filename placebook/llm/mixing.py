"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, free_name, prefix_sums, stored

#: Slopes of the sources' weights over training, 1 + r * (2t - 1); a parameter. Sources take them in turn.
RAMPS = (-0.5, 0.0, 0.5)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int = MOST_REPEATS) -> DataFrame:
    """Targets of the sources, from (source, source_size): adds rank, weight, target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the words of all.
    A target stops at ``repeats`` times its source's size; the excess is shared anew by
    weight until none is above. That ends with one level: sources with the smallest
    size/weight are the full ones, so that one sorted pass finds them. A row for each
    source is all that is held here.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.col("rank") % 3 + 1)
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("spent", F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("words", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("words") - F.col("spent")).cast("double") / F.col("weights_left"))
        .withColumn("full", F.col("level") * F.col("weight") > F.col("source_size") * repeats)
        # the level of the first source that is not full; all before it are full
        .withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(whole)["level"])
    )
    return filled.select(
        "source",
        "rank",
        "source_size",
        F.least(F.coalesce(F.col("final") * F.col("weight"), F.lit(float("inf"))), (F.col("source_size") * repeats).cast("double")).alias("target"),
    )


def measured(df: DataFrame, key: Column, id_col: str, text_col: str, source_col: str, seed: str, size: Callable[[Column], Column]) -> DataFrame:
    """(key, source, size, hash, slice, words): a row for each distinct document, written; ``words`` counts all its rows."""
    found = df.select(
        key.alias("key"), F.col(source_col).alias("source"), size(F.col(text_col)).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("hash")
    )
    return stored(found.groupBy("key", "source", "size", "hash").agg(F.sum("size").alias("words")).withColumn("slice", F.substring("hash", 1, 3)), "sizes")


def plan(rows: DataFrame, repeats: int = MOST_REPEATS, ramps: tuple[float, ...] = RAMPS) -> DataFrame:
    """(key, size, source_size, target, times, positions) of the rows of ``measured``, written."""
    goal = targets(rows.groupBy("source").agg(F.sum("words").alias("source_size")), repeats).withColumnRenamed("source", "of")
    goal = goal.withColumn("want", F.floor("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0)))
    goal = stored(goal.withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size")), "goal")
    streams = prefix_sums(rows, ["source"], "slice", ["hash", "size", "key"], "words", "before")
    placed = streams.join(goal, F.col("source").eqNullSafe(F.col("of"))).withColumn("last", 2 * F.col("before") + F.col("words") <= 2 * F.col("rest"))
    held = placed = stored(placed, "placed")
    # what the last pass lacks or has too much, and the one document that mends it best
    miss = placed.groupBy(F.col("source").alias("of")).agg((F.first("rest") - F.sum(F.when(F.col("last"), F.col("words")).otherwise(F.lit(0)))).alias("miss"))
    miss = stored(miss, "miss")
    after = F.abs(F.col("miss") - F.when(F.col("last"), -F.col("words")).otherwise(F.col("words")))
    turned = placed.drop("of").join(miss, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("words") > 0) & (after < F.abs("miss")))
    turned = stored(turned.groupBy("source").agg(F.min(F.struct(after.alias("after"), "hash", "size", "key")).alias("one")).select(F.col("one.key").alias("turned")), "turned")
    words, whole, times = F.col("words"), F.col("source_size"), F.col("times")
    placed = placed.join(turned, F.col("key") == F.col("turned"), "left").withColumn("last", F.col("last") != F.col("turned").isNotNull())
    placed = placed.withColumn("times", F.when(words > 0, F.col("passes") + F.col("last").cast("long")).otherwise(F.lit(0)))
    ramp = F.element_at(F.array(*[F.lit(float(r)) for r in ramps]), (F.col("rank") % len(ramps) + 1).cast("int"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), times - 1), lambda e: inverse_schedule((e * whole + F.col("before") + words / 2) / F.greatest("want", F.lit(1)), ramp))
    placed = placed.withColumn("positions", F.when(times > 0, each).otherwise(F.array().cast("array<double>")))
    out = stored(placed.select("key", "size", "source_size", "target", "times", "positions"), "plan")
    discard(rows, goal, held, miss, turned)
    return out


def curriculum_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
    repeats: int = MOST_REPEATS,
    ramps: tuple[float, ...] = RAMPS,
    size: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """All rows and columns of ``df`` plus size, source_size, target, taken and positions.

    A source's documents form a stream in the order of a hash of their ids; the source's
    target tells how many whole passes over the stream the mix takes and where the last
    pass ends (at the document whose middle is nearest before it). One more document is
    then put into or left out of the last pass, the one that brings the source's words
    nearest to its target, if any does. A document's offset in the stream, as a share of
    the source's demand, is carried through the inverse of the source's integrated weight
    schedule: that is its training position in 0..1, one for each time that it is taken.
    Sort by position to train. ``ramps`` has the slopes of the schedules: source n of the
    sorted ones has weight 1 + r * (2t - 1) at time t with r = ramps[n % len(ramps)], -1 < r < 1.

    Texts are read twice, to be counted and to be returned, and are exchanged once; all
    between is narrow. Hot sources: prefix sums run by slices of 1/4096 of the hash range,
    so that a source with a third of all rows is not one task. Nothing is collected; the
    table of targets has a row for each source. Reruns agree, as the order depends on ids,
    sizes and texts alone. Rows with equal ids, sources and texts are taken equally often
    and at the same positions; other rows with equal ids are documents of their own. Null
    texts have size 0 and are taken 0 words; null is a source of its own; null ids are ids.
    Ids may be of any type that has an order. An empty table gives no rows. Names that
    ``df`` already has among the new ones are replaced.
    """
    made = ("size", "source_size", "target", "taken", "positions")
    df = df.select(*[c for c in df.columns if c.lower() not in made or c in (id_col, text_col, source_col)])
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text"))
    found = plan(measured(df, key, id_col, text_col, source_col, seed, size), repeats, ramps)
    found = found.withColumn("taken", F.col("size") * F.col("times"))
    mine, own = (free_name(df, x) for x in ("_mix_key", "_mix_plan"))
    # the key is a column before the join, so that a text that nobody asks for isn't exchanged
    return df.withColumn(mine, key).join(found.select(F.col("key").alias(own), *made), F.col(mine) == F.col(own)).select(*df.columns, *made)


def inverse_schedule(share: Column, ramp: Column) -> Column:
    """t with t + ramp * (t^2 - t) = share: the integral of 1 + ramp * (2t - 1), inverted."""
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    b = 1 - ramp
    return F.when(ramp == 0, share).otherwise((F.sqrt(b * b + 4 * ramp * share) - b) / (2 * ramp))


def in_training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each time that a document is taken, range-sorted by its training position, then id and copy.

    The columns ``position`` and ``copy`` (from 0) are added last; existing ones are replaced.
    Documents that are not taken have no row.
    """
    kept = [c for c in mixed.columns if c.lower() not in ("position", "copy")]
    return mixed.select(*kept, F.posexplode("positions").alias("copy", "position")).select(*kept, "position", "copy").orderBy("position", id_col, "copy")
