"""Tables written for others: projections that leave personal data out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import meal_purpose, not_restaurant
from ..functions.fixed import SEOUL_DISTRICTS
from ..functions.address import AND_OTHERS, first_contained, with_location
from ..functions.scalars import strict_date
from ..functions.text import redact
from ..operators.merge import last_wins
from .tables import KEPT_COLUMNS


def reduced_ledger(df: DataFrame) -> DataFrame:
    """The kept columns; places as 'name (address)' or blank, purposes as a flag."""
    placed = with_location(df, "집행장소")
    place = F.coalesce(F.concat("loc_name", F.lit(" ("), "loc_address", F.lit(")")), F.lit(""))
    flag = F.when(meal_purpose("집행목적"), "식사").otherwise("")
    return placed.withColumns({"집행장소": place, "집행목적": flag}).select(*KEPT_COLUMNS)


def unresolved_ledger(df: DataFrame, ordinal: Column) -> DataFrame:
    """Meals whose address can't be read: the name, the district alone, no purpose and no person."""
    placed = with_location(df, "집행장소").filter(F.col("loc_key").isNull() & meal_purpose("집행목적"))
    name = F.regexp_replace(F.trim(F.split("집행장소", "[(（]")[0]), AND_OTHERS, "")
    told = placed.withColumns({"name": name, "day": strict_date("집행일시")})
    told = told.filter(F.length("name").between(2, 70) & ~not_restaurant("name") & F.col("day").isNotNull())
    return told.select(
        F.lit("서울").alias("region"),
        F.lit("서울특별시").alias("institution"),
        F.col("전체부서명").alias("department"),
        "name",
        F.concat(F.lit("서울특별시 "), F.coalesce(first_contained("집행장소", SEOUL_DISTRICTS), F.lit(""))).alias("addressHint"),
        F.col("day").cast("string").alias("paymentDate"),
        F.col("문서url").alias("sourceURL"),
        F.concat_ws(":", "문서고유id", ordinal.cast("string")).alias("recordID"),
        F.lit(True).alias("isMeal"),
    )


def unresolved_pending(pending: DataFrame, accepted: DataFrame) -> DataFrame:
    """Pending meals that were not accepted."""
    return pending.join(accepted.select("recordID").distinct(), "recordID", "left_anti").filter("isMeal")


def redacted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: redact(c) for c in columns})


def used_evidence(registry: DataFrame, used: DataFrame, addresses: list[str], by: str = "address") -> DataFrame:
    """Registry rows one of whose addresses was used: a semi join over exploded addresses instead of an OR."""
    each = registry.select("id", F.explode(F.array(*addresses)).alias("_a")).join(used.select(F.col(by).alias("_a")).distinct(), "_a", "left_semi")
    return registry.join(each.select("id").distinct(), "id", "left_semi")


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("compression", "gzip").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("compression", "gzip").csv(path, header=True)


def without_provider(df: DataFrame, provider: str, columns: list[str]) -> DataFrame:
    """Columns that a provider's terms don't allow to keep, as null."""
    return df.withColumns({c: F.when(F.col("provider") != provider, F.col(c)) for c in columns})


def exit_code(places: int, missing: int, strict: bool) -> int:
    """2 for an empty result, 3 for missing regions in strict mode."""
    return 2 if not places else 3 if strict and missing else 0


def without_keys(m: Column, keys: list[str]) -> Column:
    """A map without the given keys."""
    return F.map_filter(m, lambda k, v: ~k.isin(keys))


def upsert_ids(known: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Known ids of a provider with the new ones in their place; of several new ones for a key the last by its fields."""
    others = [c for c in new.columns if c != key]
    return last_wins(known, new.groupBy(key).agg(F.max(F.struct(*others)).alias("_new")).select(key, "_new.*"), [key])


def replace_table(df: DataFrame, path: str) -> None:
    """Write JSON lines so that readers find the old table or the new one, never a part: it gets its name when it is complete.

    ``df`` may read the old table.
    """
    spark = df.sparkSession
    made, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").json(made)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(made), at(path))
    fs.delete(at(old), True)


def department_needed(df: DataFrame, needed: bool, department: str = "department") -> DataFrame:
    """For sites that need a department: rows without one go; for all others nothing does."""
    return df.filter(F.trim(F.coalesce(department, F.lit(""))) != "") if needed else df
