"""Ledgers, JSON lines, registries, holidays and manifests as typed tables."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

# The columns that are kept of a ledger.
KEPT_COLUMNS = ["문서고유id", "전체부서명", "해당년도", "해당월", "집행일시", "집행장소", "집행목적", "집행금액", "문서url"]
#: Payment records of the shards.
PAYMENT = "region string, institution string, department string, name string, canonicalName string, address string, paymentDate string, sourceURL string, recordID string, isMeal boolean, meal boolean, amount string"
REQUIRED = ["region", "institution", "name", "address", "paymentDate", "sourceURL", "recordID"]


def read_ledger(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A ledger with a header, all text; MS949 needs spark.sql.legacy.javaCharsets. A stray quote in front of the header goes."""
    df = spark.read.csv(path, header=True, encoding=encoding, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip('"﻿').rstrip('"') for c in df.columns])


def checked_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    return df.select(*needed)


def read_lines(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """(source, line, value): all lines of text files with their number in the file, from 1.

    ``through``: numbers go on from file to file in the order of their names, as in one file.

    A file that can be split is as many tasks as it has blocks: lines are counted by block,
    and a block's first line follows the lines of the blocks before it. Packed files have one block.
    """
    meta = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select(*meta, F.col("_metadata.file_name").alias("source"), "value", F.monotonically_increasing_id().alias("_n"))
    # a block's lines have ids one after the other
    blocks = lines.groupBy(F.col("_file").alias("_f"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_lines"), F.min("_n").alias("_first"))
    # a row a block, few enough for one window and to be broadcast
    before = (Window.orderBy("_f", "_b") if through else Window.partitionBy("_f").orderBy("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    own = lines.join(F.broadcast(blocks), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return own.select("source", (F.col("_before") + F.col("_n") - F.col("_first") + 1).alias("line"), "value")


def read_json_lines(spark: SparkSession, path: str, schema: str = PAYMENT, through: bool = False) -> DataFrame:
    """(source, line, raw, row, is_object) of each line that isn't blank; what is no object stays as a row with nulls.

    ``line`` counts from 1 with the blank ones; ``through``: over all files.
    """
    numbered = read_lines(spark, path, through).select("source", "line", F.trim("value").alias("raw")).filter("raw <> ''")
    return numbered.withColumns({"row": F.from_json("raw", schema), "is_object": F.json_object_keys("raw").isNotNull()})


def preferred_path(paths: list[str], names: tuple[str, ...] = ("records.jsonl.gz", "records.jsonl")) -> str | None:
    """The first of the names that a shard's listing has."""
    by_name = {p.rsplit("/", 1)[-1]: p for p in paths}
    return next((by_name[n] for n in names if n in by_name), None)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side file of one JSON document; no rows if it is absent or is no JSON."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], schema)
    try:
        found = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    return found.select(F.from_json("value", schema).alias("v")).filter("v is not null").select("v.*")


def optional_items(payload: Column, path: str, item: str) -> Column:
    """A list at a path of JSON; one object there is a list of one, nothing is an empty list."""
    found = F.get_json_object(payload, path)
    several, one = F.from_json(found, f"array<{item}>"), F.from_json(found, item)
    return F.coalesce(F.when(found.startswith("["), several), F.when(found.startswith("{"), F.array(one)), F.array().cast(f"array<{item}>"))


def holidays(doc: Column) -> Column:
    """array<struct<day, name>> of a feed in one of three shapes, tried in this order.

    year -> date -> names, date -> names, date -> name. Dates that are none go.
    """
    by_year = F.from_json(doc, "map<string, map<string, array<string>>>")
    by_date = F.from_json(doc, "map<string, array<string>>")
    single = F.from_json(doc, "map<string, string>")
    flat = F.flatten(F.transform(F.map_values(by_year), F.map_entries))
    ok = lambda entries: F.size(F.filter(entries, lambda e: F.try_to_date(e["key"], "yyyy-MM-dd").isNotNull() & e["value"].isNotNull())) > 0
    listed = F.map_entries(by_date)
    named = F.transform(F.map_entries(single), lambda e: F.struct(e["key"].alias("key"), F.array(e["value"]).alias("value")))
    entries = F.when(ok(flat), flat).when(ok(listed), listed).otherwise(named)
    days = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda n: F.struct(F.try_to_date(e["key"], "yyyy-MM-dd").alias("day"), n.alias("name")))))
    return F.filter(days, lambda d: d["day"].isNotNull())


def checked_by_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, content, url, error) of the manifest's files; an error where the file lacks or its SHA-256 is another."""
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "content", F.sha2("content", 256).alias("_sha"))
    told = manifest.join(own, "file_name", "left")
    error = F.when(F.col("path").isNull(), "missing").when(F.col("_sha") != F.lower("sha256"), "sha256 differs")
    return told.select("file_name", "path", F.when(error.isNull(), F.col("content")).alias("content"), "url", error.alias("error"))


def registry_of_zips(files: DataFrame, category: str = "음식") -> DataFrame:
    """Businesses of one category from archives of CSV files, with coordinates inside the country.

    Columns: id, name, branch, address, fallback (the region in the file's name), lat, lon.
    """
    ship(files.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in (n for n in z.namelist() if n.endswith(".csv")):
                        parts = name.rsplit("_", 2)
                        table = csv.DictReader(io.TextIOWrapper(z.open(name), encoding="utf-8-sig", newline=""))
                        own = [r for r in table if r.get("상권업종대분류명") == category]
                        yield pd.DataFrame(
                            [
                                (r.get("상가업소번호"), r.get("상호명") or "", r.get("지점명") or "", r.get("도로명주소") or r.get("지번주소") or "", parts[1] if len(parts) > 2 else None, r.get("위도"), r.get("경도"))
                                for r in own
                            ],
                            columns=["id", "name", "branch", "address", "fallback", "lat", "lon"],
                        )

    read = files.select("content").mapInPandas(rows, "id string, name string, branch string, address string, fallback string, lat string, lon string")
    read = read.withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")})
    return read.filter((F.col("lat") > 32) & (F.col("lat") < 39.5) & (F.col("lon") > 124) & (F.col("lon") < 132))


def full_name(name: Column, branch: Column, norm) -> Column:
    """The name with its branch, unless it ends with it already."""
    return F.when((F.coalesce(branch, F.lit("")) == "") | norm(name).endswith(norm(branch)), name).otherwise(F.concat(name, branch))


#: Parts of file names that are lists, and not the ledger of a day.
LIST_NAMES = ["chief", "dir"]


def day_of_file(path: Column | str) -> Column:
    """The day in a file's name, null without one."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def daily_ledger(grid: DataFrame, path: str = "doc") -> DataFrame:
    """Rows of cells of daily ledgers with their ``day``: that of the file's name, else the first that the file tells. Lists are left out."""
    name = F.element_at(F.split(path, "/"), -1)
    rows = grid.filter(~F.coalesce(name.rlike("|".join(LIST_NAMES)), F.lit(False)))
    told = F.regexp_extract(F.array_join("cells", " "), r"\d{4}-\d{2}-\d{2}", 0)
    first = rows.withColumn("_told", F.try_to_date(F.nullif(told, F.lit("")), "yyyy-MM-dd")).groupBy(path).agg(F.min_by("_told", F.when(F.col("_told").isNotNull(), F.struct("sheet", "row_no"))).alias("_first"))
    return rows.join(first, path, "left").withColumn("day", F.coalesce(day_of_file(path), "_first")).drop("_first")
