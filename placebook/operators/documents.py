"""Catalog documents, side files and saved outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.address import region_of
from ..functions.scalars import in_window, is_https

CATALOG = (
    "schemaVersion int, generatedAt string, coverageDescription string, sourceURLs array<string>, "
    "restaurants array<struct<name: string, address: string, region: string, departmentCount: int, lastPaymentDate: string, sourceURL: string, sourceURLs: array<string>, nameVariants: array<string>>>"
)


def well_formed(r: Column) -> Column:
    """A catalog place that can be used; faulty ones are left out one by one."""
    region_ok = r["region"].isNull() | r["region"].isin(fixed.REGIONS)
    links_ok = r["sourceURLs"].isNull() | F.forall(r["sourceURLs"], is_https)
    return F.coalesce(
        (F.trim(r["name"]) != "") & (F.trim(r["address"]) != "") & (r["departmentCount"] >= 0)
        & F.try_to_date(r["lastPaymentDate"], "yyyy-MM-dd").isNotNull() & is_https(r["sourceURL"]) & region_ok & links_ok,
        F.lit(False),
    )


def load_catalog(docs: DataFrame, column: str = "document", version: int = 1) -> DataFrame:
    """The well-formed places of a catalog document; none if the document as a whole is faulty."""
    d = docs.select(F.from_json(column, CATALOG).alias("d")).select("d.*")
    whole = (
        (F.col("schemaVersion") == version)
        & F.try_to_timestamp("generatedAt").isNotNull()
        & (F.trim("coverageDescription") != "")
        & (F.size("sourceURLs") > 0)
        & F.forall("sourceURLs", is_https)
    )
    return d.filter(whole).select(F.explode(F.filter("restaurants", well_formed)).alias("r")).select("r.*")


def eligible(last_payment: Column | str, today: Column, months: int = 18) -> Column:
    """A place whose last payment is of the last months up to today, in the zone of the caller's date."""
    c = F.col(last_payment) if isinstance(last_payment, str) else last_payment
    return in_window(F.try_to_date(c, "yyyy-MM-dd"), today, months)


def https_urls(doc: Column) -> Column:
    """HTTPS strings anywhere in a JSON document, in their order, each once. Keys don't count."""
    strings = F.filter(F.regexp_extract_all(doc, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0)), lambda s: ~s.endswith(":"))
    plain = F.transform(strings, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, '^"|"$', ""), r"\\/", "/")))
    return F.array_distinct(F.filter(plain, is_https))


def region_urls(doc: Column, region: Column) -> Column:
    """The document's URLs of one region: under its own name, or in the list or object of regions, or else all."""
    top = F.from_json(doc, "map<string, string>")

    def own(m: Column) -> Column:
        hit = F.filter(F.map_entries(m), lambda e: region_of(F.trim(e["key"])) == region)
        value = hit[0]["value"]  # a string stands there without its quotes
        return F.when(F.size(hit) > 0, https_urls(F.when(value.rlike(r"^\s*[\[{]"), value).otherwise(F.concat(F.lit('"'), value, F.lit('"')))))

    found = [own(top)]
    for name in ("regions", "byRegion", "지역"):
        inner = F.try_element_at(top, F.lit(name))
        found.append(own(F.from_json(inner, "map<string, string>")))
        listed = F.filter(F.from_json(inner, "array<string>"), lambda x: region_of(F.trim(F.get_json_object(x, "$.region"))) == region)
        urls = https_urls(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
        found.append(F.when(F.size(urls) > 0, urls))
    return F.coalesce(*found, https_urls(doc))


def provenance(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Files with the source that their digest belongs to; only sources with a safe link count."""
    known = sources.filter(is_https("url")).select("sha256", "url").distinct()
    return files.join(known, "sha256")


def saved_outputs(frames: list[DataFrame], key: str = "recordID") -> DataFrame:
    """Records of several saved outputs, the first of each id in the order of the outputs.

    Records without an id get one from their fields. Of one id that an output has twice, the
    first in the order of its columns counts, so that reruns agree.
    """
    from .merge import in_order

    rows = in_order(frames)
    made = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("region", "institution", "name", "address", "paymentDate") if c in rows.columns]), 256)
    rows = rows.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), made))
    others = [F.to_json(F.struct(*rows.columns))]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("shard_no", *others))).filter("_r = 1").drop("_r")


def preserved(old: DataFrame, new: DataFrame, targets: list[str], region: str = "region") -> DataFrame:
    """Old rows of the regions that were not collected anew, and all new ones."""
    return old.filter(~F.col(region).isin(targets)).unionByName(new, allowMissingColumns=True)


def department_of(row: Column, sheet: Column, posting: Column) -> Column:
    """Evidence of the department by precedence, and which it was."""
    found = [F.nullif(F.trim(c), F.lit("")) for c in (row, sheet, posting)]
    kind = F.when(found[0].isNotNull(), "row").when(found[1].isNotNull(), "sheet").when(found[2].isNotNull(), "posting").otherwise("none")
    return F.struct(F.coalesce(*found, F.lit("")).alias("department"), kind.alias("evidence"))


def with_metadata(files: DataFrame, metadata: DataFrame, key: str = "document_id", contained: str | None = None) -> DataFrame:
    """Files with the metadata of their document; ``contained``: by an id that a cell contains, the first one.

    The id is cut out of the cell and hashed; cells are not compared with all ids.
    """
    if contained is None:
        return files.join(metadata, key, "left")
    cut = files.withColumn("_id", F.explode_outer(F.regexp_extract_all(contained, F.lit(r"([A-Za-z0-9_-]{4,})"), F.lit(1))))
    hit = cut.join(metadata.withColumnRenamed(key, "_id"), "_id").drop("_id").dropDuplicates(files.columns)
    return hit.unionByName(files.join(hit.select(*files.columns), files.columns, "left_anti"), allowMissingColumns=True)


def period(df: DataFrame, group: list[str], day: str = "payment_date") -> DataFrame:
    """First and last day, sorted distinct departments, institutions and URLs of each group."""
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("department", "institution", "source_url")]
    return df.groupBy(*group).agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"), *sets)


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Columns that begin with the prefix as null."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in df.dtypes if c.startswith(prefix)})


def read_optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a local store; lines that can't be read are left out."""
    return spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad is null").drop("_bad")
