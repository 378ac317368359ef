"""Serving queries: matching, ranking, menus, usage, and photos dealt out one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.address import address_tokens, same_address
from ..functions.text import client_name, nfkc
from .ranking import numbered, numbered_within

FAR = 2**31 - 1


def catalog_match(restaurants: DataFrame, catalog: DataFrame, today: Column, months: int = 18) -> DataFrame:
    """Restaurants with the one catalog place of the same name and address; none if there are two.

    Addresses are compared by words, road with road or lot with lot. What matches ends with
    the same two words that stand side by side in the catalog's address, so that these and
    the name are the key of the join; equal names and addresses are compared once.
    """
    fresh = catalog.filter(F.col("last_date").between(F.add_months(today, -months), today)).withColumn("address", nfkc("address"))
    keys = fresh.select("catalog_id", "region", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("name_variants", F.array().cast("array<string>"))))).alias("_v"), address_tokens("address").alias("_own"))
    keys = keys.withColumn("_k", client_name("_v")).filter((F.col("_k") != "") & (F.size("_own") >= 2))
    keys = keys.groupBy("_k", "region", "_own").agg(F.min("catalog_id").alias("_least"), F.max("catalog_id").alias("_most"))
    beside = F.transform(F.slice("_own", 1, F.size("_own") - 1), lambda x, i: F.struct(x.alias("a"), F.get(F.col("_own"), i + 1).alias("b")))
    keys = keys.withColumn("_pair", F.explode(F.array_distinct(beside)))
    asked = restaurants.select("id", client_name("name").alias("_k"), nfkc("road_address").alias("_road"), nfkc("address").alias("_lot"))
    asked = asked.select("id", "_k", F.explode(F.array_distinct(F.array(address_tokens("_road"), address_tokens("_lot")))).alias("_a")).filter(F.size("_a") >= 3)
    once = asked.select("_k", "_a").distinct().withColumn("_pair", F.struct(F.element_at("_a", -2).alias("a"), F.element_at("_a", -1).alias("b")))
    hit = once.join(keys, ["_k", "_pair"]).filter(same_address(F.col("_own"), F.col("_a"), F.col("region")))
    hit = hit.groupBy("_k", "_a").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    one = asked.join(hit, ["_k", "_a"]).groupBy("id").agg(F.min("_least").alias("catalog_id"), F.max("_most").alias("_most")).filter(F.col("catalog_id") == F.col("_most")).drop("_most")
    return restaurants.join(one, "id", "left")


def prioritised(df: DataFrame, matched: Column, distance: str = "distance", order: str = "ordinal") -> DataFrame:
    """Matched rows by distance, unknown last, then the others in their order."""
    return df.orderBy(~matched, F.when(matched, F.coalesce(distance, F.lit(FAR))), order)


def prioritised_places(df: DataFrame, matched: Column, distance: str = "distance", order: str = "ordinal") -> DataFrame:
    """All rows with their ``place`` in the prioritised order, from 1."""
    near = F.when(matched, F.coalesce(distance, F.lit(FAR)))
    return numbered(df, [~matched, near, F.col(order)], "place")


def first_unique(df: DataFrame, key: str, order: list[str], n: int = 13) -> DataFrame:
    """The first n distinct keys in the given order, each with its first row."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
    return first.orderBy(*order).limit(n)


def nearest_open(df: DataFrame, n: int = 13, distance: str = "distance") -> DataFrame:
    """Places that are open or may be, the nearest first, unknown distances last."""
    return df.filter(F.coalesce("is_open", F.lit(True))).orderBy(F.col(distance).asc_nulls_last(), "ordinal").limit(n)


def menu_candidates(df: DataFrame, menus: str = "menus") -> DataFrame:
    """A row for each dish and restaurant that has it: the restaurant's ``place`` by distance, how many there are and how near the nearest is.

    All restaurants of a dish are listed, as rows, so that a dish that all have is many
    tasks. ``order by restaurant_count desc, nearest, menu, place`` is the order to show.
    """
    each = df.withColumns({"menu": F.explode(menus), "distance": F.coalesce("distance", F.lit(FAR))}).select("menu", "distance", "ordinal", "id")
    counted = each.groupBy(F.col("menu").alias("_m")).agg(F.count(F.lit(1)).alias("restaurant_count"), F.min("distance").alias("nearest"))
    placed = numbered_within(each, ["menu"], [F.col("distance"), F.col("ordinal"), F.col("id")], "place")
    return placed.join(counted, F.col("menu") == F.col("_m")).drop("_m")


def with_curated(restaurants: DataFrame, curated: DataFrame, key: str = "id", value: str = "curated") -> DataFrame:
    """Restaurants with the curated value of their key, null without one; of several the first."""
    one = curated.groupBy(F.col(key).alias("_key")).agg(F.min(value).alias(value))
    return restaurants.join(one, F.col(key) == F.col("_key"), "left").drop("_key")


def nearest_names(df: DataFrame, name: str, distance: str, n: int = 2) -> DataFrame:
    """The least distance of each name, and the n nearest names."""
    return df.groupBy(name).agg(F.min(distance).alias(distance)).orderBy(distance, name).limit(n)


def fitting(df: DataFrame, fits: Column) -> DataFrame:
    """Rows that fit, or all if none does."""
    some = df.agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("_some"))  # one row
    return df.crossJoin(F.broadcast(some)).filter(~F.col("_some") | F.coalesce(fits, F.lit(False))).drop("_some")


def choice_ranking(log: DataFrame, menu: str = "menu") -> DataFrame:
    return log.groupBy(menu).agg(F.count(F.lit(1)).alias("n_choices")).orderBy(F.col("n_choices").desc(), menu)


def region_usage(log: DataFrame, name: str = "name", ts: str = "ts") -> DataFrame:
    """How often and when last each region was used; coordinates of the first use."""
    named = log.withColumn(name, F.trim(name)).filter((F.col(name) != "") & ~F.col(name).isin(fixed.NOT_REGIONS))
    return named.groupBy(name).agg(F.count(F.lit(1)).alias("n_used"), F.max(ts).alias("last_used"), F.min_by("latitude", ts).alias("latitude"), F.min_by("longitude", ts).alias("longitude"))


def frequent(usage: DataFrame, n: int = 3) -> DataFrame:
    return usage.orderBy(F.col("n_used").desc(), F.col("last_used").desc()).limit(n)


def history_by_region(log: DataFrame, region: str, ts: str, other: str) -> DataFrame:
    """A row for each choice, with its ``place`` in its region's history, the newest first, and how many there are and when the newest was.

    Rows without a region stand under a label. Whole histories are listed, as rows, so that
    a region of any size is many tasks; ``order by newest desc, place`` is the order to show.
    """
    fields = [c for c in log.columns if c not in (region, ts)]
    rows = log.withColumn(region, F.coalesce(region, F.lit(other)))
    counted = rows.groupBy(F.col(region).alias("_r")).agg(F.count(F.lit(1)).alias("n_choices"), F.max(ts).alias("newest"))
    placed = numbered_within(rows, [region], [F.col(ts).desc(), *[F.col(c).desc() for c in fields]], "place")
    return placed.join(counted, F.col(region) == F.col("_r")).drop("_r")


def refreshed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Old rows with the new value where there is one."""
    return old.join(new.select(key, F.col(value).alias("_new")), key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def workdays(days: DataFrame, holidays: DataFrame, known_years: list[int] | None = None) -> DataFrame:
    """The days that are no weekend and no holiday, in the years whose holidays are known: those that have any if none are named."""
    days = days.select("day").distinct().filter(~F.dayofweek("day").isin(1, 7))
    if known_years is not None:
        days = days.filter(F.year("day").isin(known_years))
    else:
        days = days.withColumn("_y", F.year("day")).join(holidays.select(F.year("day").alias("_y")).distinct(), "_y", "left_semi").drop("_y")
    return days.join(holidays.select("day"), "day", "left_anti")


def override_years(bundled: DataFrame, fetched: DataFrame) -> DataFrame:
    """Bundled holidays but for the years that were fetched anew, and those."""
    years = fetched.select(F.year("day").alias("_y")).distinct()
    return bundled.withColumn("_y", F.year("day")).join(years, "_y", "left_anti").drop("_y").unionByName(fetched)


def unique_photos(df: DataFrame) -> DataFrame:
    """(request, ordinal, id, photo_id, photo_url, kept): photos dealt out in order, each id and address once a request.

    df has photo_id and photo_url of a photo that a place has already (null without), and
    photos and spare: array<struct<id, url>> for its query and for its fallback query. Each
    place keeps its photo if no earlier place has it, else takes the first free one of its
    pool, and then of its spare pool; free is a photo of which neither id nor address was
    used in the request. A place that finds none has none. Each choice depends on those
    before: a request is folded from its first place to its last, with what was used as
    the state; it has a dozen rows, by the limit of the page that asks.
    """
    own = F.when(F.col("photo_url").isNotNull(), F.array(F.struct(F.coalesce("photo_id", "photo_url").alias("id"), F.col("photo_url").alias("url"), F.lit(True).alias("own"))))
    pool = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<id:string,url:string>>")), lambda p: F.struct(p["id"].alias("id"), p["url"].alias("url"), F.lit(False).alias("own")))
    offered = F.concat(F.coalesce(own, F.array().cast("array<struct<id:string,url:string,own:boolean>>")), pool("photos"), pool("spare"))
    rows = df.select("request", "ordinal", "id", offered.alias("offered")).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "offered"))).alias("places"))
    used = F.struct(*[F.array().cast("array<string>").alias(c) for c in ("ids", "urls")], F.array().cast("array<struct<id:string,url:string,own:boolean>>").alias("dealt"))

    def deal(state: Column, place: Column) -> Column:
        free = F.filter(place["offered"], lambda p: ~F.array_contains(state["ids"], p["id"]) & ~F.array_contains(state["urls"], p["url"]))
        pick = F.get(free, F.lit(0))
        with_ = lambda known, new: F.when(pick.isNull(), known).otherwise(F.concat(known, F.array(new)))
        return F.struct(with_(state["ids"], pick["id"]).alias("ids"), with_(state["urls"], pick["url"]).alias("urls"), F.concat(state["dealt"], F.array(pick)).alias("dealt"))

    told = rows.withColumn("dealt", F.aggregate("places", used, deal, lambda s: s["dealt"])).select("request", F.explode(F.arrays_zip("places", "dealt")).alias("z"))
    return told.select("request", "z.places.ordinal", "z.places.id", F.col("z.dealt.id").alias("photo_id"), F.col("z.dealt.url").alias("photo_url"), F.coalesce("z.dealt.own", F.lit(False)).alias("kept"))


def response(df: DataFrame, source: str, disclaimer: str, order: str = "ordinal") -> DataFrame:
    """One row: the JSON body of an answer with the restaurants in order. The limit of a page bounds their number."""
    fields = [c for c in df.columns if c != order]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("r")))), lambda x: x["r"])
    return df.agg(F.to_json(F.struct(listed.alias("restaurants"), F.lit(source).alias("source"), F.lit(disclaimer).alias("disclaimer"))).alias("body"))


def decoded_response(answers: DataFrame, restaurant: str, status: str = "status", body: str = "body") -> DataFrame:
    """The restaurants of answers with ``error``: transport without a status, badResponse for one that is no success, decoding for a body that is none.

    An answer with an error, and one without restaurants, gives one row.
    """
    schema = f"restaurants array<struct<{restaurant}>>, source string, disclaimer string"
    told = answers.withColumn("_d", F.from_json(body, schema))
    error = F.when(F.col(status).isNull(), "transport").when(~F.col(status).between(200, 299), F.concat(F.lit("badResponse "), F.col(status).cast("string"))).when(F.col("_d.restaurants").isNull(), "decoding")
    told = told.withColumn("error", error)
    return told.select(F.explode_outer(F.when(F.col("error").isNull(), F.col("_d.restaurants"))).alias("r"), F.when(F.col("error").isNull(), F.col("_d.source")).alias("source"), "error").select("r.*", "source", "error")
