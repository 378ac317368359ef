"""Positions, medians and seeded orders against plain Python, and how many tasks a hot group takes."""

import random
import statistics

from pyspark.sql import functions as F

from placebook.operators import documents, ranking, serve


def test_numbers_are_those_of_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b", "b", "b"]), rng.randint(0, 20)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {r["id"]: r["n"] for r in ranking.numbered(df, [F.col("v").desc(), F.col("id")], "n").collect()}
    assert got == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    within = {r["id"]: r["n"] for r in ranking.numbered_within(df, ["g"], [F.col("v"), F.col("id")], "n").collect()}
    want = {}
    for g in (None, "a", "b"):
        want |= {r[0]: k for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1)}
    assert within == want
    assert ranking.numbered(df.limit(0), [F.col("v")], "n").count() == ranking.numbered_within(df.limit(0), ["g"], [F.col("v")], "n").count() == 0


def test_medians_of_ties_nulls_and_signs(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "hot", "hot", "hot", "x"]), rng.choice([None, 0, -3, 5, 7, 8, 100, rng.randint(1, 50)])) for _ in range(700)] + [("none", 0), ("one", 9), ("two", 4), ("two", 7)]
    got = {r["g"]: r["m"] for r in ranking.medians(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", "m").collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v > 0:
            groups.setdefault(g, []).append(v)
    assert got == {g: statistics.median(v) for g, v in groups.items()}


def test_a_hot_place_is_many_ranges(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") + 1).alias("v"))
    rows = ranking._ranged(df.filter("g = 'hot'"), [F.col("g"), F.col("v")])
    largest = rows.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < rows.count() / 2
    hot = sorted(i + 1 for i in range(40_000) if i % 3 == 0)
    assert ranking.medians(df, ["g"], "v", "m").filter("g = 'hot'").first()["m"] == statistics.median(hot)


def test_shuffles_repeat_by_seed_and_differ_between_seeds(spark):
    df = spark.range(200).repartition(7)
    order = lambda seed, rows=df: {r["id"]: r["place"] for r in ranking.shuffled(rows, ["id"], seed).collect()}
    one = order(1)
    assert one == order(1, df.repartition(2)) and sorted(one.values()) == list(range(1, 201)) and one != order(2)
    picks = [ranking.picked(df.withColumn("g", F.col("id") % 4), ["g"], ["id"], s).orderBy("g").collect() for s in (1, 1, 2)]
    assert picks[0] == picks[1] != picks[2] and [r["id"] % 4 for r in picks[0]] == [0, 1, 2, 3]


def test_dishes_list_all_their_restaurants(spark):
    df = spark.range(150).select("id", F.col("id").alias("ordinal"), F.when(F.col("id") % 50 != 0, 1000 - F.col("id")).alias("distance"), F.when(F.col("id") == 0, F.array(F.lit("rare"))).otherwise(F.array(F.lit("common"))).alias("menus"))
    rows = serve.menu_candidates(df).filter("menu = 'common'").orderBy("place").collect()
    assert len(rows) == 149 and [r["place"] for r in rows] == list(range(1, 150)) and rows[0]["id"] == 149 and {r["restaurant_count"] for r in rows} == {149} and rows[-1]["distance"] == serve.FAR


def test_workdays_know_the_years_of_their_holidays(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2024-12-23', DATE '2025-01-10')) AS day")
    holidays = spark.sql("SELECT DATE '2025-01-01' AS day")
    got = [r["day"].isoformat() for r in serve.workdays(days, holidays).orderBy("day").collect()]
    assert got == ["2025-01-02", "2025-01-03", "2025-01-06", "2025-01-07", "2025-01-08", "2025-01-09", "2025-01-10"]
    assert serve.workdays(days, holidays, [2024]).count() == 7


def test_keys_with_a_prefix_become_null(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, photo_id string, photo_url string")
    assert documents.without_prefix(df, "photo_").collect()[0] == (1, None, None)


def test_additions_meet_earlier_additions(spark):
    """Against a plain loop with an index that each place, also a joined one, writes its names into."""
    import datetime as dt

    from placebook.operators import merge

    rng = random.Random(9)
    place = lambda i: (i, rng.choice([None, "k1", "k1", "k2"]), rng.randint(1, 9), rng.sample("pqrs", rng.randint(0, 3)), [rng.choice("abcdefghij") for _ in range(rng.randint(1, 3))], dt.date(2026, 1, rng.randint(1, 9)), dt.date(2026, 2, rng.randint(1, 9)))
    base, more = [place(i) for i in range(12)], [place(i) for i in range(60)]
    items, index = [], {}
    for side, rows in (("base", base), ("added", more)):
        for o, key, n, units, names, a, b in rows:
            keys = [(key, v) for v in names]
            found = next((index[k] for k in keys if k in index), None) if side == "added" else None
            if found is None:
                items.append(found := {"o": (side, o), "key": key, "n": 0, "d": set(), "v": set(), "a": a, "b": b})
            found["n"] += n
            found["d"] |= set(units)
            found["v"] |= set(names)
            found["a"], found["b"] = min(found["a"], a), max(found["b"], b)
            index |= dict.fromkeys(keys, found)
    schema = "ordinal int, address_key string, record_count int, departments array<string>, name_variants array<string>, first_date date, last_date date"
    got = merge.upsert_in_order(spark.createDataFrame(base, schema), spark.createDataFrame(more, schema)).collect()
    want = sorted((i["o"], i["key"] or "", i["n"], sorted(i["d"]), sorted(i["v"]), i["a"], i["b"]) for i in items)
    assert sorted(((r["origin"], r["ordinal"]), r["address_key"] or "", r["record_count"], r["departments"], r["name_variants"], r["first_date"], r["last_date"]) for r in got) == want
    assert merge.upsert_in_order(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_the_row_before_across_ranges(spark):
    rows = [(i % 3 if i % 7 else None, i) for i in range(300)]
    got = {r["v"]: r["p"] for r in ranking.previous(spark.createDataFrame(rows, "g int, v int"), ["g"], [F.col("v")], "v", "p").collect()}
    last, want = {}, {}
    for g, v in rows:
        want[v] = last.get(g)
        last[g] = v
    assert got == want


def test_payments_are_placed_without_a_window_over_a_region(spark, monkeypatch):
    from placebook.plans import ledgers

    monkeypatch.setattr(ledgers, "RANGE_ROWS", 500)
    told = []
    monkeypatch.setattr(ledgers.ranking, "_ranged", lambda df, order, parts=0, real=ranking._ranged: told.append(parts) or real(df, order, parts))
    out = ledgers.sorted_payments(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert told == [-(-n // 500)]
    assert "windowspecdefinition(region" not in out._jdf.queryExecution().executedPlan().toString()
