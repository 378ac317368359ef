"""The streaming analogue over a folder of files."""

import datetime as dt

from placebook.streaming import payments


def test_copies_and_windows(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    schema = "id string, ts timestamp, kind string, value double"
    for i, rows in enumerate([[("a", at(1), "x", 1.0), ("a", at(1), "x", 1.0)], [("b", at(2), "x", 2.0)], [("c", at(60), "y", 5.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    once = payments.first_copies(stream, ["id"])
    q = once.writeStream.format("memory").queryName("copies").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.sql("SELECT id FROM copies").collect()) == ["a", "b", "c"]
    q = payments.totals(stream, ["kind"]).writeStream.format("memory").queryName("totals").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["kind"], r["n"], r["total"]) for r in spark.sql("SELECT * FROM totals").collect()] == [("x", 3, 4.0)]
