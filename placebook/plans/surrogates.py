"""The star schema read as places, payments, registries and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day of every query; part of the payments come after it.
AS_OF = "2001-06-30"
MONTHS = 18


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(words: list[str], key: str) -> Column:
    """One of the words by a key: free text that both engines can make."""
    return F.get(F.array(*map(F.lit, words)), F.pmod(F.col(key), F.lit(len(words))).cast("int"))


def sql_choice(words: list[str], key: str) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"([{quoted}])[({key} % {len(words)}) + 1]"


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as payments: place = supplier, department = priority, institution = nation."""
    t = lambda n: table(spark, sf_dir, n)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"),
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("ordinal"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("institution"),
        F.col("o_orderpriority").alias("department"),
        F.col("s_name").alias("name"),
        F.col("l_suppkey").alias("place_key"),
        F.col("o_orderdate").cast("date").alias("payment_date"),
        F.floor("l_extendedprice").alias("amount"),
        (F.col("l_returnflag") != "R").alias("is_meal"),
        F.concat(F.lit("https://docs.example/"), F.col("l_orderkey") % 500).alias("source_url"),
        "l_partkey",
        "l_linestatus",
        "l_quantity",
    )


P = """p AS (
  SELECT l_orderkey || ':' || l_linenumber AS record_id,
         ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS ordinal,
         r_name AS region, n_name AS institution, o_orderpriority AS department, s_name AS name, l_suppkey AS place_key,
         CAST(o_orderdate AS DATE) AS payment_date, CAST(floor(l_extendedprice) AS BIGINT) AS amount,
         l_returnflag <> 'R' AS is_meal, 'https://docs.example/' || (l_orderkey % 500) AS source_url, l_partkey, l_linestatus, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
SQL_AS_OF = f"DATE '{AS_OF}'"
SQL_FROM = f"CAST({SQL_AS_OF} - INTERVAL {MONTHS} MONTH AS DATE)"


def lat(key: str) -> Column:
    return F.lit(35.0) + (F.col(key) % 100) / 50.0


def lon(key: str) -> Column:
    return F.lit(127.0) + (F.col(key) % 77) / 50.0


def sql_lat(key: str) -> str:
    return f"(35.0::DOUBLE + ({key} % 100) / 50.0::DOUBLE)"


def sql_lon(key: str) -> str:
    return f"(127.0::DOUBLE + ({key} % 77) / 50.0::DOUBLE)"


def sql_flat(a: str, b: str, c: str, d: str) -> str:
    return f"(6371000.0::DOUBLE * sqrt(pow(radians({a} - {c}), 2) + pow(radians({b} - {d}) * cos(radians(({a} + {c}) / 2)), 2)))"


def cases(spark: SparkSession, sf_dir: str, inputs: list[tuple]) -> DataFrame:
    """Suppliers with one of the inputs each, in turn, as in0, in1, ...: for rules whose SQL would need look-ahead or Unicode tables."""
    columns = [choice_or_null([row[i] for row in inputs], "s_suppkey").alias(f"in{i}") for i in range(len(inputs[0]))]
    return table(spark, sf_dir, "supplier").select("s_suppkey", *columns)


def choice_or_null(words: list[str | None], key: str) -> Column:
    return F.get(F.array(*[F.lit(w).cast("string") for w in words]), F.pmod(F.col(key), F.lit(len(words))).cast("int"))


def expected_sql(**columns: list) -> str:
    """SQL that tells each supplier's expected values in turn."""
    def literal(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

    told = [f"([{', '.join(map(literal, values))}])[s_suppkey % {len(values)} + 1] AS {name}" for name, values in columns.items()]
    return f"SELECT s_suppkey, {', '.join(told)} FROM supplier"
