"""Canonical series over the driver's tables, for Spark and as DuckDB common table
expressions. Money is in millions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.series import bucket, indexed, on_spine

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_month(spark, sf_dir) -> DataFrame:
    """t, y: monthly order totals, 80 months."""
    return indexed(bucket(table(spark, sf_dir, "orders"), "o_orderdate", "month", {"y": F.sum("o_totalprice") / 1e6}), [], "ts")


def orders_priority(spark, sf_dir) -> DataFrame:
    """p, t, y: monthly totals by priority, null where a month has no order."""
    s = bucket(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "p"), "o_orderdate", "month", {"y": F.sum("o_totalprice") / 1e6}, ["p"])
    every = table(spark, sf_dir, "orders").agg(F.date_trunc("month", F.min("o_orderdate")).cast("timestamp_ntz").alias("lo"), F.date_trunc("month", F.max("o_orderdate")).cast("timestamp_ntz").alias("hi"))
    keys = s.select("p").distinct()
    spine = keys.join(F.broadcast(every), F.lit(True)).select("p", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("ts"))
    return indexed(spine.join(s, ["p", "ts"], "left"), ["p"], "ts")


def events_hour(spark, sf_dir) -> DataFrame:
    """t, y: hourly sums of event values, 0 for an hour without events."""
    s = bucket(table(spark, sf_dir, "events"), "ts", "hour", {"y": F.sum("value")})
    return indexed(on_spine(s, "hour", fill={"y": 0.0}), [], "ts")


def events_type(spark, sf_dir) -> DataFrame:
    """k, t, y: hourly sums by event type on each type's own spine."""
    s = bucket(table(spark, sf_dir, "events").withColumnRenamed("event_type", "k"), "ts", "hour", {"y": F.sum("value")}, ["k"])
    return indexed(on_spine(s, "hour", ["k"], {"y": 0.0}), ["k"], "ts")


def lineitem_month(spark, sf_dir) -> DataFrame:
    """k, t, y: monthly revenue by return flag."""
    s = bucket(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "k"), "l_shipdate", "month", {"y": F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6}, ["k"])
    return indexed(s, ["k"], "ts")


SQL = {
    "om": "om AS (SELECT row_number() OVER (ORDER BY m) - 1 AS t, y FROM (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1))",
    "eh": """eh AS (SELECT row_number() OVER (ORDER BY h) - 1 AS t, coalesce(v, 0.0) AS y FROM
      (SELECT unnest(generate_series(date_trunc('hour', min(ts))::TIMESTAMP, date_trunc('hour', max(ts))::TIMESTAMP, INTERVAL 1 HOUR)) AS h FROM events)
      LEFT JOIN (SELECT date_trunc('hour', ts)::TIMESTAMP AS h, sum(value) AS v FROM events GROUP BY 1) USING (h))""",
    "op": """op AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY m) - 1 AS t, y FROM
      (SELECT p, m FROM (SELECT DISTINCT o_orderpriority AS p FROM orders),
        (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate))::TIMESTAMP, date_trunc('month', max(o_orderdate))::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM orders))
      LEFT JOIN (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::TIMESTAMP AS m, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1, 2) USING (p, m))""",
    "et": """et AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY h) - 1 AS t, coalesce(v, 0.0) AS y FROM
      (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM
        (SELECT event_type AS k, date_trunc('hour', min(ts))::TIMESTAMP AS lo, date_trunc('hour', max(ts))::TIMESTAMP AS hi FROM events GROUP BY 1))
      LEFT JOIN (SELECT event_type AS k, date_trunc('hour', ts)::TIMESTAMP AS h, sum(value) AS v FROM events GROUP BY 1, 2) USING (k, h))""",
    "lm": """lm AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY m) - 1 AS t, y FROM
      (SELECT l_returnflag AS k, date_trunc('month', l_shipdate) AS m, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS y FROM lineitem GROUP BY 1, 2))""",
}

#: The event types, in order.
TYPES = ["click", "error", "purchase", "signup", "view"]
