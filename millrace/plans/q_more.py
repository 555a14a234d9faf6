"""Queries of lists, ordered members, merged reads and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import docs, listing
from millrace.plans.base import calls, facts, orders
from millrace.plans.registry import query
from millrace.session import table


@query("query_entries", "SELECT event_id AS row_id FROM events WHERE event_type = 'error' AND contains(lower(props), '\"k\": 1') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts, event_id LIMIT 100")
def query_entries(spark: SparkSession, d: str) -> DataFrame:
    got = listing.query_rows(facts(spark, d), {"method": "error", "user_id": None}, {"props": '"K": 1'}, "event_time", "2024-01-05", "2024-01-25")
    return got.orderBy("event_time", "row_id").limit(100).select("row_id")


@query("query_transactions", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'high') AND o_orderdate < TIMESTAMP '1999-01-01'")
def query_transactions(spark: SparkSession, d: str) -> DataFrame:
    return listing.query_rows(orders(spark, d), {"o_orderstatus": "O"}, {"o_orderpriority": "HIGH"}, "at", None, "1999-01-01").select("o_orderkey")


@query("with_entries", "SELECT conv_id, list(role ORDER BY turn, length(text)) AS entries FROM conversations GROUP BY 1".replace("list(role ORDER BY turn, length(text))", "string_agg(role, ',' ORDER BY turn)"))
def with_entries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("entry", F.concat_ws(":", "conv_id", "turn"))
    seq = listing.entry_seq(c, "conv_id", F.col("turn"), "entry").select("conv_id", "entry", "seq")
    got = listing.with_entries(c.select("conv_id").distinct(), seq, c, "conv_id", "entry", "role")
    return got.select("conv_id", F.array_join("entries", ",").alias("entries"))


@query("merge_hours", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large, count(*) AS all_rows FROM events GROUP BY 1")
def merge_hours(spark: SparkSession, d: str) -> DataFrame:
    return listing.merge_hours(facts(spark, d), "event_time", {"errors": F.col("method") == "error", "large": F.col("quantity") > 50, "all_rows": F.lit(True)})


@query("response_groups", "SELECT user_id, event_type AS method, count(*) AS calls, count(*) FILTER (NOT value < 60) AS errors, arg_max(props, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2")
def response_groups(spark: SparkSession, d: str) -> DataFrame:
    return listing.response_groups(facts(spark, d), "user_id", "method", F.col("quantity") < 60, F.struct("event_time", "row_id"), "props")


@query(
    "forecast_vs_actual",
    """WITH y AS (SELECT event_type AS subject, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2), p AS (SELECT subject, strftime(day::DATE + 7, '%Y-%m-%d') AS day, y * 0.8 AS p10, y AS p50, y * 1.2 AS p90 FROM y)
SELECT coalesce(p.subject, y.subject) AS subject, coalesce(p.day, y.day) AS day, p10, p50, p90, y AS actual, y - p50 AS error, coalesce((y BETWEEN p10 AND p90)::INT, 0) AS inside FROM p FULL JOIN y ON p.subject = y.subject AND p.day = y.day""",
)
def forecast_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("event_time", "yyyy-MM-dd")
    y = facts(spark, d).groupBy(F.col("method").alias("subject"), day.alias("day")).agg(F.count("*").cast("double").alias("y"))
    p = y.select("subject", F.date_format(F.date_add(F.col("day").cast("date"), 7), "yyyy-MM-dd").alias("day"), (F.col("y") * 0.8).alias("p10"), F.col("y").alias("p50"), (F.col("y") * 1.2).alias("p90"))
    return listing.forecast_vs_actual(p, y)


@query(
    "backfill_days",
    """WITH p AS (SELECT o_orderpriority AS route, date_trunc('month', o_orderdate)::DATE AS day, count(*) AS value FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2), e AS (SELECT *, lead(day) OVER (PARTITION BY route ORDER BY day) AS until FROM p)
SELECT o_orderkey, value AS known FROM orders LEFT JOIN e ON route = o_orderpriority AND o_orderdate::DATE >= day AND (until IS NULL OR o_orderdate::DATE < until)""",
)
def backfill_days(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("on_day", F.to_date("at"))
    p = o.filter("at < TIMESTAMP '1998-01-01'").groupBy("o_orderpriority", F.trunc("on_day", "month").alias("day")).agg(F.count("*").alias("value"))
    return listing.backfill_days(o, p, "o_orderpriority", "on_day").select("o_orderkey", "known")


@query("empty_places", "SELECT l_suppkey, count(DISTINCT l_partkey) AS items, CASE WHEN count(DISTINCT l_partkey) >= 6 THEN 'high' ELSE 'medium' END AS severity FROM lineitem WHERE l_quantity < 3 GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 3")
def empty_places(spark: SparkSession, d: str) -> DataFrame:
    return listing.empty_places(calls(spark, d), "l_suppkey", "l_partkey", F.struct("event_time", "order_key", "row_id"), F.col("quantity") < 3).drop("last_item")


@query(
    "count_gaps",
    """WITH t AS (SELECT user_id, event_type AS method, arg_max(value, (ts, event_id)) AS c, arg_max(user_id * 0.5, (ts, event_id)) AS b FROM events GROUP BY 1, 2)
SELECT user_id, method, c - b AS gap FROM t WHERE abs(c - b) >= 2 AND CASE WHEN b <> 0 THEN abs(c - b) / abs(b) ELSE 1.0 END >= 0.1""",
)
def count_gaps(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("counted", F.col("quantity").cast("double")).withColumn("balance", F.col("user_id") * 0.5)
    return listing.count_gaps(f, ["user_id", "method"], F.struct("event_time", "row_id"), "counted", "balance")


@query("markdown_headings", "SELECT doc_id, len(regexp_extract_all(text, '(?m)^(#{1,6})[ \\t]+(.+?)[ \\t]*$'))::INT AS n FROM documents")
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(docs.headings(F.col("text"))).alias("n"))


@query("local_clock", "SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS day, hour(ts + INTERVAL 1 HOUR)::INT AS hour, strftime(date_trunc('week', ts + INTERVAL 1 HOUR), '%Y-%m-%d') AS week, strftime(date_trunc('month', ts + INTERVAL 1 HOUR), '%Y-%m-%d') AS month FROM events")
def local_clock(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions.fields import local_time

    t = local_time(F.col("event_time"), "Europe/Paris")
    day = lambda g: F.date_format(F.date_trunc(g, t), "yyyy-MM-dd").alias(g)
    return facts(spark, d).select(F.col("row_id").alias("event_id"), day("day"), F.hour(t).alias("hour"), day("week"), day("month"))
