"""Queries that run as streams over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diff
from millrace.plans.base import facts
from millrace.plans.registry import query
from millrace.session import table, tasks_for
from millrace.sources import stitching
from millrace.sources.feed import Feed
from millrace.sources.versioned import Buckets
from millrace.streaming import jobs


def _stream(spark: SparkSession, d: str) -> DataFrame:
    cols = {"row_id": F.col("event_id"), "user_id": F.col("user_id"), "method": F.col("event_type"), "level": F.col("value"), "text": F.concat_ws(" ", "event_type", "props")}
    return jobs.read_stream(spark, f"{d}/events.parquet", "ts", cols)


@query("stream_digest", "SELECT strftime(to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS method, count(*) AS n FROM events WHERE floor(epoch(ts) / 21600) * 21600 + 21600 <= (SELECT epoch(max(ts)) - 600 FROM events) GROUP BY 1, 2")
def stream_digest(spark: SparkSession, d: str) -> DataFrame:
    """Only windows that the watermark has passed."""
    return jobs.run_to_table(jobs.digest(_stream(spark, d), "6 hours"), "digest")


@query("stream_incremental", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    got = jobs.run_to_table(jobs.incremental(_stream(spark, d), "1 hour", ["row_id"]), "incremental")
    return got.agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("ids"))


@query(
    "stream_rules",
    "SELECT rule, rule || ':' || event_id AS key FROM (SELECT event_id, unnest([CASE WHEN event_type = 'error' THEN 'errors' END, CASE WHEN regexp_matches(props, '\"k\": 7[0-9]') THEN 'sevens' END]) AS rule FROM events) WHERE rule IS NOT NULL",
)
def stream_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [{"name": "errors", "methods": ["error"]}, {"name": "sevens", "pattern": '"k": 7[0-9]'}]
    return jobs.run_to_table(jobs.match_rules(_stream(spark, d), rules), "rules").select("rule", "key")


@query(
    "stream_watches",
    """WITH r AS (SELECT user_id, ts, (value >= 90)::INT AS up, (sum((value < 40)::INT) OVER w = 3)::INT AS down FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, coalesce(last_value(CASE WHEN up = 1 THEN 'alert' WHEN down = 1 THEN 'ok' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'ok') AS status FROM r),
c AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY ts), 'ok') AS before FROM s) SELECT user_id::VARCHAR AS watch, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS changed, status FROM c WHERE status <> before""",
)
def stream_watches(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).select(F.col("user_id").cast("string").alias("watch"), "at", "level")
    got = jobs.run_to_table(jobs.watches(s, 90, 40, 3), "watches")
    return got.select("watch", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("changed"), "status")


@query("hourly_cap", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) SELECT event_id FROM r WHERE n <= 1")
def hourly_cap(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select(F.col("event_time").alias("at"), F.col("row_id").alias("key"), "method", F.col("method").alias("title"))
    return jobs.hourly_cap(f, "method", 1)[0].select(F.col("key").alias("event_id"))


@query("late_changes", "SELECT event_id AS row_id, CASE WHEN event_id % 6 = 0 THEN 'insert' ELSE 'update' END AS action FROM events WHERE ts >= TIMESTAMP '2024-01-28' AND (event_id % 6 = 0 OR event_id % 4 = 0)")
def late_changes(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select(F.col("event_time").alias("at"), "row_id", F.col("quantity").cast("string").alias("digest"))
    stored = f.filter("row_id % 6 <> 0").withColumn("digest", F.when(F.col("row_id") % 4 == 0, "old").otherwise(F.col("digest")))
    return jobs.process_late(f.filter("at >= TIMESTAMP '2024-01-28'"), stored, ["row_id"], "digest", 60, 300)[1]


@query(
    "late_ranges",
    """WITH r AS (SELECT DISTINCT floor(epoch(ts))::BIGINT - 60 AS lo, floor(epoch(ts))::BIGINT + 60 AS hi FROM events WHERE ts >= TIMESTAMP '2024-01-28'),
c AS (SELECT *, CASE WHEN lo <= max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300 THEN 0 ELSE 1 END AS new FROM r), g AS (SELECT *, sum(new) OVER (ORDER BY lo, hi) AS run FROM c) SELECT min(lo) AS lo, max(hi) AS hi FROM g GROUP BY run""",
)
def late_ranges(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select(F.col("event_time").alias("at"), "row_id", F.lit("x").alias("digest"))
    return jobs.process_late(f.filter("at >= TIMESTAMP '2024-01-28'"), f, ["row_id"], "digest", 60, 300)[0]


@query("missing_between_versions", "SELECT event_id AS row_id, 'vanished' AS side FROM events WHERE event_id % 9 = 0")
def missing_between_versions(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return diff.key_difference(f, f.filter("row_id % 9 <> 0"), ["row_id"], tasks_for(table(spark, d, "events")))


@query("stream_caps", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events) SELECT event_id FROM r WHERE n <= 2")
def stream_caps(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).select("at", F.col("row_id").alias("key"), "method", F.col("method").alias("title"))
    return jobs.run_to_table(jobs.capped(s, "method", 2), "caps").filter("kind = 'sent'").select(F.col("key").alias("event_id"))


@query("stream_cap_summaries", """WITH h AS (SELECT event_type AS "group", date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT "group", strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, n - 2 AS held FROM h WHERE n > 2 AND hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events)""")
def stream_cap_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The hours that the watermark has passed in which findings were held, and how many."""
    s = _stream(spark, d).select("at", F.col("row_id").alias("key"), "method", F.col("method").alias("title"))
    got = jobs.run_to_table(jobs.capped(s, "method", 2), "caps").filter("kind = 'summary'")
    return got.select(F.col("title").alias("group"), F.date_format(F.col("at") - F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "held")


@query("stream_late", "SELECT event_id AS row_id, CASE WHEN event_id % 6 = 0 THEN 'insert' ELSE 'update' END AS action FROM events WHERE event_id % 6 = 0 OR event_id % 4 = 0")
def stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Every event arrives again; a sixth was never stored and a quarter was stored with another value."""
    late = _stream(spark, d).select("at", "row_id", F.col("level").cast("string").alias("digest"))
    value = F.col("quantity").cast("double").cast("string")
    stored = facts(spark, d).filter("row_id % 6 <> 0").select(F.col("event_time").alias("at"), "row_id", F.when(F.col("row_id") % 4 == 0, "old").otherwise(value).alias("digest"))
    buckets = Buckets(spark, "at timestamp, row_id bigint, digest string", "at", 86_400)
    buckets.write(stored, 0)
    return jobs.late_buckets(late, buckets, ["row_id"], "digest").select("row_id", "action")


@query("feed_steps", "SELECT event_id AS row_id FROM events WHERE date_trunc('hour', ts) < (SELECT max(ts) - INTERVAL 2 HOURS FROM events)")
def feed_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events by their hour as write time, so that caps part rows of one time: a third of them a step, until none is left."""
    f = facts(spark, d).select(F.date_trunc("hour", "event_time").alias("written"), "row_id")
    n = f.count()
    last = facts(spark, d).agg(F.max("event_time")).first()[0]
    feed = Feed(spark, "written timestamp, row_id bigint", "written", "row_id", 7200, 3600, n // 3 + 1)
    while not feed.step(f, F.lit(last)).isEmpty():
        pass
    return feed.told().select("row_id")


@query("stream_gated_rules", "WITH t AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'incomplete' ELSE 'success' END AS status, event_id % 3 = 0 AS sealed FROM events) SELECT 'open' AS rule, 'open:' || event_id AS key FROM t WHERE status = 'error' OR status = 'incomplete' AND sealed")
def stream_gated_rules(spark: SparkSession, d: str) -> DataFrame:
    """Incomplete transactions are alerted on only when they are sealed."""
    status = F.when(F.col("method") == "error", "error").when(F.col("method") == "click", "incomplete").otherwise("success")
    s = _stream(spark, d).select("at", "row_id", "text", "method", status.alias("status"), (F.col("row_id") % 3 == 0).alias("sealed"))
    return jobs.run_to_table(jobs.match_rules(s, [{"name": "open", "statuses": ["error", "incomplete"]}]), "rules").select("rule", "key")


@query(
    "stream_sealed",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM g GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
)
def stream_sealed(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has passed."""
    return jobs.run_to_table(jobs.seal_stream(_stream(spark, d), "1 hour"), "sealed")


@query(
    "stream_sealed_transactions",
    """SELECT user_id || '-' || strftime(ts, '%Y%m%d%H') AS txn, count(*) AS n, bool_or(event_type IN ('purchase', 'error')) AS ended FROM events GROUP BY 1
HAVING max(ts) + CASE WHEN bool_or(event_type IN ('purchase', 'error')) THEN INTERVAL 900 SECONDS ELSE INTERVAL 3600 SECONDS END <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
)
def stream_sealed_transactions(spark: SparkSession, d: str) -> DataFrame:
    """A user's hour as a transaction, sealed by its status."""
    txn = F.concat_ws("-", "user_id", F.date_format("at", "yyyyMMddHH"))
    s = _stream(spark, d).select(txn.alias("txn"), "at", F.col("method").isin("purchase", "error").alias("ends"))
    return jobs.run_to_table(jobs.seal_transactions(s), "sealed").select("txn", "n", "ended")


def conversation_lines(events: DataFrame) -> DataFrame:
    """Events (at, row_id, user_id, method) as lines of three busy servers."""
    kind = F.when(F.col("method") == "click", "request").when(F.col("method") == "purchase", "response").otherwise("info")
    user = F.when(F.col("row_id") % 4 != 0, F.concat(F.lit("U"), F.col("user_id")))
    rid = F.when(F.col("row_id") % 9 == 0, F.concat_ws("-", F.col("user_id"), F.date_format("at", "yyyyMMddHH")))
    return events.select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("server"), "row_id", "at", (F.col("user_id") % 5).cast("string").alias("thread"), user.alias("user_ctx"), kind.alias("entry_type"), rid.alias("request_id"))


@query("stream_stitched")
def stream_stitched(spark: SparkSession, d: str) -> DataFrame:
    """The lines that the watermark has passed, with their transactions, and how each transaction ended."""
    return jobs.run_to_table(stitching.stitch_stream(conversation_lines(_stream(spark, d))), "stitched")
