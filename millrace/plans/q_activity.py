"""Queries of activity, release statistics and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fields import json_field
from millrace.operators import activity as act
from millrace.operators import listing
from millrace.plans.base import calls, facts, orders
from millrace.plans.registry import query
from millrace.session import table


def _bagged(spark: SparkSession, d: str) -> DataFrame:
    """Facts with a map of fields: k from props, and a name that hangs on the row."""
    k = json_field("props", "k")
    bag = F.map_filter(F.create_map(F.lit("k"), k, F.lit("band"), F.floor(k.cast("int") / 10).cast("string")), lambda n, _: (n == "k") | (F.col("row_id") % 3 == 0))
    return facts(spark, d).withColumn("bag", bag)


_BAG = """kv AS (SELECT event_id, ts, event_type AS method, 'k' AS field, props->>'$.k' AS value FROM events UNION ALL
SELECT event_id, ts, event_type, 'band', ((props->>'$.k')::INT // 10)::VARCHAR FROM events WHERE event_id % 3 = 0)"""


@query(
    "field_profile",
    f"""WITH {_BAG} SELECT method, field, count(*) AS n, count(DISTINCT value) AS distinct, grouping(method)::INT AS over_methods,
CASE WHEN count(*) < 20 THEN 'unknown' WHEN count(DISTINCT value) <= 1 OR count(DISTINCT value) > count(*) * 0.5 THEN 'no' ELSE 'yes' END AS worth FROM kv GROUP BY GROUPING SETS ((method, field), (field))""".replace("AS distinct", 'AS "distinct"'),
)
def field_profile(spark: SparkSession, d: str) -> DataFrame:
    return act.field_profile(_bagged(spark, d), "bag").withColumn("worth", act.worth_grouping(F.col("n"), F.col("distinct")))


@query(
    "overview_of_scope",
    """SELECT 'method' AS dimension, event_type AS value, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 2
UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*), strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events GROUP BY 2""",
)
def overview_of_scope(spark: SparkSession, d: str) -> DataFrame:
    return act.overview(facts(spark, d), ["method", "user_id"], "event_time")


@query(
    "adhoc_aggregate",
    """WITH g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS errors, sum(o_totalprice::DECIMAL(20,6))::DOUBLE AS sum_total FROM orders GROUP BY 1, 2)
SELECT *, count(*) OVER () AS groups_total, sum(n) OVER ()::BIGINT AS rows_total FROM g ORDER BY n DESC, o_orderpriority, o_orderstatus LIMIT 10""",
)
def adhoc_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return act.aggregate(orders(spark, d), ["o_orderpriority", "o_orderstatus"], ["total"], F.col("total") > 300000, "n", 10)


@query(
    "activity_weekly",
    """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M') AS bucket, count(DISTINCT user_id) AS users, count(DISTINCT props) AS devices, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1""",
)
def activity_weekly(spark: SparkSession, d: str) -> DataFrame:
    return act.activity(facts(spark, d), "week", "event_time", "user_id", "props", F.col("method") == "error")


_HOURS = ", ".join(f"count(*) FILTER (event_type IS NOT NULL AND hour(ts) = {h}) AS h{h:02d}" for h in range(24))


@query(
    "day_hour_matrix",
    f"""WITH s AS (SELECT unnest(range(DATE '2024-01-25', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day) SELECT strftime(day, '%Y-%m-%d') AS day, {_HOURS} FROM s LEFT JOIN events ON ts::DATE = day GROUP BY 1""",
)
def day_hour_matrix(spark: SparkSession, d: str) -> DataFrame:
    return act.day_hour_matrix(facts(spark, d), "event_time", "2024-01-25", "2024-02-03")


@query(
    "user_day_grid",
    """WITH g AS (SELECT user_id AS user, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'signup') AS logins, count(*) FILTER (event_type <> 'signup') AS rows FROM events GROUP BY 1, 2),
t AS (SELECT user, sum(logins + rows)::BIGINT AS total FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) SELECT g.user, day, logins, rows, total FROM g JOIN t USING (user)""".replace("AS user,", 'AS "user",').replace("SELECT user,", 'SELECT "user",').replace("g.user,", 'g."user",').replace("(user)", '("user")'),
)
def user_day_grid(spark: SparkSession, d: str) -> DataFrame:
    return act.user_day_grid(facts(spark, d), "user_id", "event_time", F.col("method") == "signup", 12)


@query(
    "nearest_rank_p95",
    """WITH r AS (SELECT event_type AS method, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT method, min(value) AS p95 FROM r WHERE i >= ceil(n * 0.95) GROUP BY 1""",
)
def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    """By position, not by interpolation; a method's values are ranked in its own window, not gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy("method")
    r = facts(spark, d).withColumn("i", F.row_number().over(w.orderBy("quantity"))).withColumn("n", F.count("*").over(w))
    return r.filter("i >= ceil(n * 0.95D)").groupBy("method").agg(F.min("quantity").cast("double").alias("p95"))


@query(
    "duration_bands",
    """WITH s AS (SELECT epoch(max(l_shipdate) - min(l_shipdate)) / 86400 AS days FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN days < 10 THEN '<10' WHEN days < 50 THEN '10-50' WHEN days < 100 THEN '50-100' ELSE '>=100' END AS band, count(*) AS n FROM s GROUP BY 1""",
)
def duration_bands(spark: SparkSession, d: str) -> DataFrame:
    s = calls(spark, d).groupBy("order_key").agg((F.unix_timestamp(F.max("event_time")) - F.unix_timestamp(F.min("event_time"))).alias("s"))
    return act.duration_bands(s, F.col("s") / 86400, [10, 50, 100])


@query(
    "buckets_back",
    """WITH k AS (SELECT DISTINCT event_type AS method FROM events), s AS (SELECT method, unnest(range(0, 8)) AS bucket FROM k),
g AS (SELECT event_type AS method, floor((epoch(date_trunc('second', ts)) - (epoch(TIMESTAMP '2024-01-31 12:00:00') - 8 * 21600)) / 21600)::BIGINT AS bucket, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY 1, 2)
SELECT method, bucket, coalesce(n, 0) AS n, coalesce(people, 0) AS people FROM s LEFT JOIN g USING (method, bucket)""",
)
def buckets_back(spark: SparkSession, d: str) -> DataFrame:
    return act.buckets_back(facts(spark, d), "event_time", "2024-01-31 12:00:00", 8, 21600, "method", "user_id")


@query(
    "baseline_at",
    """SELECT round(sum(CASE WHEN hour(ts) < 14 THEN 1.0 WHEN hour(ts) = 14 THEN 0.5 ELSE 0 END)::DOUBLE / 7, 6) AS usual FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20'""",
)
def baseline_at(spark: SparkSession, d: str) -> DataFrame:
    return act.baseline_at(facts(spark, d), "event_time", "2024-01-20 14:30:00", 7)


_COMPARED = """c AS (SELECT r_name AS site, coalesce(sum(o_totalprice::DECIMAL(20,6)) FILTER (o_orderdate >= TIMESTAMP '1998-01-01'), 0)::DOUBLE AS now, coalesce(sum(o_totalprice::DECIMAL(20,6)) FILTER (o_orderdate < TIMESTAMP '1998-01-01'), 0)::DOUBLE AS before
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1), e AS (SELECT *, CASE WHEN before <> 0 THEN round((now - before) / before, 6) END AS delta FROM c)"""


def _sites(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return act.period_compare(o.withColumnRenamed("r_name", "site"), "at", F.col("total"), ["site"], "1998-01-01", "1999-01-01")


@query("period_compare", f"WITH {_COMPARED} SELECT * FROM e")
def period_compare(spark: SparkSession, d: str) -> DataFrame:
    return _sites(spark, d)


@query("what_changed", f"WITH {_COMPARED} SELECT *, CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction FROM e WHERE abs(delta) >= 0.001")
def what_changed(spark: SparkSession, d: str) -> DataFrame:
    return act.what_changed(_sites(spark, d), 0.001)


@query(
    "observe_fields",
    f"""WITH {_BAG} SELECT method, field, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS seen_count, CASE WHEN field = 'k' AND count(*) FILTER (ts < TIMESTAMP '2024-01-15') > 0 THEN 'approved' END AS decision FROM kv GROUP BY 1, 2""",
)
def observe_fields(spark: SparkSession, d: str) -> DataFrame:
    f = _bagged(spark, d)
    early = F.col("event_time") < F.lit("2024-01-15").cast("timestamp")
    none = spark.createDataFrame([], "method string, field string, first_seen timestamp, last_seen timestamp, seen_count bigint, decision string")
    stored = act.observe(none, f.filter(early), "bag", "event_time").withColumn("decision", F.when(F.col("field") == "k", "approved"))
    got = act.observe(stored, f.filter(~early), "bag", "event_time")
    return got.select("method", "field", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")], "seen_count", "decision")


@query("registry_summary", f"WITH {_BAG}, r AS (SELECT method, field, count(*) AS n FROM kv GROUP BY 1, 2) SELECT count(*) AS names, count(*) FILTER (n > 50) AS busy, count(*) FILTER (field = 'k') AS plain FROM r")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    r = _bagged(spark, d).select("method", F.explode(F.map_keys("bag")).alias("field")).groupBy("method", "field").agg(F.count("*").alias("n"))
    return r.agg(F.count("*").alias("names"), F.count_if(F.col("n") > 50).alias("busy"), F.count_if(F.col("field") == "k").alias("plain"))


@query("capture_unknown", f"WITH {_BAG} SELECT method, field, count(*) AS n FROM kv WHERE method <> 'signup' AND field NOT IN ('k') GROUP BY 1, 2")
def capture_unknown(spark: SparkSession, d: str) -> DataFrame:
    f = _bagged(spark, d)
    return act.apply_capture(f, "bag", f.filter("method = 'signup'").select("method").distinct(), ["k"])[1]


@query("freshness", "SELECT (epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts))))::BIGINT AS lag_s, round(avg(CASE WHEN value > 10 THEN 0.0 ELSE 1.0 END), 6) AS open_share, 1 AS stale FROM events")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return act.freshness(facts(spark, d), "event_time", F.col("quantity") > 10, "2024-02-01")


_KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    "shape_of_day",
    f"""WITH h AS (SELECT unnest(range(0, 24))::INT AS hour), g AS (SELECT hour(ts)::INT AS hour, count(DISTINCT user_id) AS people, count(*) AS n, {", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS)} FROM events GROUP BY 1),
f AS (SELECT h.hour, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("people", "n", *_KINDS))} FROM h LEFT JOIN g USING (hour)) SELECT *, (hour = (SELECT hour FROM f ORDER BY n DESC, hour LIMIT 1))::INT AS is_peak FROM f""",
)
def shape_of_day(spark: SparkSession, d: str) -> DataFrame:
    return act.shape_of_day(facts(spark, d), "event_time", "method", "user_id", list(_KINDS))


@query(
    "zone_activity",
    """WITH p AS (SELECT l_suppkey, count(*) FILTER (l_quantity > 5) AS picks, count(*) FILTER (l_quantity <= 5) AS z FROM lineitem GROUP BY 1)
SELECT s_nationkey AS zone, sum(picks)::BIGINT AS picks, sum(z)::BIGINT AS zero_picks, count(*) AS places FROM p LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
)
def zone_activity(spark: SparkSession, d: str) -> DataFrame:
    picked = F.greatest(F.col("quantity") - 5, F.lit(0))
    places = act.pick_activity(calls(spark, d), "l_suppkey", "l_partkey", picked, "event_time")
    zones = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("zone"))
    return act.by_zone(places, zones, "l_suppkey", "zone")


@query(
    "usage_by_role",
    "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_chars FROM conversations GROUP BY 1",
)
def usage_by_role(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


@query("newest_sample", "SELECT event_type AS method, arg_max(event_id, (ts, event_id)) AS row_id, 1 AS n_req FROM events GROUP BY 1")
def newest_sample(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("bag", F.create_map(F.lit("req.k"), json_field("props", "k"), F.lit("resp.v"), F.col("quantity").cast("string")))
    return act.newest_sample(f, "method", "bag", ["req"], F.struct("event_time", "row_id"))


@query("day_scope", "SELECT event_id FROM events WHERE (ts + INTERVAL 2 HOURS)::DATE = DATE '2024-01-10'")
def day_scope(spark: SparkSession, d: str) -> DataFrame:
    """A local day of a zone two hours ahead."""
    return listing.day_scope(facts(spark, d), "event_time", "2024-01-10", "+02:00").select(F.col("row_id").alias("event_id"))


@query("find_entities", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_partkey::VARCHAR, '1') OR contains(lower(p_name), '1') ORDER BY p_partkey LIMIT 50")
def find_entities(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that start with 1, names that hold it or not."""
    return listing.find(table(spark, d, "part"), "p_partkey", "p_name", "1", 50).select("p_partkey", "p_name")


@query("page_with_total", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 15 OFFSET 30")
def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """The total comes from an aggregate of its own, so the page needs no window over all rows."""
    day = orders(spark, d).filter("at >= TIMESTAMP '2000-01-01'")
    page = day.orderBy("at", "o_orderkey").offset(30).limit(15)
    return page.withColumn("total", F.lit(day.count()).cast("bigint")).select("o_orderkey", "total")
