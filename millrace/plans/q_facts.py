"""Queries of folds, settlements and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import roles
from millrace.functions.fields import json_field, outcome
from millrace.operators import fold, lookup, read, settle
from millrace.plans.base import calls, facts, orders
from millrace.plans.registry import query
from millrace.session import table, tasks_for

REVENUE = fold.Metric(
    "revenue",
    (
        fold.Measure("net", "stats", "price", minus="discount"),
        fold.Measure("lines", "count"),
        fold.Measure("returned", "sum", "quantity", where="l_returnflag = 'R'"),
    ),
    ("l_returnflag",),
)
def _revenue_sql(bucket: str) -> str:
    return f"""
WITH g AS (SELECT {bucket} AS bucket, l_returnflag AS dim1, count(*) AS c, count(*) FILTER (l_returnflag = 'R') AS r,
 sum(l_extendedprice::DECIMAL(20,6) - l_discount::DECIMAL(20,6))::DOUBLE AS net,
 coalesce(sum(l_quantity::DECIMAL(20,6)) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS ret FROM lineitem GROUP BY 1, 2)
SELECT bucket, dim1, 'net' AS measure, c AS n, net AS sum FROM g UNION ALL
SELECT bucket, dim1, 'lines', c, NULL FROM g UNION ALL
SELECT bucket, dim1, 'returned', r, ret FROM g WHERE r > 0"""


def _short(cells: DataFrame) -> DataFrame:
    total = F.when(F.col("measure") != "lines", F.col("sum"))
    return fold.finished(cells).select("bucket", "dim1", "measure", "n", total.alias("sum"))


@query("fold_daily", _revenue_sql("strftime(l_shipdate, '%Y-%m-%d')"))
def fold_daily(spark: SparkSession, d: str) -> DataFrame:
    return _short(fold.rollup(calls(spark, d), REVENUE))


@query("cascade_monthly", _revenue_sql("strftime(date_trunc('month', l_shipdate), '%Y-%m-%d')"))
def cascade_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _short(fold.cascade(fold.rollup(calls(spark, d), REVENUE), "monthly"))


VALUES = fold.Metric("values", (fold.Measure("value", "percentile", "quantity"), fold.Measure("users", "distinct", "user_id"), fold.Measure("level", "latest", "quantity")), ("method",))


@query(
    "rollup_hourly_latest",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS bucket, event_type AS dim1, count(value) AS n,
 arg_max(value, (ts, event_id))::DECIMAL(20,6)::DOUBLE AS latest, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS latest_at FROM events GROUP BY 1, 2""",
)
def rollup_hourly_latest(spark: SparkSession, d: str) -> DataFrame:
    got = fold.finished(fold.rollup(facts(spark, d), VALUES, "hourly"))
    return got.filter("measure = 'level'").select("bucket", "dim1", "n", "latest", "latest_at")


@query(
    "day_from_hours_histogram",
    """WITH b AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type AS dim1, CASE WHEN floor(value) <= 0 THEN 0 ELSE least(length(bin(floor(value)::BIGINT)), 19) END AS band FROM events)
SELECT bucket, dim1, band, count(*) AS n FROM b GROUP BY ALL""",
)
def day_from_hours_histogram(spark: SparkSession, d: str) -> DataFrame:
    cells = fold.cascade(fold.rollup(facts(spark, d), VALUES, "hourly"), "daily").filter("measure = 'value'")
    return cells.select("bucket", "dim1", F.posexplode("histogram").alias("band", "n")).filter("n > 0")


@query(
    "band_percentile",
    """WITH b AS (SELECT l_returnflag AS dim1, CASE WHEN floor(l_quantity) <= 0 THEN 0 ELSE least(length(bin(floor(l_quantity)::BIGINT)), 19) END AS band FROM lineitem),
h AS (SELECT dim1, band, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w - n AS seen, sum(n) OVER (PARTITION BY dim1) AS t FROM h WINDOW w AS (PARTITION BY dim1 ORDER BY band))
SELECT dim1, round(min_by(CASE WHEN band = 0 THEN 0 ELSE power(2, band - 1) END + (power(2, band) - CASE WHEN band = 0 THEN 0 ELSE power(2, band - 1) END) * (t * 0.95 - seen) / n, band), 6) AS p95
FROM c WHERE seen + n >= t * 0.95 GROUP BY dim1""",
)
def band_percentile(spark: SparkSession, d: str) -> DataFrame:
    m = fold.Metric("q", (fold.Measure("q", "percentile", "quantity"),), ("l_returnflag",))
    cells = fold.merged(fold.rollup(calls(spark, d), m), ["dim1"])
    return cells.select("dim1", F.round(roles.percentile_of(F.col("histogram"), 0.95), 6).alias("p95"))


@query(
    "distinct_within_error",
    "SELECT event_type AS method, count(DISTINCT user_id) AS exact, 1 AS close FROM events GROUP BY 1",
)
def distinct_within_error(spark: SparkSession, d: str) -> DataFrame:
    hourly = fold.rollup(facts(spark, d), VALUES, "hourly").filter("measure = 'users'")
    est = fold.merged(hourly, ["dim1"]).select(F.col("dim1").alias("method"), roles.distinct_of(F.col("sketch")).alias("est"))
    exact = facts(spark, d).groupBy("method").agg(F.count_distinct("user_id").alias("exact"))
    return exact.join(est, "method").select("method", "exact", (F.abs(F.col("est") - F.col("exact")) <= F.greatest(F.col("exact") * 0.06, F.lit(2))).cast("int").alias("close"))


@query(
    "stats_variance",
    """SELECT l_returnflag AS dim1, count(*) AS n, round(var_pop(l_quantity), 4) AS var, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1""",
)
def stats_variance(spark: SparkSession, d: str) -> DataFrame:
    m = fold.Metric("s", (fold.Measure("q", "stats", "quantity"),), ("l_returnflag",))
    got = fold.finished(fold.merged(fold.rollup(calls(spark, d), m), ["dim1"]).withColumn("bucket", F.lit("all")))
    return got.select("dim1", "n", F.round("var", 4).alias("var"), F.round("avg", 6).alias("avg"), "min", "max")


@query(
    "refold_dirty",
    _revenue_sql("strftime(l_shipdate, '%Y-%m-%d')"),
)
def refold_dirty(spark: SparkSession, d: str) -> DataFrame:
    """Cells folded from older facts, mended only in the buckets that the change touches."""
    now = calls(spark, d)
    moved = (F.col("order_key") % 10 == 3)
    old = now.withColumn("event_time", F.when(moved, F.col("event_time") + F.expr("INTERVAL 3 DAYS")).otherwise(F.col("event_time")))
    changed = old.filter(moved).select(F.col("event_time").alias("old_at"), (F.col("event_time") - F.expr("INTERVAL 3 DAYS")).alias("new_at"))
    dirty = fold.dirty_buckets(changed, "old_at", "new_at", "daily")
    return _short(fold.refold(fold.rollup(old, REVENUE), now, REVENUE, dirty))


@query(
    "breakdown_top",
    """SELECT l_partkey::VARCHAR AS dim1, sum(l_quantity) AS sum, count(*) AS n, sum(l_quantity) AS rank FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def breakdown_top(spark: SparkSession, d: str) -> DataFrame:
    m = fold.Metric("q", (fold.Measure("q", "sum", "quantity"),), ("l_partkey",))
    return fold.breakdown(fold.rollup(calls(spark, d), m, "monthly", tasks=tasks_for(table(spark, d, "lineitem"))), "dim1", 20, "q")


@query(
    "two_tier_read",
    """SELECT strftime(ts, '%Y-%m-%d') AS bucket, event_type AS dim1, count(value) AS n, sum(value::DECIMAL(20,6))::DOUBLE AS sum FROM events
WHERE ts >= TIMESTAMP '2024-01-03 05:30:00' AND ts < TIMESTAMP '2024-01-25 17:00:00' GROUP BY 1, 2""",
)
def two_tier_read(spark: SparkSession, d: str) -> DataFrame:
    m = fold.Metric("v", (fold.Measure("v", "sum", "quantity"),), ("method",))
    f = facts(spark, d)
    start, end, settled = datetime(2024, 1, 3, 5, 30), datetime(2024, 1, 25, 17), datetime(2024, 1, 20, 9)
    plan = read.plan_read(start, end, settled, read.choose_grain(start, end, 5))
    return fold.finished(read.two_tier(fold.rollup(f, m), f, m, plan)).select("bucket", "dim1", "n", "sum")


@query(
    "metric_preview",
    """SELECT unnest(['net', 'lines', 'returned', 'dim:l_returnflag']) AS measure, unnest([count(*), count(*), count(*) FILTER (l_returnflag = 'R'), count(*)]) AS matches,
 unnest([count(l_extendedprice), count(*), count(l_quantity) FILTER (l_returnflag = 'R'), count(nullif(trim(l_returnflag), ''))]) AS present,
 unnest([count(l_extendedprice), count(*), count(l_quantity) FILTER (l_returnflag = 'R'), count(nullif(trim(l_returnflag), ''))]) AS numeric FROM lineitem""",
)
def metric_preview(spark: SparkSession, d: str) -> DataFrame:
    return fold.preview(calls(spark, d), REVENUE)


@query(
    "combos_per_hour",
    """WITH h AS (SELECT date_trunc('hour', ts), count(DISTINCT (event_type, user_id)) AS n FROM events GROUP BY 1)
SELECT max(n) AS most, round(avg(n), 6) AS mean, quantile_cont(n, 0.95) AS p95 FROM h""",
)
def combos_per_hour(spark: SparkSession, d: str) -> DataFrame:
    got = fold.combos_per_hour(facts(spark, d), ["method", "user_id"], "event_time")
    return got.select("most", F.round("mean", 6).alias("mean"), "p95")


RELEASE = settle.Settlement(
    "release",
    ("order_key",),
    (
        settle.Value("expected", "first", "quantity"),
        settle.Value("picked", "sum", "quantity", where="l_returnflag = 'N'"),
        settle.Value("refused", "count", where="l_returnflag = 'R'"),
        settle.Value("parts", "distinct_count", "l_partkey"),
        settle.Value("last_flag", "last_text", "l_linestatus"),
        settle.Value("dearest", "max", "price"),
        settle.Value("shortfall", "difference", left="picked", right="expected"),
        settle.Value("is_short", "flag", left="shortfall", op="<", right_value=0.0),
        settle.Value("span_s", "difference", left="last_at", right="first_at"),
    ),
    row="line_id",  # line numbers repeat within an order
)
_SETTLED = """s AS (SELECT l_orderkey AS order_key, count(*) AS calls, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at,
 arg_min(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus)) AS expected, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS picked,
 count(*) FILTER (l_returnflag = 'R') AS refused, count(DISTINCT l_partkey) AS parts, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus)) AS last_flag,
 max(l_extendedprice) AS dearest FROM lineitem GROUP BY 1)"""


def _settled(spark: SparkSession, d: str) -> DataFrame:
    return settle.settle(calls(spark, d), RELEASE)


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[(F.col(c).cast("double") if t.startswith("decimal") else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t == "timestamp" else F.col(c)).alias(c) for c, t in df.dtypes])


@query(
    "settle_release",
    f"""WITH {_SETTLED} SELECT order_key, calls, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, expected, picked, refused, parts, last_flag, dearest,
 picked - expected AS shortfall, (picked - expected < 0)::INT AS is_short, epoch(last_at - first_at)::DOUBLE AS span_s FROM s""",
)
def settle_release(spark: SparkSession, d: str) -> DataFrame:
    return _plain(_settled(spark, d))


@query(
    "resettle_touched",
    f"""WITH {_SETTLED} SELECT order_key, calls, picked, refused FROM s""",
)
def resettle_touched(spark: SparkSession, d: str) -> DataFrame:
    rows = settle.dealt(calls(spark, d), RELEASE, tasks_for(table(spark, d, "lineitem")))
    stored = settle.settle(rows.filter("row_id <> 2"), RELEASE)
    return _plain(settle.resettle(stored, rows, rows.filter("row_id = 2"), RELEASE)).select("order_key", "calls", "picked", "refused")


@query(
    "settled_by_day",
    f"""WITH {_SETTLED} SELECT strftime(last_at, '%Y-%m-%d') AS day, count(*) AS n, sum(calls)::BIGINT AS calls, sum(picked) AS sum_picked, quantile_cont(picked - expected, 0.5) AS median_shortfall,
 quantile_cont(picked - expected, 0.9) AS p90_shortfall, count(DISTINCT expected) AS distinct_expected FROM s WHERE picked - expected < 10 GROUP BY 1""",
)
def settled_by_day(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("last_at", "yyyy-MM-dd").alias("day")
    return settle.read_grouped(_settled(spark, d), [day], ["picked"], [("median", "shortfall"), ("p90", "shortfall"), ("distinct", "expected")], ["shortfall<10"])


@query(
    "settled_with_overall",
    f"""WITH {_SETTLED} SELECT last_flag, count(*) AS n, sum(calls)::BIGINT AS calls, sum(picked) AS sum_picked, grouping(last_flag)::INT AS is_overall FROM s GROUP BY ROLLUP (last_flag)""",
)
def settled_with_overall(spark: SparkSession, d: str) -> DataFrame:
    return settle.with_overall(_settled(spark, d), "last_flag", ["picked"])


@query(
    "settled_extremes",
    f"""WITH {_SETTLED}, g AS (SELECT strftime(last_at, '%Y-%m') AS month, sum(picked) AS p FROM s GROUP BY 1)
SELECT arg_min(month, (p, month)) AS lowest, min(p) AS lowest_value, arg_max(month, (p, month)) AS highest, max(p) AS highest_value FROM g""",
)
def settled_extremes(spark: SparkSession, d: str) -> DataFrame:
    g = settle.read_grouped(_settled(spark, d), [F.date_format("last_at", "yyyy-MM").alias("month")], ["picked"])
    return settle.extremes(g, "month", "sum_picked")


@query(
    "list_settled",
    f"""WITH {_SETTLED} SELECT order_key, picked FROM s WHERE contains(order_key::VARCHAR, '12') ORDER BY picked DESC, picked::VARCHAR DESC, order_key::VARCHAR LIMIT 40 OFFSET 5""",
)
def list_settled(spark: SparkSession, d: str) -> DataFrame:
    rows = _plain(_settled(spark, d).withColumn("order_text", F.col("order_key").cast("string")))
    return settle.list_settled(rows, "12", ["order_text"], "picked", 40, 5).select("order_key", "picked")


@query(
    "explain_key",
    f"""WITH {_SETTLED}, k AS (SELECT max(order_key) AS k FROM s) SELECT l_linenumber AS row_id, l_quantity AS quantity, picked, calls FROM lineitem JOIN k ON l_orderkey = k JOIN s ON order_key = k""",
)
def explain_key(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d)
    top = rows.agg(F.max("order_key")).first()[0]
    own, row = settle.explain_key(rows, RELEASE, {"order_key": top})
    return own.join(row, "order_key").select("row_id", F.col("quantity").cast("double").alias("quantity"), F.col("picked").cast("double").alias("picked"), "calls")


@query(
    "release_outcomes",
    f"""WITH {_SETTLED} SELECT CASE WHEN picked = expected THEN 'exact' WHEN picked > expected THEN 'over' WHEN picked = 0 THEN 'zeroPick' WHEN picked < expected THEN 'partial' END AS outcome,
 count(*) AS n, sum(greatest(expected - picked, 0)) AS units_short, round(1 - sum(greatest(expected - picked, 0)) / sum(expected), 6) AS fill_rate FROM s GROUP BY 1""",
)
def release_outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = _settled(spark, d)
    short = F.greatest(F.col("expected") - F.col("picked"), F.lit(0)).cast("double")
    g = s.groupBy(outcome(F.col("expected"), F.col("picked")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(short).alias("units_short"), F.sum(F.col("expected").cast("double")).alias("e"))
    return g.select("outcome", "n", "units_short", F.round(1 - F.col("units_short") / F.col("e"), 6).alias("fill_rate"))


_PERIODS = """once AS (SELECT o_custkey AS key, o_orderdate AS seen, min(o_orderpriority) AS value, count(DISTINCT o_orderpriority) - 1 AS extra FROM orders GROUP BY 1, 2),
ch AS (SELECT *, CASE WHEN lag(value) OVER w IS DISTINCT FROM value THEN 1 ELSE 0 END AS change FROM once WINDOW w AS (PARTITION BY key ORDER BY seen)),
run AS (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY seen) AS run FROM ch),
per AS (SELECT key, run, min(value) AS value, min(seen) AS f, sum(extra)::BIGINT AS conflicts FROM run GROUP BY 1, 2),
periods AS (SELECT key, value, CASE WHEN run = 1 THEN '1970-01-01 00:00:00' ELSE strftime(f, '%Y-%m-%d %H:%M:%S') END AS valid_from,
 strftime(lead(f) OVER (PARTITION BY key ORDER BY run), '%Y-%m-%d %H:%M:%S') AS valid_to, conflicts FROM per)"""


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return lookup.build_validity(orders(spark, d), "o_custkey", "o_orderpriority", "at")


@query("validity_periods", f"WITH {_PERIODS} SELECT * FROM periods")
def validity_periods(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return _periods(spark, d).select("key", "value", text("valid_from"), text("valid_to"), "conflicts")


@query(
    "lookup_as_of",
    f"""WITH {_PERIODS} SELECT o_orderkey, value AS held FROM orders LEFT JOIN periods ON key = o_custkey
 AND valid_from <= strftime(o_orderdate + INTERVAL 10 DAYS, '%Y-%m-%d %H:%M:%S') AND (valid_to IS NULL OR strftime(o_orderdate + INTERVAL 10 DAYS, '%Y-%m-%d %H:%M:%S') < valid_to)""",
)
def lookup_as_of(spark: SparkSession, d: str) -> DataFrame:
    later = F.col("at") + F.expr("INTERVAL 10 DAYS")
    return lookup.as_of_disjoint(orders(spark, d), _periods(spark, d), "o_custkey", later, "held").select("o_orderkey", "held")


@query(
    "lookup_all_values",
    "SELECT o_custkey AS key, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS value FROM orders GROUP BY 1",
)
def lookup_all_values(spark: SparkSession, d: str) -> DataFrame:
    return lookup.build_validity(orders(spark, d), "o_custkey", "o_orderpriority", "at", "all_values").select("key", "value")


@query(
    "group_by_lookup",
    """SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS bucket, p_brand AS "group", count(*) AS n, sum(l_quantity) AS sum FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
)
def group_by_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = fold.Metric("q", (fold.Measure("q", "sum", "quantity"),), ("l_partkey",))
    got = lookup.group_by_lookup(fold.rollup(calls(spark, d), m, "monthly", tasks=tasks_for(table(spark, d, "lineitem"))), table(spark, d, "part"), "dim1", "p_partkey", "p_brand")
    return got.select("bucket", "group", F.col("count_value").alias("n"), F.col("sum_value").cast("double").alias("sum"))


@query(
    "nearby_errors",
    """SELECT a.event_id AS key_id, count(b.event_id) AS nearby FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'error'
 AND b.ts >= a.ts - INTERVAL 1 HOUR AND b.ts <= a.ts WHERE a.event_type = 'purchase' GROUP BY 1""",
)
def nearby_errors(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    keys = f.filter("method = 'purchase'").select(F.col("row_id").alias("key_id"), "user_id", F.col("event_time").alias("first_at"), F.col("event_time").alias("last_at"))
    errors = f.filter("method = 'error'").select("user_id", F.col("event_time").alias("at"))
    return lookup.nearby(keys, errors, ["user_id"], 3600).select("key_id", "nearby")


@query(
    "suggest_sources",
    """WITH kv AS (SELECT unnest(['cust', 'status', 'order']) AS field, unnest([o_custkey::VARCHAR, o_orderstatus, o_orderkey::VARCHAR]) AS value FROM orders)
SELECT field, count(*) AS n, count(c_custkey) AS known, (count(c_custkey) >= count(*) * 0.9)::INT AS suggested FROM kv LEFT JOIN customer ON c_custkey::VARCHAR = value GROUP BY 1""",
)
def suggest_sources(spark: SparkSession, d: str) -> DataFrame:
    bag = F.create_map(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("order"), F.col("o_orderkey").cast("string"))
    return lookup.suggest_sources(orders(spark, d).select(bag.alias("bag")), "bag", table(spark, d, "customer").select("c_custkey"))


@query("number_fields", """SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k, 0 AS missing FROM events""")
def number_fields(spark: SparkSession, d: str) -> DataFrame:
    from millrace.functions.fields import number_or_null

    got = facts(spark, d)
    return got.select(F.col("row_id").alias("event_id"), number_or_null(json_field("props", "k")).cast("double").alias("k"), number_or_null(json_field("props", "zz")).isNotNull().cast("int").alias("missing"))


@query(
    "refold_concerned",
    """WITH f AS (SELECT *, l_returnflag = 'A' AND l_orderkey % 10 = 0 AS moved FROM lineitem), now AS (SELECT CASE WHEN moved THEN l_quantity + 1 ELSE l_quantity END AS q, l_returnflag FROM f)
SELECT 'returned' AS metric, 1 AS skipped, sum(q) AS total FROM now WHERE l_returnflag = 'R' UNION ALL SELECT 'all', 0, sum(q) FROM now""",
)
def refold_concerned(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the calls with flag A gets another quantity: the metric of returned calls is not folded again."""
    old = calls(spark, d)
    moved = (F.col("l_returnflag") == "A") & (F.col("order_key") % 10 == 0)
    new = old.withColumn("quantity", F.when(moved, F.col("quantity") + 1).otherwise(F.col("quantity")).cast("decimal(20,6)"))
    metrics = [fold.Metric("returned", (fold.Measure("q", "sum", "quantity", where="l_returnflag = 'R'"),)), fold.Metric("all", (fold.Measure("q", "sum", "quantity"),))]
    stored = {m.name: fold.rollup(old, m, "monthly") for m in metrics}
    cells, skipped = fold.refold_concerned(stored, new, old.filter(moved).unionByName(new.filter(moved)), metrics, "monthly")
    parts = [c.agg(F.sum("sum_value").cast("double").alias("total")).select(F.lit(n).alias("metric"), F.lit(int(n in skipped)).alias("skipped"), "total") for n, c in cells.items()]
    return parts[0].unionByName(parts[1])
