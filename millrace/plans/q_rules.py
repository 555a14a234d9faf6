"""Queries of rules that stand behind the others: fields, lookups, profiles, pages, findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fields as ff
from millrace.functions import roles
from millrace.operators import fold, listing, lookup, risk, settle
from millrace.operators import forecast as fc
from millrace.plans.base import calls, facts, orders
from millrace.plans.q_facts import _SETTLED, _plain, _settled
from millrace.plans.q_forecast import _BOARD, _JUDGED, _NOW, _board, _judged, _tier_sql
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import logs
from millrace.streaming import jobs

# ---- fields


@query(
    "field_paths",
    """SELECT event_id, event_type AS typed, props->>'$.k' AS in_bag, props->>'$.k' AS in_map, NULL::VARCHAR AS missing FROM events""",
)
def field_paths(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("attributes", F.from_json("props", "map<string,string>"))
    typed = {"method", "quantity"}
    return f.select(F.col("row_id").alias("event_id"), ff.field("method", typed).alias("typed"), ff.json_field("props", "k").alias("in_bag"), ff.field("k", typed).alias("in_map"), ff.field("zz", typed).alias("missing"))


def _block(k: str, v: str) -> str:
    return f"concat('note', chr(10), '{k} :  ', {v}, chr(10), 'noise', chr(10), 'ITNO = ', {v} % 7, chr(10), '{k} : ', {v} + 1)"


@query("kv_blocks", "SELECT o_orderkey, (o_orderkey + 1)::VARCHAR AS cono, (o_orderkey % 7)::VARCHAR AS itno, 2 AS n_keys, 2 AS records, (o_custkey)::VARCHAR AS second FROM orders")
def kv_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = ff.kv_block(F.expr(_block("CONO", "o_orderkey").replace("chr(10)", "char(10)")))
    recs = ff.record_blocks(F.expr("concat('CONO : 1', char(10), 'Record: 1', char(10), 'A = x', char(10), 'Record: 2', char(10), 'A = ', o_custkey)"))
    return orders(spark, d).select("o_orderkey", m["CONO"].alias("cono"), m["ITNO"].alias("itno"), F.size(m).alias("n_keys"), F.size(recs).alias("records"), F.get(recs, F.lit(1))["A"].alias("second"))


@query("exploded_records", "SELECT o_orderkey, unnest([0, 1]) AS record_index, unnest(['x', o_custkey::VARCHAR]) AS a FROM orders")
def exploded_records(spark: SparkSession, d: str) -> DataFrame:
    """A row per nested record."""
    recs = ff.record_blocks(F.expr("concat('CONO : 1', char(10), 'Record: 1', char(10), 'A = x', char(10), 'Record: 2', char(10), 'A = ', o_custkey)"))
    return orders(spark, d).select("o_orderkey", F.posexplode(recs).alias("record_index", "r")).select("o_orderkey", "record_index", F.col("r")["A"].alias("a"))


@query("promoted_names", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_custkey::VARCHAR END AS who FROM orders")
def promoted_names(spark: SparkSession, d: str) -> DataFrame:
    bag = F.create_map(F.lit("USER"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.col("o_custkey").cast("string")), F.lit("Usr"), F.col("o_orderstatus"))
    return orders(spark, d).select("o_orderkey", ff.promote(bag, ["user", "usr"]).alias("who"))


@query("namespaced_fields", "SELECT event_id, 'res.k' AS name, props->>'$.k' AS value FROM events WHERE props->>'$.k' <> ''")
def namespaced_fields(spark: SparkSession, d: str) -> DataFrame:
    bag = listing.namespaced(F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("empty"), F.lit(" "))), "res")
    return facts(spark, d).select(F.col("row_id").alias("event_id"), F.explode(bag).alias("name", "value"))


@query(
    "departures",
    """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS d, (o_orderkey % 30) * 100 + o_orderkey % 70 AS t FROM orders)
SELECT o_orderkey, CASE WHEN t // 100 < 24 AND t % 100 < 60 THEN strftime(strptime(d || lpad(t::VARCHAR, 4, '0'), '%Y%m%d%H%M') - INTERVAL 5 HOURS - INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M') END AS leaves FROM o""",
)
def departures(spark: SparkSession, d: str) -> DataFrame:
    """Digits of a clock half an hour off the full hours; 2460 or 2370 is no time."""
    t = (F.col("o_orderkey") % 30) * 100 + F.col("o_orderkey") % 70
    return orders(spark, d).select("o_orderkey", F.date_format(ff.departure_at(F.date_format("at", "yyyyMMdd"), t, "Asia/Kolkata"), "yyyy-MM-dd HH:mm").alias("leaves"))


@query("local_texts", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN strftime(date_trunc('minute', ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') END AS read FROM events")
def local_texts(spark: SparkSession, d: str) -> DataFrame:
    """Time text without a zone on a clock that is an hour ahead in January."""
    text = F.when(F.col("row_id") % 3 != 0, F.date_format("event_time", " yyyy-MM-dd'T'HH:mm")).otherwise("soon")
    return facts(spark, d).select(F.col("row_id").alias("event_id"), F.date_format(ff.parse_local(text, "Europe/Paris"), "yyyy-MM-dd HH:mm").alias("read"))


@query("package_pairs", "SELECT l_orderkey AS delivery, l_linenumber AS package, count(*) AS n FROM lineitem GROUP BY 1, 2")
def package_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JSON lists of deliveries and packages, and a broken one, as rows."""
    text = F.format_string('[{"DeliveryNumber":"%s","PackageNumber":"%s"}]', F.col("order_key"), F.col("row_id"))
    both = calls(spark, d).select(F.explode(F.array(text, F.lit("[broken"))).alias("j"))
    p = both.select(F.explode(ff.package_pairs(F.col("j"))).alias("p")).filter("p.DeliveryNumber IS NOT NULL")
    return p.groupBy(F.col("p.DeliveryNumber").cast("long").alias("delivery"), F.col("p.PackageNumber").cast("int").alias("package")).agg(F.count("*").alias("n"))


@query(
    "plain_labels",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DECIMAL(20,6)::VARCHAR AS raw, CASE WHEN contains(l_extendedprice::DECIMAL(20,6)::VARCHAR, '.') THEN rtrim(rtrim(l_extendedprice::DECIMAL(20,6)::VARCHAR, '0'), '.') END AS price, CASE WHEN length(l_shipmode) > 3 THEN left(l_shipmode, 2) || '…' ELSE l_shipmode END AS label FROM lineitem""".replace("l_shipmode", "l_linestatus"),
)
def plain_labels(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    return c.select(
        F.col("order_key").alias("l_orderkey"), F.col("row_id").alias("l_linenumber"), "l_partkey", F.col("quantity").cast("string").alias("raw"), ff.plain_number(F.col("price")).alias("price"), ff.cut_label(F.col("l_linestatus"), 3).alias("label")
    )


@query(
    "approvable_fields",
    "SELECT event_type || CASE event_id % 4 WHEN 0 THEN '_token' WHEN 1 THEN 'Password' WHEN 2 THEN '_count' ELSE '' END AS name, (event_id % 4 >= 2)::INT AS may, CASE WHEN event_id % 4 >= 2 THEN 1 ELSE 0 END AS kept, count(*) AS n FROM events GROUP BY ALL",
)
def approvable_fields(spark: SparkSession, d: str) -> DataFrame:
    """Names shaped like credentials are never approved on their own, and are dropped from bags."""
    k = F.col("row_id") % 4
    name = F.concat("method", F.when(k == 0, "_token").when(k == 1, "Password").when(k == 2, "_count").otherwise(""))
    kept = F.size(ff.drop_sensitive(F.create_map(name, F.lit("x"))))
    return facts(spark, d).groupBy(name.alias("name"), (~ff.is_sensitive(name)).cast("int").alias("may"), kept.alias("kept")).agg(F.count("*").alias("n"))


@query("conditions_of_orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_orderdate >= TIMESTAMP '1998-01-01'")
def conditions_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Conditions by text; the ones that contradict each other leave nothing."""
    asked = ["o_orderstatus=O", "total>=100000", "at>=1998-01-01"]
    o = orders(spark, d)
    got = settle.where(o, asked)
    again = settle.where(o, [*asked, "o_orderstatus=F"]) if not settle.contradictions([*asked, "o_orderstatus=F"]) else o.limit(0)
    return got.unionByName(again).select("o_orderkey")


# ---- entries


@query(
    "reclassified_entries",
    "SELECT event_id AS row_id, 'info' AS old_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'request' END AS entry_type FROM events WHERE event_type IN ('error', 'click')",
)
def reclassified_entries(spark: SparkSession, d: str) -> DataFrame:
    """Stored entries that an older parser took for narration."""
    f = facts(spark, d)
    stored = f.select(
        "row_id", F.col("event_time").alias("at"), F.lit("info").alias("entry_type"), F.lit(None).cast("string").alias("request_id"), F.lit(None).cast("string").alias("result_status"), F.lit(None).cast("string").alias("call"),
        F.when(F.col("method") == "error", "ERROR").otherwise("INFO").alias("level"), F.lit("Run").alias("method"), F.when(F.col("method") == "click", "REQUEST: x").otherwise("step").alias("message"),
    )
    return logs.reclassify(stored)[0].select("row_id", "old_type", "entry_type")


@query(
    "transactions_page",
    """WITH h AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 1 AND contains(lower(o_orderpriority), 'i') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01')
SELECT o_orderkey, (SELECT count(*) FROM h) AS total FROM h ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 10""",
)
def transactions_page(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).drop("total").withColumn("odd", F.col("o_custkey") % 2)
    return listing.query_page(
        o, [F.desc("at"), F.asc("o_orderkey")], 25, 10, equal={"o_orderstatus": "O", "odd": 1, "o_custkey": None}, like={"o_orderpriority": "I"}, at="at", since="1996-01-01", until="2001-01-01"
    ).select("o_orderkey", "total")


@query("entries_with_owner", "SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN 't' || user_id END AS txn FROM events WHERE event_type = 'error'")
def entries_with_owner(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    owned = f.filter("row_id % 4 <> 1").select("row_id", F.concat(F.lit("t"), "user_id").alias("txn"))
    got = listing.with_owner(listing.query_rows(f, {"method": "error"}), owned, "row_id", "txn")
    return got.select(F.col("row_id").alias("event_id"), "txn")


# ---- folds, settlements, lookups


@query(
    "window_totals",
    """SELECT 'value' AS measure, count(value) AS n, round(quantile_cont(value, 0.5), 0) >= 0 AS some FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
UNION ALL SELECT 'level', count(value), TRUE FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""",
)
def window_totals(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a window merged on their roles: a median from the merged bands, the last value of all."""
    m = fold.Metric("v", (fold.Measure("value", "percentile", "quantity"), fold.Measure("level", "latest", "quantity")), ("method",))
    cells = fold.rollup(facts(spark, d), m, "daily").filter("bucket >= '2024-01-05' AND bucket < '2024-01-20'")
    got = fold.totals(cells)
    some = F.when(F.col("measure") == "value", roles.percentile_of(F.col("histogram"), 0.5) >= 0).otherwise(F.col("latest.value").isNotNull())
    return got.select("measure", F.col("count_value").alias("n"), some.alias("some"))


@query("zero_rates", "SELECT l_returnflag AS dim1, round(count(*) FILTER (l_discount = 0) / count(*), 9) AS rate FROM lineitem GROUP BY 1")
def zero_rates(spark: SparkSession, d: str) -> DataFrame:
    m = fold.Metric("z", (fold.Measure("zeros", "count", where="discount = 0"), fold.Measure("all", "count")), ("l_returnflag",))
    cells = fold.merged(fold.rollup(calls(spark, d), m, "monthly"), ["dim1"])
    n = lambda k: F.max(F.when(F.col("measure") == k, F.col("count_value")))
    return cells.groupBy("dim1").agg(F.round(roles.zero_rate(n("zeros"), n("all")), 9).alias("rate"))


@query("level_breakdown", "SELECT l_returnflag AS dim1, sum(l_quantity) AS sum, count(*) AS n, round(sum(l_quantity) / count(*), 9) AS rank FROM lineitem GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 2")
def level_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """A level ranks by its mean."""
    m = fold.Metric("q", (fold.Measure("q", "avg", "quantity"),), ("l_returnflag",), levels=("quantity",))
    return fold.breakdown(fold.rollup(calls(spark, d), m, "monthly"), "dim1", 2, "q", level=True).withColumn("rank", F.round("rank", 9))


@query(
    "hours_to_local_days",
    """SELECT strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS bucket, event_type AS dim1, count(value) AS n, sum(value::DECIMAL(20,6))::DOUBLE AS sum FROM events GROUP BY 1, 2""",
)
def hours_to_local_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of a zone an hour ahead, from cells of UTC hours."""
    m = fold.Metric("v", (fold.Measure("v", "sum", "quantity"),), ("method",))
    cells = fold.cascade(fold.rollup(facts(spark, d), m, "hourly"), "daily", "Europe/Paris")
    return fold.finished(cells).select("bucket", "dim1", "n", "sum")


_CARRIED = settle.Settlement(
    "carried", ("o_custkey",), (settle.Value("orders", "count"), settle.Value("first_total", "first", "total"), settle.Value("status", "first_text", "o_orderstatus"), settle.Value("nation", "lookup", "nations", left="o_custkey"), settle.Value("held", "lookup", "priorities", left="o_custkey")),
    at="at", row="o_orderkey", carry=("clerk",),
)


@query(
    "settled_lookups",
    """WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE ' ' END AS clerk FROM orders), s AS (SELECT o_custkey, count(*) AS orders, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_total, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
 arg_min(clerk, (o_orderdate, o_orderkey)) FILTER (trim(clerk) <> '') AS clerk, min(o_orderdate) AS first_at FROM o GROUP BY 1),
p AS (SELECT o_custkey, min(o_orderpriority) AS held, o_orderdate FROM orders GROUP BY 1, 3)
SELECT s.o_custkey, orders, first_total, status, clerk, c_nationkey::VARCHAR AS nation, p.held FROM s LEFT JOIN customer ON c_custkey = s.o_custkey LEFT JOIN p ON p.o_custkey = s.o_custkey AND p.o_orderdate = s.first_at""",
)
def settled_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Carried fields, and values that lookups held when the key was first seen."""
    o = orders(spark, d).withColumn("clerk", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).otherwise(" "))
    nations = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("value"), F.lit(lookup.EPOCH).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    seen = {"nations": nations, "priorities": lookup.build_validity(o, "o_custkey", "o_orderpriority", "at")}
    return _plain(settle.settle(o, _CARRIED, seen)).select("o_custkey", "orders", "first_total", "status", "clerk", "nation", "held")


@query(
    "lookup_overlaps",
    """WITH p AS (SELECT o_custkey AS key, o_orderpriority || ':' || o_orderkey AS value, o_orderdate AS f, o_orderdate + to_days(((o_orderkey % 5) * 200 + 100)::INT) AS t FROM orders WHERE o_orderkey % 2 = 0),
h AS (SELECT o.o_orderkey, p.value, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY p.f DESC NULLS LAST, p.value DESC) AS r FROM orders o LEFT JOIN p ON p.key = o.o_custkey AND p.f <= o.o_orderdate AND o.o_orderdate < p.t)
SELECT o_orderkey, value AS held FROM h WHERE r = 1""",
)
def lookup_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Periods of one key that overlap: the one that starts last wins, and of those of one start the greater value."""
    o = orders(spark, d)
    days = ((F.col("o_orderkey") % 5) * 200 + 100).cast("int")
    periods = o.filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key"), F.concat_ws(":", "o_orderpriority", "o_orderkey").alias("value"), F.col("at").alias("valid_from"), (F.col("at") + F.make_dt_interval(days=days)).alias("valid_to"))
    return lookup.as_of(o, periods, "o_custkey", F.col("at"), "held").select("o_orderkey", "held")


@query(
    "nearby_kinds",
    """SELECT a.event_id AS key_id, count(DISTINCT b.event_type) AS kinds, (count(b.event_id) > 0)::INT AS has, arg_max(b.event_type, (b.ts, b.event_type)) AS last FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type <> 'purchase'
 AND b.ts >= a.ts - INTERVAL 2 HOURS AND b.ts <= a.ts WHERE a.event_type = 'purchase' GROUP BY 1""",
)
def nearby_kinds(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    keys = f.filter("method = 'purchase'").select(F.col("row_id").alias("key_id"), "user_id", F.col("event_time").alias("first_at"), F.col("event_time").alias("last_at"))
    seen = f.filter("method <> 'purchase'").select("user_id", F.col("event_time").alias("at"), "method")
    got = lambda how, name: lookup.nearby(keys, seen, ["user_id"], 7200, how, "method").select("key_id", F.col("nearby").alias(name))
    return got("distinct", "kinds").join(got("has", "has"), "key_id").join(got("last", "last"), "key_id")


# ---- releases, usage, quotas, digests

_RELEASES = f"""{_SETTLED}, r AS (SELECT s.*, o_orderpriority AS picker, o_custkey, CASE WHEN picked = expected THEN 'exact' WHEN picked > expected THEN 'over' WHEN picked = 0 THEN 'zero' ELSE 'partial' END AS k FROM s JOIN orders ON o_orderkey = order_key)"""


def _releases(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select(F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("picker"), "o_custkey")
    return _settled(spark, d).join(o, "order_key")


def _stats_sql(by: str) -> str:
    return f"""WITH {_RELEASES} SELECT {by}, count(*) AS n, count(*) FILTER (k = 'exact') AS exact, count(*) FILTER (k = 'over') AS over, count(*) FILTER (k = 'zero') AS zero_picks, count(*) FILTER (k = 'partial') AS partial,
 sum(greatest(expected - picked, 0)) AS units_short, CASE WHEN sum(expected) > 0 THEN round(1 - sum(greatest(expected - picked, 0)) / sum(expected), 6) END AS fill_rate FROM r GROUP BY 1"""


@query("releases_by_picker", _stats_sql("picker"))
def releases_by_picker(spark: SparkSession, d: str) -> DataFrame:
    return listing.release_stats(_releases(spark, d), [F.col("picker")])


@query("releases_by_customer", _stats_sql("o_custkey"))
def releases_by_customer(spark: SparkSession, d: str) -> DataFrame:
    return listing.release_stats(_releases(spark, d), [F.col("o_custkey")])


@query("releases_by_delivery", _stats_sql("order_key"))
def releases_by_delivery(spark: SparkSession, d: str) -> DataFrame:
    return listing.release_stats(_releases(spark, d), [F.col("order_key")])


@query("zero_feed", f"WITH {_RELEASES} SELECT order_key FROM r WHERE k = 'zero' ORDER BY last_at DESC, order_key LIMIT 30")
def zero_feed(spark: SparkSession, d: str) -> DataFrame:
    return listing.zero_feed(_releases(spark, d), [F.desc("last_at"), F.asc("order_key")], 30).select("order_key")


@query("usage_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS questions, count(DISTINCT user_id) AS people FROM events WHERE event_type = 'view' GROUP BY 1")
def usage_by_day(spark: SparkSession, d: str) -> DataFrame:
    return listing.usage(facts(spark, d).filter("method = 'view'"), "user_id", F.date_format("event_time", "yyyy-MM-dd"))


@query("top_askers", "SELECT user_id, count(*) AS questions FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_askers(spark: SparkSession, d: str) -> DataFrame:
    return listing.top_askers(facts(spark, d).filter("method = 'view'"), "user_id", 10)


@query(
    "quota_limits",
    """WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS u, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS t FROM events)
SELECT event_id, CASE WHEN u > 1 THEN 'user' ELSE 'tenant' END AS "limit" FROM r WHERE u > 1 OR t > 2""",
)
def quota_limits(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import diff

    return diff.over_quota(facts(spark, d), "user_id", "event_time", "row_id", 1, "method", 2).select(F.col("row_id").alias("event_id"), "limit")


@query(
    "hourly_cap_notices",
    """WITH r AS (SELECT event_type, date_trunc('hour', ts) AS h, event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)
SELECT event_type AS method, count(*) AS held_back, count(DISTINCT h) AS notices FROM r WHERE n > 1 GROUP BY 1""",
)
def hourly_cap_notices(spark: SparkSession, d: str) -> DataFrame:
    """One notice per group and hour for what its cap holds back."""
    f = facts(spark, d).select(F.col("event_time").alias("at"), F.col("row_id").alias("key"), "method", F.col("method").alias("title"))
    return jobs.hourly_cap(f, "method", 1)[1].groupBy("method").agg(F.sum("held").alias("held_back"), F.count("*").alias("notices"))


@query(
    "leading_methods",
    """WITH w AS (SELECT strftime(to_timestamp(floor(epoch(ts) / 86400) * 86400)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS method, count(*) AS n FROM events GROUP BY 1, 2)
SELECT window_start, method, n, total::BIGINT AS total, rank FROM (SELECT *, sum(n) OVER (PARTITION BY window_start) AS total, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, method) AS rank FROM w) WHERE rank <= 2""",
)
def leading_methods(spark: SparkSession, d: str) -> DataFrame:
    g = facts(spark, d).groupBy(F.window("event_time", "1 day"), "method").agg(F.count("*").alias("n"))
    return jobs.leading(g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "method", "n"), 2)


# ---- predictions and profiles

_PREDICTED = "p AS (SELECT o_custkey AS subject, o_orderdate::DATE AS target, o_orderkey AS made, o_orderkey % 3 AS horizon, o_totalprice AS yhat FROM orders)"


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select(F.col("o_custkey").alias("subject"), F.to_date("at").alias("target"), F.col("o_orderkey").alias("made"), (F.col("o_orderkey") % 3).alias("horizon"), F.col("total").cast("double").alias("yhat"))


@query("latest_predictions", f"WITH {_PREDICTED} SELECT subject, strftime(target, '%Y-%m-%d') AS target, max(made) AS made, arg_max(yhat, made) AS yhat FROM p GROUP BY 1, 2")
def latest_predictions(spark: SparkSession, d: str) -> DataFrame:
    return fc.latest_prediction(_predicted(spark, d), ["subject"], "target", "made").select("subject", F.date_format("target", "yyyy-MM-dd").alias("target"), "made", "yhat")


@query("pinned_predictions", f"WITH {_PREDICTED} SELECT subject, strftime(target, '%Y-%m-%d') AS target, max(made) AS made FROM p WHERE horizon = 1 GROUP BY 1, 2")
def pinned_predictions(spark: SparkSession, d: str) -> DataFrame:
    return fc.latest_prediction(_predicted(spark, d), ["subject"], "target", "made", 1).select("subject", F.date_format("target", "yyyy-MM-dd").alias("target"), "made")


@query("latest_profiles", "WITH p AS (SELECT o_orderpriority AS route, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2) SELECT route, strftime(max(day), '%Y-%m-%d') AS day, arg_max(n, day) AS n FROM p WHERE day <= DATE '1999-03-15' GROUP BY 1")
def latest_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = orders(spark, d).groupBy(F.col("o_orderpriority").alias("route"), F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    return risk.latest_profile(p, F.lit("1999-03-15").cast("date")).select("route", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query(
    "next_targets",
    """WITH m AS (SELECT max(o_orderdate)::DATE AS d FROM orders), k AS (SELECT unnest(range(1, 6))::INT AS step),
t AS (SELECT 'day' AS grain, step, d + step AS target FROM m, k UNION ALL SELECT 'week', step, (date_trunc('week', d) + to_days(7 * step))::DATE FROM m, k UNION ALL SELECT 'month', step, (date_trunc('month', d) + to_months(step))::DATE FROM m, k)
SELECT grain, step, strftime(target, '%Y-%m-%d') AS target, strftime(target - INTERVAL 5 HOURS - INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS instant FROM t""",
)
def next_targets(spark: SparkSession, d: str) -> DataFrame:
    last = orders(spark, d).agg(F.date_format(F.max("at"), "yyyy-MM-dd")).first()[0]
    out = None
    for g in ("day", "week", "month"):
        got = fc.targets(spark, last, g, 5, "Asia/Kolkata").select(F.lit(g).alias("grain"), "step", "target", "instant")
        out = got if out is None else out.unionByName(got)
    return out


@query(
    "slot_throughput",
    """WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) / count(DISTINCT user_id) AS rate FROM events GROUP BY 1)
SELECT dayofweek(h)::INT + 1 AS dow, hour(h)::INT AS hour, round(quantile_cont(rate, 0.5), 9) AS rate, count(*) AS hours FROM h GROUP BY 1, 2""",
)
def slot_throughput(spark: SparkSession, d: str) -> DataFrame:
    return fc.throughput(facts(spark, d), "event_time", "user_id").withColumn("rate", F.round("rate", 9))


@query(
    "profile_fallback",
    """WITH g AS (SELECT dayofweek(ts)::INT + 1 AS dow, hour(ts)::INT AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2), r AS (SELECT dow, sum(n) AS rows FROM g GROUP BY 1), m AS (SELECT quantile_disc(rows, 0.5) AS m FROM r),
p AS (SELECT hour, sum(n) / (SELECT sum(n) FROM g) AS pooled FROM g GROUP BY 1)
SELECT r.dow, p.hour, round(CASE WHEN rows >= m THEN coalesce(g.n, 0) / rows ELSE pooled END, 9) AS share FROM r, m, p LEFT JOIN g ON g.dow = r.dow AND g.hour = p.hour""",
)
def profile_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Weekdays with fewer rows than the middle one take the shares of all days."""
    profile = fc.hour_profile(facts(spark, d).filter("method = 'error'"), "event_time")
    least = profile.groupBy("dow").agg(F.sum("n").alias("r")).agg(F.percentile_approx("r", 0.5, 10_000)).first()[0]
    return fc.with_fallback(profile, least).withColumn("share", F.round("share", 9))


@query("pinned_set", "SELECT count(*) AS n, 1 AS is_same, 0 AS after_change FROM orders")
def pinned_set(spark: SparkSession, d: str) -> DataFrame:
    """A pinned set keeps its digest however it is read, and loses it when one value changes."""
    o, cols = orders(spark, d), ["o_orderkey", "o_orderstatus"]
    pin = fc.feature_digest(o, cols)
    moved = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, "X").otherwise(F.col("o_orderstatus")))
    same = fc.verified(o.repartition(3, "o_custkey"), cols, pin)
    return same.join(F.broadcast(fc.verified(moved, cols, pin).select(F.col("is_same").alias("after_change"))))  # one row each


# ---- findings and reports


@query(
    "delivery_findings",
    f"""WITH {_JUDGED}, w AS (SELECT *, {_tier_sql('departure_at')} AS worst FROM o), f AS (SELECT count(*) AS flagged, count(*) FILTER (category IN ('missed', 'held')) AS late FROM w WHERE worst <> 'none' AND day >= DATE '1998-09-02' - 14 AND day < DATE '1998-09-02'),
t AS (SELECT *, {_tier_sql(_NOW)} AS tier FROM b)
SELECT 'delivery:' || delivery AS key, CASE tier WHEN 'left_behind' THEN 'high' WHEN 'at_risk' THEN 'medium' ELSE 'low' END AS severity, greatest(coalesce(expected - confirmed, 0), 0) AS behind, CASE WHEN flagged > 0 THEN round(late / flagged, 3) END AS precision FROM t, f WHERE tier <> 'none'""",
)
def delivery_findings(spark: SparkSession, d: str) -> DataFrame:
    board = {c: F.col(c) for c in risk.BOARD}
    judged = _judged(spark, d).withColumn("worst", risk.tier(board, F.col("departure_at")))
    now = _board(spark, d).withColumn("tier", risk.tier(board, F.expr(_NOW)))
    return risk.delivery_findings(now, judged, F.col("day"), F.lit("1998-09-02").cast("date"))


@query(
    "health_check",
    f"""WITH {_SETTLED}, g AS (SELECT strftime(last_at, '%Y-%m-%d') AS day, count(*) AS releases, count(*) FILTER (picked < expected) AS short_releases, 1 - sum(greatest(expected - picked, 0)) / sum(expected) AS r FROM s GROUP BY 1)
SELECT day, releases, short_releases, round(r, 6) AS fill_rate, CASE WHEN r >= 0.8 THEN 'good' ELSE 'below target' END AS verdict FROM g""",
)
def health_check(spark: SparkSession, d: str) -> DataFrame:
    return risk.health_check(_settled(spark, d), F.date_format("last_at", "yyyy-MM-dd"), 0.8)


@query(
    "dispatch_readiness",
    f"""WITH {_BOARD}, t AS (SELECT route, {_tier_sql(_NOW)} AS tier FROM b WHERE day = DATE '1998-09-02'), g AS (SELECT route, count(*) AS deliveries, count(*) FILTER (tier = 'watch') AS watch, count(*) FILTER (tier = 'at_risk') AS at_risk, count(*) FILTER (tier = 'left_behind') AS left_behind FROM t GROUP BY 1)
SELECT *, CASE WHEN left_behind > 0 THEN 'blocked' WHEN at_risk > 0 THEN 'late' WHEN watch > 0 THEN 'watch' ELSE 'ready' END AS verdict FROM g""",
)
def dispatch_readiness(spark: SparkSession, d: str) -> DataFrame:
    b = _board(spark, d).filter("day = DATE '1998-09-02'").withColumn("tier", risk.tier({c: F.col(c) for c in risk.BOARD}, F.expr(_NOW)))
    return risk.dispatch_readiness(b, "route")


@query(
    "outstanding_exceptions",
    f"""WITH {_SETTLED}, k AS (SELECT *, epoch(last_at - first_at)::DOUBLE AS span FROM s), e AS (SELECT 'zero_pick' AS kind, * FROM k WHERE picked = 0 UNION ALL SELECT 'short', * FROM k WHERE picked > 0 AND picked < expected UNION ALL SELECT 'long_running', * FROM k WHERE span > 8640000)
SELECT kind, count(*) AS n, sum(greatest(expected - picked, 0)) AS units_short, max(span) AS longest_s FROM e GROUP BY 1""",
)
def outstanding_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return risk.outstanding(_settled(spark, d), 8_640_000)
