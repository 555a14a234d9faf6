"""Queries of forecasts, the delivery board, findings and watches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import forecast as fc
from millrace.operators import risk
from millrace.plans.base import calls, facts, orders
from millrace.plans.registry import query
from millrace.session import table

_DAILY = """v AS (SELECT o_orderpriority AS subject, o_orderdate::DATE AS day, sum(o_totalprice::DECIMAL(20,6))::DOUBLE AS y FROM orders GROUP BY 1, 2),
e AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders), s AS (SELECT DISTINCT subject FROM v),
f AS (SELECT subject, unnest(range(lo, hi + 1, INTERVAL 1 DAY))::DATE AS day FROM s, e),
daily AS (SELECT f.subject, f.day, coalesce(y, 0.0) AS y FROM f LEFT JOIN v ON v.subject = f.subject AND v.day = f.day)"""


def _span(df: DataFrame, at: str) -> tuple[str, str]:
    """The first and the last day of a table."""
    day = F.col(at).cast("date")
    return tuple(df.agg(F.min(day).cast("string"), F.max(day).cast("string")).first())


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Every day from the first order to the last, the last one whole."""
    o = orders(spark, d)
    return fc.dense_daily(o, "o_orderpriority", "at", F.col("total"), *_span(o, "at"))


@query("dense_daily", f"WITH {_DAILY} SELECT subject, strftime(day, '%Y-%m-%d') AS day, round(y, 4) AS y FROM daily")
def dense_daily(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select("subject", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("y", 4).alias("y"))


@query(
    "complete_weeks",
    f"WITH {_DAILY} SELECT subject, strftime(date_trunc('week', day), '%Y-%m-%d') AS bucket, round(sum(y), 2) AS y, count(*) AS days, (date_trunc('week', day)::DATE + 6 < (SELECT hi FROM e))::INT AS complete FROM daily GROUP BY subject, date_trunc('week', day)",
)
def complete_weeks(spark: SparkSession, d: str) -> DataFrame:
    return fc.complete_buckets(_daily(spark, d), "week", _span(orders(spark, d), "at")[1]).withColumn("y", F.round("y", 2))


@query(
    "demand_class",
    """WITH v AS (SELECT l_partkey AS subject, l_shipdate::DATE AS day, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2), t AS (SELECT max(l_shipdate)::DATE - min(l_shipdate)::DATE + 1 AS days FROM lineitem),
g AS (SELECT subject, any_value(t.days) AS days, count(*) AS hits, avg(y) AS m, var_pop(y) AS v FROM v, t WHERE y > 0 GROUP BY 1)
SELECT subject, days::BIGINT AS days, hits, CASE WHEN hits < 3 THEN 'insufficient' WHEN days / hits < 1.32 AND v / (m * m) < 0.49 THEN 'smooth' WHEN days / hits < 1.32 THEN 'erratic' WHEN v / (m * m) < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS class FROM g""",
)
def demand_class(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    lo, hi = _span(c, "event_time")
    seen = c.groupBy(F.col("l_partkey").alias("subject"), F.col("event_time").cast("date").alias("day")).agg(F.sum("quantity").cast("double").alias("y"))
    return fc.demand_class_of(seen, lo, hi)


@query(
    "steady_start",
    f"""WITH {_DAILY}, w AS (SELECT *, dayofweek(day) IN (0, 6) AS we FROM daily), m AS (SELECT subject, we, quantile_cont(y, 0.5) AS med FROM w WHERE day > (SELECT hi FROM e) - 28 GROUP BY 1, 2),
o AS (SELECT w.subject, day, (y >= coalesce(med, 0) * 0.5)::INT AS ok FROM w LEFT JOIN m ON m.subject = w.subject AND m.we = w.we),
r AS (SELECT subject, day, min(ok) OVER x AS a, count(*) OVER x AS n FROM o WINDOW x AS (PARTITION BY subject ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT subject, strftime(min(day), '%Y-%m-%d') AS steady_from FROM r WHERE a = 1 AND n = 5 GROUP BY 1""",
)
def steady_start(spark: SparkSession, d: str) -> DataFrame:
    return fc.steady_start(_daily(spark, d))


@query(
    "moving_average",
    f"WITH {_DAILY}, k AS (SELECT unnest(range(1, 8))::INT AS step) SELECT subject, step, round(avg(y), 4) AS yhat FROM daily, k WHERE day > (SELECT hi FROM e) - 7 GROUP BY 1, 2",
)
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return fc.fit_predict(_daily(spark, d), "moving_average", 7).withColumn("yhat", F.round("yhat", 4))


@query(
    "seasonal_naive",
    f"WITH {_DAILY}, k AS (SELECT unnest(range(1, 15))::INT AS step) SELECT subject, step, round(y, 4) AS yhat FROM daily JOIN k ON day = (SELECT hi FROM e) - 6 + (step - 1) % 7",
)
def seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    return fc.fit_predict(_daily(spark, d), "seasonal_naive", 14).withColumn("yhat", F.round("yhat", 4))


@query("best_models")
def best_models(spark: SparkSession, d: str) -> DataFrame:
    return fc.best_models(fc.backtest(_daily(spark, d)))


@query("prediction_intervals")
def prediction_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Bands of every model over two weeks, the second beyond what was tested."""
    daily = _daily(spark, d)
    points = None
    for m in ("seasonal_naive", "moving_average"):
        got = fc.fit_predict(daily, m, 14).withColumn("model", F.lit(m))
        points = got if points is None else points.unionByName(got)
    return fc.intervals(fc.backtest(daily), points)


@query(
    "bucket_points",
    f"""WITH {_DAILY}, a AS (SELECT subject, avg(y) AS yhat FROM daily WHERE day > (SELECT hi FROM e) - 7 GROUP BY 1), n AS (SELECT subject, unnest(range(hi + 1, hi + 8, INTERVAL 1 DAY))::DATE AS day, yhat FROM a, e),
u AS (SELECT subject, day, y AS x, 0.0 AS r FROM daily UNION ALL SELECT subject, day, 0.0, yhat FROM n)
SELECT subject, strftime(date_trunc('week', day), '%Y-%m-%d') AS bucket, round(sum(x), 2) AS so_far, round(sum(x + r), 2) AS point FROM u GROUP BY 1, 2""",
)
def bucket_points(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    ahead = fc.fit_predict(daily, "moving_average", 7).withColumn("day", F.date_add(F.lit(_span(orders(spark, d), "at")[1]).cast("date"), F.col("step")))
    got = fc.bucket_points(daily, ahead, "week")
    return got.select("subject", "bucket", F.round("so_far", 2).alias("so_far"), F.round("point", 2).alias("point"))


@query(
    "hour_profile",
    "WITH g AS (SELECT dayofweek(ts)::INT + 1 AS dow, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2) SELECT dow, hour, n, round(n / sum(n) OVER (PARTITION BY dow), 9) AS share FROM g",
)
def hour_profile(spark: SparkSession, d: str) -> DataFrame:
    return fc.hour_profile(facts(spark, d), "event_time").withColumn("share", F.round("share", 9))


@query(
    "hourly_staffing",
    """WITH g AS (SELECT dayofweek(ts)::INT + 1 AS dow, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY dow) AS share FROM g),
d AS (SELECT event_type AS subject, ts::DATE AS day, count(*) * 100.0::DOUBLE AS yhat FROM events GROUP BY 1, 2)
SELECT subject, strftime(day, '%Y-%m-%d') AS day, hour, round(yhat * share, 4) AS yhat, (yhat * share * 1.1 / 40 > 1)::INT AS busy FROM d JOIN p ON p.dow = dayofweek(day)::INT + 1""",
)
def hourly_staffing(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    days = f.groupBy(F.col("method").alias("subject"), F.to_date("event_time").alias("day")).agg((F.count("*") * 100.0).alias("yhat"))
    got = fc.spread(days, fc.hour_profile(f, "event_time"), 40.0)
    return got.select("subject", F.date_format("day", "yyyy-MM-dd").alias("day"), "hour", F.round("yhat", 4).alias("yhat"), (F.col("pickers") > 1).cast("int").alias("busy"))


@query(
    "forecast_accuracy",
    f"""WITH {_DAILY}, p AS (SELECT subject, day, lag(y, 7) OVER (PARTITION BY subject ORDER BY day) AS yhat, y FROM daily)
SELECT 7 AS horizon, count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(sum(abs(yhat - y)) / sum(y), 6) AS wape, round(avg(CASE WHEN y <> 0 THEN abs((yhat - y) / y) END), 6) AS mape, round(avg(yhat - y), 6) AS bias FROM p WHERE yhat IS NOT NULL""",
)
def forecast_accuracy(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    daily = _daily(spark, d)
    p = daily.withColumn("yhat", F.lag("y", 7).over(Window.partitionBy("subject").orderBy("day"))).filter("yhat IS NOT NULL").select("subject", "day", "yhat", F.lit(7).alias("horizon"))
    return fc.score(p, daily)


@query(
    "shift_totals",
    """WITH h AS (SELECT strftime(ts - INTERVAL 14 HOURS, '%Y-%m-%d') AS shift, hour(ts)::INT AS hour, sum(value::DECIMAL(20,6))::DOUBLE AS v FROM events GROUP BY 1, 2)
SELECT shift, round(sum(v), 2) AS total, arg_max(hour, (v, -hour)) AS peak_hour FROM h GROUP BY 1""",
)
def shift_totals(spark: SparkSession, d: str) -> DataFrame:
    return fc.shifts(facts(spark, d), "event_time", F.col("quantity"))


@query(
    "feature_digest",
    """WITH h AS (SELECT sha256(coalesce(o_orderkey::VARCHAR, chr(0)) || chr(31) || coalesce(o_orderstatus, chr(0))) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT)::HUGEINT::VARCHAR AS digest_a, sum(('0x' || substr(h, 13, 12))::BIGINT)::HUGEINT::VARCHAR AS digest_b FROM h""",
)
def feature_digest(spark: SparkSession, d: str) -> DataFrame:
    return fc.feature_digest(orders(spark, d).filter("at < TIMESTAMP '1999-01-01'"), ["o_orderkey", "o_orderstatus"])


def _board(spark: SparkSession, d: str) -> DataFrame:
    """Orders as deliveries that leave at noon of their 60th day on the route of their priority; line items as lines and
    packages, shipped at the start of a day (picked) and six hours later (loaded)."""
    o = orders(spark, d)
    day = F.date_add(F.col("at").cast("date"), 60)
    base = o.select(
        F.col("o_orderkey").alias("delivery"), F.col("o_orderpriority").alias("route"), (day.cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("departure_at"), day.alias("day"),
        (day.cast("timestamp") + F.expr("INTERVAL 9 HOURS")).alias("usual"), (F.col("o_orderpriority") != "5-LOW").alias("loads"), "o_custkey",
    )
    picked, on = F.col("l_returnflag") != "R", F.col("l_linestatus") == "F"
    lines = calls(spark, d).groupBy(F.col("order_key").alias("delivery")).agg(
        F.count("*").alias("lines"), F.count_if(picked).alias("confirmed"), F.count_if(picked).alias("created"), F.count_if(on & picked).alias("loaded"),
        F.max(F.when(picked, F.col("event_time"))).alias("last_pick"), F.max(F.when(on & picked, F.col("event_time") + F.expr("INTERVAL 6 HOURS"))).alias("last_load"), F.max("event_time").alias("done_at"),
    )
    b = base.join(lines, "delivery", "left").withColumn("expected", F.when(F.col("delivery") % 10 != 0, F.coalesce("lines", F.lit(0))))
    for c in ("confirmed", "created", "loaded"):
        b = b.withColumn(c, F.coalesce(c, F.lit(0)))
    dock = b.groupBy("route", "day").agg(F.max("last_load").alias("dock_last"))
    return b.join(dock, ["route", "day"])


_BOARD = """l AS (SELECT l_orderkey AS delivery, count(*) AS lines, count(*) FILTER (l_returnflag <> 'R') AS confirmed, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS loaded,
 max(l_shipdate) FILTER (l_returnflag <> 'R') AS last_pick, max(l_shipdate + INTERVAL 6 HOURS) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS last_load, max(l_shipdate) AS done_at FROM lineitem GROUP BY 1),
b0 AS (SELECT o_orderkey AS delivery, o_orderpriority AS route, o_orderdate::DATE + 60 AS day, (o_orderdate::DATE + 60)::TIMESTAMP + INTERVAL 12 HOURS AS departure_at, (o_orderdate::DATE + 60)::TIMESTAMP + INTERVAL 9 HOURS AS usual,
 o_orderpriority <> '5-LOW' AS loads, CASE WHEN o_orderkey % 10 <> 0 THEN coalesce(lines, 0) END AS expected, coalesce(confirmed, 0) AS confirmed, coalesce(confirmed, 0) AS created, coalesce(loaded, 0) AS loaded, last_pick, last_load, done_at
 FROM orders LEFT JOIN l ON l.delivery = o_orderkey),
b AS (SELECT *, max(last_load) OVER (PARTITION BY route, day) AS dock_last FROM b0)"""


def _tier_sql(now: str, confirmed: str = "confirmed", loaded: str = "loaded", dock: str = "dock_last") -> str:
    picking = f"CASE WHEN expected IS NULL THEN {confirmed} = 0 ELSE {confirmed} < expected END"
    loading = f"(loads AND ({loaded} = 0 OR {loaded} < created))"
    gone = f"({now} >= usual + INTERVAL 30 MINUTES AND (NOT loads OR {dock} IS NULL OR {now} - {dock} >= INTERVAL 30 MINUTES))"
    return f"CASE WHEN NOT (({picking}) OR {loading}) THEN 'none' WHEN {gone} THEN 'left_behind' WHEN {now} < usual - INTERVAL 2 HOURS THEN 'none' WHEN {loading} THEN 'at_risk' ELSE 'watch' END"


@query(
    "delivery_states",
    """WITH p AS (SELECT l_orderkey AS delivery, count(*) AS picked, strftime(max(l_shipdate), '%Y-%m-%d') AS last_pick FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), e AS (SELECT l_orderkey AS delivery, sum(l_quantity) AS expected FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
k AS (SELECT l_orderkey AS delivery, count(*) AS packages, count(*) FILTER (l_linestatus = 'F') AS loaded FROM lineitem GROUP BY 1)
SELECT o_orderkey AS delivery, coalesce(picked, 0) AS picked, coalesce(packages, 0) AS packages, coalesce(loaded, 0) AS loaded, expected, last_pick FROM orders LEFT JOIN p ON p.delivery = o_orderkey LEFT JOIN e ON e.delivery = o_orderkey LEFT JOIN k ON k.delivery = o_orderkey""",
)
def delivery_states(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).withColumnRenamed("order_key", "delivery").withColumn("at", F.col("event_time"))
    routes = _board(spark, d).select("delivery", "route", "departure_at")
    expected = c.filter("row_id = 1").withColumn("expected", F.col("quantity"))
    got = risk.delivery_states(routes, c.filter("l_returnflag <> 'R'"), expected, c.withColumn("loaded", F.col("l_linestatus") == "F"))
    return got.select("delivery", "picked", "packages", "loaded", F.col("expected").cast("double").alias("expected"), F.date_format("last_pick", "yyyy-MM-dd").alias("last_pick"))


_NOW = "TIMESTAMP '1998-09-02 10:00:00'"


@query("tiers_now", f"WITH {_BOARD} SELECT delivery, {_tier_sql(_NOW)} AS tier FROM b")
def tiers_now(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d).select("delivery", risk.tier({c: F.col(c) for c in risk.BOARD}, F.expr(_NOW)).alias("tier"))


_CLOSE = "TIMESTAMP '2002-01-01 00:00:00'"


@query(
    "replay_tiers",
    f"""WITH {_BOARD}, i AS (SELECT DISTINCT b.*, t FROM b, unnest([usual - INTERVAL 119 MINUTES, usual + INTERVAL 1 MINUTE, usual + INTERVAL 31 MINUTES, dock_last + INTERVAL 31 MINUTES, last_pick, last_load, {_CLOSE}]) AS u(t) WHERE t IS NOT NULL AND t <= {_CLOSE}),
v AS (SELECT *, CASE WHEN last_pick IS NULL OR t >= last_pick THEN confirmed ELSE 0 END AS c, CASE WHEN last_load IS NULL OR t >= last_load THEN loaded ELSE 0 END AS n, CASE WHEN dock_last IS NOT NULL THEN least(dock_last, t) END AS k FROM i),
r AS (SELECT delivery, t, {_tier_sql("t", "c", "n", "k")} AS tier FROM v), p AS (SELECT *, lag(tier, 1, 'none') OVER (PARTITION BY delivery ORDER BY t) AS p FROM r),
g AS (SELECT *, tier <> p AS change, CASE tier WHEN 'none' THEN 1 WHEN 'watch' THEN 2 WHEN 'at_risk' THEN 3 ELSE 4 END AS rank FROM p)
SELECT delivery, strftime(min(CASE WHEN change AND tier <> 'none' THEN t END), '%Y-%m-%d %H:%M:%S') AS first_flag, coalesce(arg_max(tier, rank) FILTER (change), 'none') AS worst, arg_max(tier, t) AS final, coalesce(string_agg(tier, '>' ORDER BY t) FILTER (change), '') AS history FROM g GROUP BY 1""",
)
def replay_tiers(spark: SparkSession, d: str) -> DataFrame:
    return risk.replay(_board(spark, d), F.expr(_CLOSE))


_OUT = """CASE WHEN loads THEN CASE WHEN loaded = 0 OR loaded < created THEN 'never_loaded' WHEN last_load > departure_at THEN 'loaded_late' ELSE 'loaded_in_time' END
 WHEN (CASE WHEN expected IS NULL THEN confirmed = 0 ELSE confirmed < expected END) OR last_pick IS NULL OR last_pick > departure_at THEN 'picked_late' ELSE 'picked_in_time' END"""
_OPEN = "departure_at > TIMESTAMP '2001-06-01'"
_WORD = f"""CASE WHEN {_OPEN} THEN 'open' WHEN outcome = 'never_loaded' THEN 'missed' WHEN outcome = 'picked_late' AND (CASE WHEN expected IS NULL THEN confirmed = 0 ELSE confirmed < expected END) THEN 'missed'
 WHEN outcome IN ('picked_late', 'loaded_late') THEN 'held' WHEN CASE WHEN loads THEN last_load ELSE last_pick END > usual THEN 'held' ELSE 'fine' END"""
_JUDGED = f"{_BOARD}, o0 AS (SELECT *, {_OUT} AS outcome FROM b), o AS (SELECT *, {_WORD} AS category FROM o0)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The board with outcome and category; deliveries that leave after 2001-06-01 are open."""
    b = _board(spark, d)
    s = {c: F.col(c) for c in (*risk.BOARD, "departure_at")}
    closed = F.when(F.col("departure_at") <= F.lit("2001-06-01").cast("timestamp"), risk.outcome_of(s))
    return b.withColumn("outcome", closed).withColumn("category", risk.category_of(F.col("outcome"), s))


_OLD_NOW = "TIMESTAMP '1998-06-01 00:00:00'"


@query(
    "replay_old_days",
    f"""WITH {_BOARD}, c AS (SELECT route, day, max(hour(last_load) * 60 + date_diff('day', day, last_load::DATE) * 1 + 420) AS minute FROM b WHERE last_load IS NOT NULL GROUP BY 1, 2),
a AS (SELECT DISTINCT route, day - 1 AS day FROM b), u AS (SELECT route, day, minute, false AS ask FROM c UNION ALL SELECT route, day, NULL, true FROM a),
w AS (SELECT route, day, ask, count(minute) OVER x AS days, quantile_cont(minute, 0.9) OVER x AS covered FROM u WINDOW x AS (PARTITION BY route ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW)),
p AS (SELECT route, day, CASE WHEN days >= 3 THEN covered END AS known FROM w WHERE ask AND dayofmonth(day) % 2 = 0),
d AS (SELECT day FROM b GROUP BY 1 HAVING max(departure_at) + INTERVAL 2 HOURS <= {_OLD_NOW}),
k AS (SELECT b.* EXCLUDE (usual), p.day AS known_day, known, departure_at + INTERVAL 2 HOURS AS close FROM b JOIN d USING (day) ASOF LEFT JOIN p ON p.route = b.route AND p.day < b.day WHERE b.delivery % 7 <> 0),
e AS (SELECT *, coalesce(day::TIMESTAMP + to_microseconds((known * 60)::BIGINT * 1000000), departure_at - INTERVAL 3 HOURS) AS usual FROM k),
o0 AS (SELECT *, {_OUT} AS outcome FROM e), o AS (SELECT *, {_WORD.replace(f"WHEN {_OPEN} THEN 'open' ", "")} AS category FROM o0),
i AS (SELECT DISTINCT o.*, t FROM o, unnest([usual - INTERVAL 119 MINUTES, usual + INTERVAL 1 MINUTE, usual + INTERVAL 31 MINUTES, dock_last + INTERVAL 31 MINUTES, last_pick, last_load, close]) AS z(t) WHERE t IS NOT NULL AND t <= close),
v AS (SELECT *, CASE WHEN last_pick IS NULL OR t >= last_pick THEN confirmed ELSE 0 END AS c, CASE WHEN last_load IS NULL OR t >= last_load THEN loaded ELSE 0 END AS n, CASE WHEN dock_last IS NOT NULL THEN least(dock_last, t) END AS k FROM i),
r AS (SELECT delivery, day, known_day, outcome, category, t, {_tier_sql("t", "c", "n", "k")} AS tier FROM v), q AS (SELECT *, tier <> lag(tier, 1, 'none') OVER (PARTITION BY delivery ORDER BY t) AS change FROM r),
g AS (SELECT *, CASE tier WHEN 'none' THEN 1 WHEN 'watch' THEN 2 WHEN 'at_risk' THEN 3 ELSE 4 END AS rank FROM q)
SELECT delivery, strftime(any_value(day), '%Y-%m-%d') AS day, strftime(any_value(known_day), '%Y-%m-%d') AS known_day, any_value(outcome) AS outcome, any_value(category) AS category, strftime(min(CASE WHEN change AND tier <> 'none' THEN t END), '%Y-%m-%d %H:%M:%S') AS first_flag,
coalesce(arg_max(tier, rank) FILTER (change), 'none') AS worst, arg_max(tier, t) AS final, coalesce(string_agg(tier, '>' ORDER BY t) FILTER (change), '') AS history FROM g GROUP BY 1""",
)
def replay_old_days(spark: SparkSession, d: str) -> DataFrame:
    """Days up to June 1998 by the profiles of the even days before them; every seventh delivery is there live already."""
    b = _board(spark, d)
    load = F.col("last_load")
    minute = F.hour(load) * 60 + F.date_diff(load.cast("date"), F.col("day")) + 420
    closed = b.filter(load.isNotNull()).select("route", "day", minute.alias("minute"))
    profiles = risk.rhythms(closed, b.select("route", F.date_sub("day", 1).alias("day"))).filter(F.dayofmonth("day") % 2 == 0)
    live = b.filter("delivery % 7 = 0").select("delivery", "day")
    got = risk.replay_days(b.drop("usual"), profiles, F.expr(_OLD_NOW), 7_200, live)
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("day", "known_day")})


@query("delivery_outcomes", f"WITH {_JUDGED} SELECT delivery, CASE WHEN NOT ({_OPEN}) THEN outcome END AS outcome, category FROM o")
def delivery_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("delivery", "outcome", "category")


@query("flag_accuracy", f"WITH {_JUDGED} SELECT route, {_tier_sql('departure_at')} AS worst, count(*) AS n, count(*) FILTER (category IN ('missed', 'held')) AS hits, bool_and(category IN ('missed', 'held'))::INT AS all_hit FROM o GROUP BY 1, 2")
def flag_accuracy(spark: SparkSession, d: str) -> DataFrame:
    worst = risk.tier({c: F.col(c) for c in risk.BOARD}, F.col("departure_at"))
    return risk.flag_accuracy(_judged(spark, d).select("route", F.col("category").alias("outcome"), worst.alias("worst")))


@query(
    "route_vans",
    f"""WITH {_JUDGED} SELECT route, strftime(day, '%Y-%m-%d') AS day, count(*) AS deliveries, count(*) FILTER (category = 'missed') AS missed, count(*) FILTER (category = 'held') AS held, count(*) FILTER (category = 'fine') AS fine,
 strftime(min(last_load), '%Y-%m-%d %H:%M:%S') AS first_load, strftime(max(last_load), '%Y-%m-%d %H:%M:%S') AS last_load, bool_and(category = 'fine')::INT AS all_fine FROM o GROUP BY 1, 2""",
)
def route_vans(spark: SparkSession, d: str) -> DataFrame:
    return risk.vans(_judged(spark, d), F.date_format("day", "yyyy-MM-dd"))


@query(
    "board_after_check",
    f"""WITH {_BOARD}, s AS (SELECT delivery, CASE WHEN delivery % 2 = 0 THEN 'closed' ELSE 'open' END AS state, CASE WHEN delivery % 4 = 0 THEN 'watch' ELSE 'none' END AS tier FROM b WHERE delivery % 3 <> 0), n AS (SELECT delivery, {_tier_sql(_NOW)} AS tier FROM b WHERE delivery % 5 <> 0)
SELECT coalesce(s.delivery, n.delivery) AS delivery, coalesce(n.tier, s.tier) AS tier, CASE WHEN n.delivery IS NOT NULL OR s.delivery IS NULL THEN 'open' ELSE s.state END AS state, (s.state IS NOT DISTINCT FROM 'closed' AND n.delivery IS NOT NULL)::INT AS reopened,
 (s.tier IS DISTINCT FROM coalesce(n.tier, s.tier))::INT AS changes FROM s FULL JOIN n ON s.delivery = n.delivery""",
)
def board_after_check(spark: SparkSession, d: str) -> DataFrame:
    b = _board(spark, d)
    key = F.col("delivery")
    stored = b.filter(key % 3 != 0).select(
        "delivery", F.when(key % 2 == 0, "closed").otherwise("open").alias("state"), F.when(key % 4 == 0, "watch").otherwise("none").alias("tier"), F.lit(0).alias("reopened"), F.array().cast("array<struct<at:timestamp,tier:string>>").alias("history")
    )
    judged = b.filter(key % 5 != 0).select("delivery", risk.tier({c: F.col(c) for c in risk.BOARD}, F.expr(_NOW)).alias("tier"))
    return risk.apply_board(stored, judged, F.expr(_NOW)).select("delivery", "tier", "state", "reopened", F.size("history").alias("changes"))


@query(
    "route_profile",
    """WITH p AS (SELECT user_id % 9 AS route, ts::DATE AS day, max(hour(ts) * 60 + minute(ts)) AS m FROM events GROUP BY 1, 2)
SELECT route, count(*) AS days, quantile_cont(m, 0.9) AS covered, quantile_cont(m, 0.5) AS median, max(m)::INT AS latest FROM p GROUP BY 1 HAVING count(*) >= 3""",
)
def route_profile(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).select((F.col("user_id") % 9).alias("route"), F.col("event_time").alias("at"))
    return risk.route_profile(f).drop("usual")


@query("close_due", f"WITH {_BOARD} SELECT delivery, CASE WHEN done_at IS NOT NULL AND departure_at <= TIMESTAMP '1998-01-01' THEN 'closed' WHEN departure_at <= TIMESTAMP '1997-12-31' THEN 'unknown' WHEN departure_at <= TIMESTAMP '1998-01-01' THEN 'due' ELSE 'open' END AS state FROM b")
def close_due(spark: SparkSession, d: str) -> DataFrame:
    return risk.close_due(_board(spark, d), F.lit("1998-01-01").cast("timestamp")).select("delivery", "state")


@query(
    "reconcile_findings",
    """WITH s AS (SELECT c_custkey AS key, CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'snoozed' END AS state, c_custkey % 2 = 0 AS asleep FROM customer WHERE c_custkey % 5 <> 0), f AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_totalprice > 300000)
SELECT coalesce(f.key, s.key) AS key, CASE WHEN s.key IS NULL THEN 'opened' WHEN f.key IS NULL THEN CASE WHEN state = 'resolved' THEN 'unchanged' ELSE 'resolved' END WHEN state = 'resolved' THEN 'reopened' WHEN state = 'snoozed' AND asleep THEN 'unchanged' WHEN state = 'snoozed' THEN 'woken' ELSE 'refreshed' END AS action FROM s FULL JOIN f ON s.key = f.key""",
)
def reconcile_findings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    state = F.when(k % 3 == 0, "open").when(k % 3 == 1, "resolved").otherwise("snoozed")
    until = F.when(k % 2 == 0, F.lit("2030-01-01")).otherwise(F.lit("2000-01-01")).cast("timestamp")
    stored = table(spark, d, "customer").filter("c_custkey % 5 <> 0").select(k.alias("key"), state.alias("state"), until.alias("snoozed_until"))
    found = orders(spark, d).filter("total > 300000").select(F.col("o_custkey").alias("key")).distinct()
    return risk.reconcile_findings(stored, found, F.lit("2020-01-01").cast("timestamp"))


@query(
    "chronic_shorts",
    """WITH s AS (SELECT l_suppkey, l_shipdate::DATE AS day, count(*) AS n FROM lineitem WHERE l_quantity < 20 GROUP BY 1, 2),
w AS (SELECT a.l_suppkey, a.day, a.n, count(*) AS days FROM s a JOIN s b ON b.l_suppkey = a.l_suppkey AND b.day BETWEEN a.day AND a.day + 6 GROUP BY 1, 2, 3)
SELECT l_suppkey, max(days) AS days, sum(n)::BIGINT AS n, CASE WHEN max(days) >= 6 THEN 'high' ELSE 'medium' END AS severity FROM w GROUP BY 1 HAVING max(days) >= 3""",
)
def chronic_shorts(spark: SparkSession, d: str) -> DataFrame:
    return risk.chronic(calls(spark, d), ["l_suppkey"], F.to_date("event_time"), F.col("quantity") < 20)


@query(
    "user_story",
    """WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN value >= 50 THEN 'big' ELSE 'small' END AS o FROM events), c AS (SELECT user_id, day, string_agg(o || '=' || n, ',' ORDER BY o) AS outcomes FROM (SELECT user_id, day, o, count(*) AS n FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT user_id, day, count(*) AS n, strftime(min(ts), '%H:%M:%S') AS first, strftime(max(ts), '%H:%M:%S') AS last, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(*) FILTER (event_type = 'error') AS issues, any_value(outcomes) AS outcomes FROM e JOIN c USING (user_id, day) GROUP BY 1, 2""",
)
def user_story(spark: SparkSession, d: str) -> DataFrame:
    return risk.story(facts(spark, d), "user_id", "event_time", "method", F.col("method") == "error", F.when(F.col("quantity") >= 50, "big").otherwise("small"))


@query("site_report", f"WITH {_BOARD} SELECT route, count(*) AS n, count(done_at) AS done, round(count(done_at) / count(*), 6) AS share, CASE WHEN count(done_at) / count(*) >= 0.98 THEN 'ready' ELSE 'attention' END AS verdict FROM b GROUP BY 1")
def site_report(spark: SparkSession, d: str) -> DataFrame:
    return risk.site_report(_board(spark, d), "route", 0.98)


@query(
    "watch_status",
    """WITH r AS (SELECT event_id, (value >= 90)::INT AS up, (sum((value < 40)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3)::INT AS down, user_id, ts FROM events)
SELECT event_id, coalesce(last_value(CASE WHEN up = 1 THEN 'alert' WHEN down = 1 THEN 'ok' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'ok') AS status FROM r""",
)
def watch_status(spark: SparkSession, d: str) -> DataFrame:
    r = facts(spark, d).withColumn("order", F.struct("event_time", "row_id"))
    return risk.assess(r, "user_id", "order", "quantity", 90, 40, 3).select(F.col("row_id").alias("event_id"), "status")
