"""Old days are judged by what was known before them."""

import datetime as dt
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import risk

D = dt.date(2026, 3, 1)
day = lambda k: D + dt.timedelta(days=k)
at = lambda k, h, m=0: dt.datetime(2026, 3, 1, h, m) + dt.timedelta(days=k)
BOARD = "delivery string, route string, day date, departure_at timestamp, expected int, confirmed int, created int, loaded int, loads boolean, dock_last timestamp, last_pick timestamp, last_load timestamp"


def board(spark, *rows):
    full = [(n, r, None if k is None else day(k), at(k or 0, 12), 3, 3, 2, 2, True, None, at(k or 0, 6), at(k or 0, h, m)) for n, r, k, h, m in rows]
    return spark.createDataFrame(full, BOARD)


def profiles(spark, *rows):
    return spark.createDataFrame([(r, day(k), float(u) if u is not None else None) for r, k, u in rows], "route string, day date, usual double")


def judged(df):
    return {r.delivery: r for r in df.collect()}


NOW = lambda: F.lit("2026-04-01").cast("timestamp")


def test_an_old_profile_decides(spark):
    rows = board(spark, ("a", "R", 5, 10, 0), ("b", "R", 9, 10, 0), ("c", "S", 9, 10, 0))
    known = [("R", 3, 540), ("R", 5, 1200), ("R", 8, 660)]
    got = judged(risk.replay_days(rows, profiles(spark, *known), NOW(), 3600))
    # The profile of the day itself is not known on it; route S has none and counts from its departure.
    assert [(got[k].known_day, got[k].category) for k in "abc"] == [(day(3), "held"), (day(8), "fine"), (None, "held")]
    late = judged(risk.replay_days(rows, profiles(spark, ("R", 3, 610), *known[1:]), NOW(), 3600))
    assert late["a"].category == "fine" and late["a"].first_flag != got["a"].first_flag and late["b"] == got["b"]
    empty = judged(risk.replay_days(rows, profiles(spark, ("R", 3, None)), NOW(), 3600))
    assert empty["a"].known_day == day(3) and empty["a"].category == "held"


def test_days_and_rows_that_are_left_out(spark):
    rows = board(spark, ("a", "R", 1, 8, 0), ("b", "R", 2, 8, 0), ("c", "R", 2, 8, 0), ("d", None, 1, 8, 0), ("e", "R", None, 8, 0))
    rows = rows.withColumn("departure_at", F.when(F.col("delivery") == "c", F.lit("2026-03-31 23:30:00").cast("timestamp")).otherwise(F.col("departure_at")))
    assert set(judged(risk.replay_days(rows, profiles(spark), NOW(), 3600))) == {"a"}
    live = spark.createDataFrame([("a", day(1))], "delivery string, day date")
    assert judged(risk.replay_days(rows, profiles(spark), NOW(), 60, live)).keys() == {"b", "c"}
    assert judged(risk.replay_days(rows.limit(0), profiles(spark), NOW(), 60)) == {}


@pytest.mark.parametrize("window", [1, 5, 28])
def test_rhythms(spark, window):
    rng = np.random.default_rng(window)
    closed = [("R", int(k), int(m)) for k, m in zip(rng.integers(0, 40, 50), rng.integers(0, 1440, 50), strict=True)] + [("S", 4, 60), ("S", 4, 90)]
    df = spark.createDataFrame([(r, day(k), m) for r, k, m in closed], "route string, day date, minute int")
    asked = spark.createDataFrame([(r, day(k)) for r, k in product("RST", range(45))] * 2, "route string, day date")
    got = {(r.route, r.day): (r.days, r.usual) for r in risk.rhythms(df, asked, window).collect()}
    want = {}
    for r, k in product("RST", range(45)):
        last = {}
        for q, j, m in closed:
            if q == r and k - window < j <= k:
                last[j] = max(m, last.get(j, m))
        want[r, day(k)] = (len(last), float(np.quantile(list(last.values()), 0.9)) if len(last) >= 3 else None)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and (got[k][1] is None) == (want[k][1] is None) and (want[k][1] is None or abs(got[k][1] - want[k][1]) < 1e-9) for k in want)
