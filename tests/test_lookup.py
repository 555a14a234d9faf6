"""As-of lookups beside a plain search over all periods."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import lookup

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def test_a_value_of_the_future_is_not_seen(spark):
    seen = spark.createDataFrame([("k", "x", at(0.1)), ("k", "y", at(0.9))], "key string, value string, at timestamp")
    p = lookup.build_validity(seen, "key", "value", "at")
    df = spark.createDataFrame([("k", at(0.5)), ("k", at(0.9)), ("k", at(0.899999))], "key string, at timestamp")
    for fn in (lookup.as_of, lookup.as_of_disjoint):
        got = {r.at: r.v for r in fn(df, p, "key", F.col("at"), "v").collect()}
        assert got == {at(0.5): "x", at(0.9): "y", at(0.899999): "x"}


def plain(rows, periods):
    out = []
    for i, k, t in rows:
        hit = [(lo, v) for key, v, lo, hi in periods if key is not None and key == k and t is not None and lo is not None and lo <= t and (hi is None or t < hi)]
        out.append((i, k, t, max(hit)[1] if hit else None))
    return sorted(out, key=str)


def _random(seed):
    rng = random.Random(seed)
    some = lambda: at(rng.randrange(400) / 4)
    periods = []
    for i in range(300):
        lo = some()
        hi = rng.choice([None, lo + timedelta(seconds=rng.randrange(-2, 60) / 4), lo + timedelta(seconds=rng.randrange(1, 200))])
        periods.append((rng.choice(["hot", "hot", "hot", "a", "b", None]), f"v{i}", lo, hi))
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "none", None]), rng.choice([some(), some(), None]) if i % 20 == 0 else some()) for i in range(600)]
    return rows, periods


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_beside_a_plain_search(spark, seed):
    rows, periods = _random(seed)
    df = spark.createDataFrame(rows, "_row int, key string, `a.t` timestamp").repartition(4)
    p = spark.createDataFrame(periods, "key string, value string, valid_from timestamp, valid_to timestamp").repartition(3)
    got = lookup.as_of(df, p, "key", F.col("`a.t`"), "v")
    assert got.columns == ["_row", "key", "a.t", "v"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, periods)
    assert lookup.as_of(df, p.limit(0), "key", F.col("`a.t`"), "v").filter("v IS NULL").count() == len(rows)
    assert lookup.as_of(df.limit(0), p, "key", F.col("`a.t`"), "v").count() == 0


def test_a_hot_key_is_swept_in_slices(spark, monkeypatch):
    """Half of all rows have one key: it is dealt out, and carries go from slice to slice."""
    rows, periods = _random(3)
    df = spark.createDataFrame(rows, "i int, key string, t timestamp")
    p = lookup.pieces(spark.createDataFrame(periods, "key string, value string, valid_from timestamp, valid_to timestamp"))
    slices = []
    true = lookup.hot_slices

    def spied(*args):
        out = true(*args)
        slices.append(out.filter("_k = 'hot'").select("_slice").distinct().count())
        return out

    monkeypatch.setattr(lookup, "hot_slices", spied)
    got = lookup.as_of_disjoint(df, p, "key", F.col("t"), "v", most=50)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, periods)
    assert slices[0] >= 5


def test_keys_of_other_types_and_text_periods(spark):
    p = spark.createDataFrame([("7", "x", "1970-01-01 00:00:00", None)], "key string, value string, valid_from string, valid_to string")
    df = spark.createDataFrame([(7, at(0)), (8, at(0))], "key long, t timestamp")
    assert {r.key: r.v for r in lookup.as_of(df, p, "key", F.col("t"), "v").collect()} == {7: "x", 8: None}
