"""Daily series take in every order of their span."""

from datetime import datetime, timedelta

from millrace.plans import registry


def orders(spark, path, days):
    rows = [(i, 1, "O", 10.0 + i, at, "1-URGENT") for i, at in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_last_day_is_whole(spark, tmp_path):
    d = orders(spark, tmp_path, [datetime(1998, 6, 30, 13), datetime(1998, 7, 1)])
    got = {r.day: r.y for r in registry.queries()["dense_daily"](spark, d).collect()}
    assert got == {"1998-06-30": 10.0, "1998-07-01": 11.0}


def test_backtests_outside_the_half_year(spark, tmp_path):
    d = orders(spark, tmp_path, [datetime(2000, 1, 1, 9) + timedelta(days=i) for i in range(90)])
    assert registry.queries()["best_models"](spark, d).count() == 1
    assert registry.queries()["prediction_intervals"](spark, d).count() > 0
