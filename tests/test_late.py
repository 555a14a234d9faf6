"""Ranges of late rows, joined by buckets, against a plain form."""

import random

from millrace.operators import diff
from millrace.streaming import jobs


def test_even_ranges_over_borders(spark):
    rng, day = random.Random(5), 86_400
    at = {rng.randrange(-day, 4 * day) for _ in range(500)} | {day - 1, day, day + 1, 2 * day - 200, 2 * day + 200, *range(2 * day, 3 * day + 500, 400), 9 * day}
    want = []
    for t in sorted(at):
        if want and t - 60 <= want[-1][1] + 300:
            want[-1][1] = t + 60
        else:
            want.append([t - 60, t + 60])
    df = spark.createDataFrame([(t - 60, t + 60) for t in at], "lo long, hi long")
    assert sorted([r.lo, r.hi] for r in diff.coalesce_even_ranges(df, 300, 120).collect()) == want


def test_late_rows_are_dealt_by_buckets(spark):
    f = spark.range(10).selectExpr("timestamp_seconds(id * 50000) AS at", "id AS row_id", "'x' AS digest")
    ranges, _ = jobs.process_late(f, f, ["row_id"], "digest", 60, 300)
    assert ranges.count() == 10 and "_b" in ranges._jdf.queryExecution().optimizedPlan().toString()
