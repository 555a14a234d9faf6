"""Streams over a table that is a folder of part files, in any order of time."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.plans import registry
from millrace.sources.feed import Feed
from millrace.sources.versioned import Buckets
from millrace.streaming import jobs
from tests.compare import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(4, F.col("ts").desc()).write.parquet(f"{d}/events.parquet")
    return d


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["stream_digest", "stream_incremental", "stream_rules", "stream_watches"])
def test_folder_is_the_file(spark, parts, name):
    q = registry.queries()[name]
    want = rows(q(spark, SF))
    assert rows(q(spark, parts)) == want and want


def test_watch_of_several_frames(spark, parts):
    want = rows(registry.queries()["stream_watches"](spark, SF))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows(registry.queries()["stream_watches"](spark, parts)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("name", ["stream_caps", "stream_late", "stream_sealed"])
def test_more_queries_of_a_folder(spark, parts, name):
    q = registry.queries()[name]
    assert rows(q(spark, SF)) == rows(q(spark, parts))


def _batches(spark, tmp_path, batches, schema, **columns):
    """A stream of one batch for each list of rows."""
    for n, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{tmp_path}/e/part={n}")
        for f in (tmp_path / f"e/part={n}").glob("*.parquet"):
            os.utime(f, (1_000_000 + n, 1_000_000 + n))
    return jobs.read_stream(spark, f"{tmp_path}/e", "ts", {k: F.col(c) for k, c in columns.items()}, per_trigger=1)


def test_caps_over_batches(spark, tmp_path):
    """An hour's cap counts what earlier batches sent; one notice, and one summary when the watermark has passed the hour."""
    at = lambda h, m: datetime(2026, 1, 1, h, m)
    batches = [
        [(at(5, 0), 1, "a"), (at(5, 1), 2, "a"), (at(5, 2), 3, "b")],
        [(at(5, 30), 4, "a"), (at(5, 20), 5, "a"), (at(6, 1), 6, "a")],
        [(at(5, 40), 7, "a"), (at(6, 2), 8, None)],
        [(at(9, 30), 9, "a")],
        [(at(12, 0), 10, "b")],
    ]
    s = _batches(spark, tmp_path, batches, "ts timestamp, k long, g string", key="k", g="g", title="g")
    got = {(r.at, r.key, r.title, r.kind, r.held) for r in jobs.run_to_table(jobs.capped(s, "g", 3), "caps").collect()}
    sent = {(1, "a"), (2, "a"), (5, "a"), (3, "b"), (6, "a"), (8, None), (9, "a"), (10, "b")}
    assert {(k, t) for _, k, t, kind, _ in got if kind == "sent"} == sent
    assert {x for x in got if x[3] == "notice"} == {(at(5, 30), None, "a", "notice", 0)}
    assert {x for x in got if x[3] == "summary"} == {(at(6, 0), None, "a", "summary", 2)}


def test_late_rows_over_batches(spark, tmp_path):
    """A row that comes twice changes once, and a batch reads and writes only the buckets that its rows lie in."""
    at = lambda d, m=0: datetime(2026, 1, d, 5, m)
    stored = [(at(d), 100 * d + i, "old") for d in range(1, 21) for i in range(30)]
    batches = [[(at(3), 300, "new"), (at(3), 301, "old"), (at(4, 7), 9999, "x")], [(at(3), 300, "new"), (at(25), 1, "far")], [(at(3), 300, "again"), (None, 7, "no time")]]
    buckets = Buckets(spark, "at timestamp, k bigint, digest string", "at", 86_400)
    buckets.write(spark.createDataFrame(stored, "at timestamp, k long, digest string"), 0)
    s = _batches(spark, tmp_path, batches, "ts timestamp, k long, v string", k="k", digest="v")
    read = []
    true = Buckets.read
    Buckets.read = lambda self, version, touched=None: read.append((version, None if touched is None else len(touched))) or true(self, version, touched)
    try:
        got = {(r.at, r.k, r.digest, r.action) for r in jobs.late_buckets(s, buckets, ["k"], "digest").collect()}
    finally:
        Buckets.read = true
    assert got == {(at(3), 300, "new", "update"), (at(4, 7), 9999, "x", "insert"), (at(25), 1, "far", "insert"), (at(3), 300, "again", "update"), (None, 7, "no time", "insert")}
    assert max(n for _, n in read) == 2 and None not in {n for _, n in read}
    want = {(t, k, v) for t, k, v in stored if k != 300} | {(at(3), 300, "again"), (at(4, 7), 9999, "x"), (at(25), 1, "far"), (None, 7, "no time")}
    assert {tuple(r) for r in buckets.read(3).collect()} == want
    assert buckets.read(0).count() == 600 and buckets.read(1).filter("digest = 'again'").count() == 0
    plan = buckets.read(3, [20456])._jdf.queryExecution().toString()
    assert buckets.read(3, []).count() == 0 and plan.count("bucket=") <= 2
    # A batch that is done again stands in its own place.
    buckets.merge(spark.createDataFrame([(at(3), 300, "new"), (at(3), 301, "old"), (at(4, 7), 9999, "x")], "at timestamp, k long, digest string"), ["k"], "digest", 1, 0)
    assert {tuple(r) for r in buckets.read(3).collect()} == want


def test_a_feed_loses_nothing_and_tells_nothing_twice(spark):
    """Ties that straddle the cap, rows committed behind the cursor, rows written anew, and a step that is lost before its cursor."""
    t = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    schema = "w timestamp, k bigint, v string"
    table = [(t(10), i, "a") for i in range(7)] + [(t(20), 7, "a"), (None, 8, "a"), (t(20), None, "a")]
    feed = Feed(spark, schema, "w", "k", lag_s=5, overlap_s=60, cap=3)
    df = lambda: spark.createDataFrame(table, schema)
    step = lambda now: sorted((tuple(r) for r in feed.step(df(), F.lit(t(now))).collect()), key=str)
    assert step(12) == [] and feed.position()[0] == 0  # within the lag
    seen = step(30)
    assert len(seen) == 3
    table.append((t(9), 50, "late"))  # committed behind the cursor
    done, cursor = feed.position()
    again = Feed(spark, schema, "w", "k", 5, 60, 3, feed.root)  # opened again in its place
    lost = again.step(df(), F.lit(t(30))).collect()
    feed._put(spark.createDataFrame([(done, cursor)], "n int, cursor bigint"), "cursor", done + 1)  # the cursor of this step was lost
    seen += step(30)
    assert sorted(map(tuple, lost), key=str) == seen[3:] and (t(9), 50, "late") in seen
    while more := step(30):
        seen += more
    table.append((t(20), 3, "anew"))
    table.append((t(25), 3, "anew"))
    seen += step(40)
    want = [r for r in table if r[0] is not None]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert sorted((tuple(r) for r in feed.told().select("w", "k", "v").collect()), key=str) == sorted(want, key=str)


def test_gates_and_watches_by_time(spark, tmp_path):
    rows_ = [("success", False, 1), ("success", None, 2), ("incomplete", False, 3), ("incomplete", True, 4), ("error", None, 5), (None, True, 6)]
    df = spark.createDataFrame(rows_, "status string, sealed boolean, i int")
    of = lambda only: {r.i for r in df.filter(jobs.alertable(F.col("status"), F.col("sealed"), only)).collect()}
    assert of(False) == {1, 2, 4, 5} and of(True) == {4}
    at = lambda m: datetime(2026, 1, 1, 5, m)
    levels = [(0, 95.0), (1, 30.0), (4, 30.0), (5, 50.0), (6, 30.0), (9, 30.0), (11, 30.0), (12, 20.0), (13, 99.0)]
    s = _batches(spark, tmp_path, [[(at(m), v)] for m, v in levels], "ts timestamp, v double", level="v").withColumn("watch", F.lit("w"))
    got = sorted((r.at, r.status) for r in jobs.run_to_table(jobs.watches(s, 90, 40, settle_s=300), "watches").collect())
    assert got == [(at(0), "alert"), (at(11), "ok"), (at(13), "alert")]


def test_two_horizons_of_sealing(spark, tmp_path):
    at = lambda m: datetime(2026, 1, 1, 5 + m // 60, m % 60)
    batches = [[(at(0), "done", True), (at(1), "open", False), (at(2), "late", False)], [(at(10), "done", False), (at(30), "late", True)], [(at(46), "x", False)], [(at(100), "y", False)], [(at(110), "y", True)]]
    s = _batches(spark, tmp_path, batches, "ts timestamp, t string, e boolean", txn="t", ends="e")
    got = {(r.txn, r.started_at, r.ended_at, r.n, r.ended) for r in jobs.run_to_table(jobs.seal_transactions(s), "sealed").collect()}
    assert got == {("done", at(0), at(10), 2, True), ("open", at(1), at(1), 1, False), ("late", at(2), at(30), 2, True)}


def _progress(stream, root):
    """A stream's rows and the reports of its batches."""
    stream.sparkSession.conf.set(*jobs.STATE_STORE)
    q = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/rows"), [p.stateOperators[0] for p in q.recentProgress]


def test_many_small_transactions_are_few_states(spark, tmp_path):
    """A state entry and a call for each of 6,000 transactions is what took the time."""
    at = lambda k: datetime(2026, 1, 1) + timedelta(seconds=k)
    batches = [[(at(k), f"t{k % 6000}", k % 2 == 0) for k in range(b * 6000, b * 6000 + 6000)] for b in range(2)] + [[(at(90_000), "end", False)]]
    s = _batches(spark, tmp_path, batches, "ts timestamp, t string, e boolean", txn="t", ends="e")
    got, states = _progress(jobs.seal_transactions(s, 20_000, 40_000), f"{tmp_path}/out")
    assert {(r.txn, r.started_at, r.ended_at, r.n, r.ended) for r in got.collect()} == {(f"t{k}", at(k), at(k + 6000), 2, k % 2 == 0) for k in range(6000)}
    assert max(x.numRowsTotal for x in states) < 4000
