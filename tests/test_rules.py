"""Rules that are easy to lose: absent is not zero, null-safe identities, ties, algebra of merges, planned reads."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import fields, roles
from millrace.operators import diff, docs, fold, forecast, lookup, read, risk, settle
from millrace.sources import logs, stitching
from tests.compare import plain

T = datetime


def values(df, *cols):
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("12", 12), (" 1e3 ", 1000), ("", None), ("NaN", None), ("true", None), (None, None), ("1.5x", None), ("-.5", -0.5)])
def test_number_or_null(spark, text, want):
    got = one(spark, fields.number_or_null(F.lit(text).cast("string")))
    assert (None if got is None else float(got)) == want


def test_small_functions(spark):
    assert one(spark, fields.plain_number(F.lit("10.500000").cast("decimal(20,6)"))) == "10.5"
    assert one(spark, fields.plain_number(F.lit("100").cast("decimal(20,6)"))) == "100"
    assert one(spark, fields.identity(F.lit("007"))) == "7" and one(spark, fields.identity(F.lit("624.0"))) == "624.0"
    assert one(spark, fields.departure_at(F.lit("20261002"), F.lit("930"), "Europe/London")) == T(2026, 10, 2, 8, 30)
    assert one(spark, fields.departure_at(F.lit("20261302"), F.lit("930"), "UTC")) is None
    twice = fields.redact(fields.redact(F.lit("password=abc; Bearer abcdefgh12")))
    assert one(spark, twice) == one(spark, fields.redact(F.lit("password=abc; Bearer abcdefgh12"))) == "password=<redacted> Bearer <redacted>"
    assert one(spark, fields.is_sensitive(F.lit("ApiKey"))) and not one(spark, fields.is_sensitive(F.lit("Location")))
    assert one(spark, fields.kv_block(F.lit("CONO :  911\nnoise\nFITN = 7\nCONO : 12"))) == {"CONO": "12", "FITN": "7"}
    assert one(spark, fields.record_blocks(F.lit("x : 1\nRecord: 1\nA = 1\nRecord: 2\nA = 2"))) == [{"A": "1"}, {"A": "2"}]
    assert one(spark, fields.promote(F.create_map(F.lit("user"), F.lit(" "), F.lit("USR"), F.lit("x")), ["User", "usr"])) == "x"
    assert one(spark, fields.excerpt(F.lit("abcdefghij"), 3, 2)) == "abc ... ij"
    assert one(spark, fields.keywords(F.lit("Where is the MMS200 of com.foo.Bar in Paris"))) == ["mms200", "com.foo.bar", "paris"]
    assert one(spark, fields.outcome(F.lit(4), F.lit(0))) == "zeroPick" and one(spark, fields.outcome(F.lit(None).cast("int"), F.lit(0))) is None
    assert one(spark, fields.count_variance(F.lit(90.0), F.lit(100.0)))["flagged"] and not one(spark, fields.count_variance(F.lit(99.0), F.lit(100.0)))["flagged"]
    assert one(spark, fields.parse_local(F.lit("2026-07-01 10:00"), "Europe/London")) == T(2026, 7, 1, 9)
    assert len(one(spark, fields.package_pairs(F.lit('[{"DeliveryNumber":"1","PackageNumber":"2"}]')))) == 1
    assert one(spark, fields.cut_label(F.lit("abcdef"), 4)) == "abc…" and one(spark, fields.last_segment(F.lit("http://h/a/b?x=1"))) == "b"


def test_fingerprint_is_canonical(spark):
    a = fields.fingerprint(q=(F.lit("10").cast("decimal(20,6)"), "number"), s=(F.lit(None).cast("string"), "text"))
    b = fields.fingerprint(q=(F.lit("10.0").cast("decimal(20,1)"), "number"), s=(F.lit(None).cast("string"), "text"))
    c = fields.fingerprint(q=(F.lit("10").cast("decimal(20,6)"), "number"), s=(F.lit(""), "text"))
    assert one(spark, a) == one(spark, b) != one(spark, c)


def test_bands(spark):
    assert [one(spark, roles.band(F.lit(v))) for v in (-3, 0, 0.9, 1, 2, 3, 4, 1e12)] == [0, 0, 0, 1, 2, 2, 3, 19]
    hist = F.array(*[F.lit(10 if i == 3 else 0).cast("bigint") for i in range(20)])
    assert one(spark, roles.percentile_of(hist, 0.5)) == 6.0
    assert one(spark, roles.percentile_of(F.array_repeat(F.lit(0).cast("bigint"), 20), 0.5)) is None


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(i, T(2026, 3, 28 + i // 20, i % 24, 5), "ab"[i % 2], None if i % 7 == 0 else f"{i}.5", i % 5) for i in range(60)]
    return spark.createDataFrame(rows, "row_id long, event_time timestamp, kind string, q string, who long")


M = fold.Metric("m", (fold.Measure("q", "stats", "q"), fold.Measure("h", "percentile", "q"), fold.Measure("last", "latest", "q"), fold.Measure("n", "count"), fold.Measure("some", "sum", "q", where="q IS NULL")), ("kind",))


def test_fold_of_a_union_is_the_merge_of_folds(facts):
    whole = fold.rollup(facts, M)
    parts = fold.rollup(facts.filter("row_id % 3 = 0"), M).unionByName(fold.rollup(facts.filter("row_id % 3 <> 0"), M))
    keys = ["bucket", *[f"dim{i}" for i in range(1, 7)]]
    cols = ["bucket", "dim1", "measure", "sum_value", "count_value", "min_value", "max_value", "histogram", "sum_sq"]
    assert values(whole, *cols) == values(fold.merged(parts, keys), *cols)
    assert values(whole.select("bucket", "dim1", F.col("latest.row").alias("r")).filter("r IS NOT NULL"), "bucket", "dim1", "r") == values(fold.merged(parts, keys).select("bucket", "dim1", F.col("latest.row").alias("r")).filter("r IS NOT NULL"), "bucket", "dim1", "r")


def test_day_from_hours_is_day_from_facts(facts):
    cols = ["bucket", "dim1", "measure", "sum_value", "count_value", "histogram"]
    assert values(fold.cascade(fold.rollup(facts, M, "hourly"), "daily"), *cols) == values(fold.rollup(facts, M), *cols)


def test_absent_is_not_zero_and_empty_cells_go(facts):
    got = {(r.measure, r.dim1): r.count_value for r in fold.merged(fold.rollup(facts, M), ["dim1"]).collect()}
    assert got[("n", "a")] == 30 and got[("q", "a")] == 25 and ("some", "a") not in got


def test_local_days_at_a_clock_change(spark):
    rows = [(1, T(2026, 3, 28, 23, 30)), (2, T(2026, 3, 29, 0, 30)), (3, T(2026, 3, 29, 22, 30)), (4, T(2026, 3, 29, 23, 30))]
    df = spark.createDataFrame(rows, "row_id long, event_time timestamp")
    got = values(fold.rollup(df, fold.Metric("m", (fold.Measure("n", "count"),)), "daily", "Europe/London"), "bucket", "count_value")
    assert got == [("'2026-03-28'", "1"), ("'2026-03-29'", "2"), ("'2026-03-30'", "1")]


@pytest.mark.parametrize(("zone", "at"), [("Europe/London", T(2026, 7, 1, 23, 30)), ("Europe/London", T(2026, 3, 29, 0, 30)), ("America/New_York", T(2026, 11, 1, 3, 30)), ("America/New_York", T(2026, 11, 1, 4, 30)), ("America/New_York", T(2026, 3, 9, 3, 30))])
def test_cascades_by_zone(spark, zone, at):
    rows = [(i, at + pd.Timedelta(hours=i - 2).to_pytimedelta(), "k", str(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, event_time timestamp, kind string, q string")
    m = fold.Metric("m", (fold.Measure("q", "sum", "q"),), ("kind",))
    cols = ["bucket", "dim1", "sum_value", "count_value"]
    assert values(fold.cascade(fold.rollup(df, m, "hourly"), "daily", zone), *cols) == values(fold.rollup(df, m, "daily", zone), *cols)
    with pytest.raises(Exception, match="do not start on an hour"):
        fold.cascade(fold.rollup(df, m, "hourly"), "daily", "Asia/Kolkata").collect()


def test_redaction(spark):
    text = '{"password": "hunter22", "M3Credentials": {"Domain": "x"}} %22token%22%3A%22abc%22 M3Credentials=zzz&user=al http://u:pw@h/ token = "b0" ReqID=7'
    want = '{"password": "<redacted>", "M3Credentials": "<redacted>"} %22token%22%3A%22<redacted>%22 M3Credentials=<redacted>&user=al http://u:<redacted>@h/ token = <redacted> ReqID=7'
    assert one(spark, fields.redact(F.lit(text))) == want == one(spark, fields.redact(F.lit(want)))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"password": 12345, "user": "al"}', '{"password": "<redacted>", "user": "al"}'),
        ('{"token": {"a": {"b": "xyz"}}, "n": 1}', '{"token": "<redacted>", "n": 1}'),
        ('{"password":"a\\"bc","x":"y"}', '{"password":"<redacted>","x":"y"}'),
        ('{"api_key": ["k1", {"k": "}"}], "z": true}', '{"api_key": "<redacted>", "z": true}'),
        ("my.access-token=abc,def&user=al", "my.access-token=<redacted>&user=al"),
        ("Secret: 'two words' and passwords are long", "Secret: <redacted> and passwords are long"),
        ("Authorization: Basic dXNlcjpwYXNz", "Authorization: Basic <redacted>"),
        ("", ""),
        (None, None),
    ],
)
def test_redaction_walks_over_whole_values(spark, text, want):
    c = F.lit(text).cast("string")
    assert one(spark, fields.redact(c)) == want == one(spark, fields.redact(fields.redact(c)))


def test_redaction_of_long_values(spark):
    long = '{"password": "' + 'a\\"' * 200_000 + '", "token": [' + "1, " * 100_000 + '1]}'
    assert one(spark, fields.redact(F.lit(long))) == '{"password": "<redacted>", "token": "<redacted>"}'


def test_blocks_keep_every_record_and_the_last_of_equal_keys(spark):
    text = "A : 1\nA = 2\nB: x y \n" + "".join(f"Record: {i}\nK : {i}\nK : last {i}\n" for i in range(300))
    got = one(spark, fields.record_blocks(F.lit(text)))
    assert len(got) == 300 and got[299] == {"K": "last 299"}
    assert one(spark, fields.kv_block(F.lit("A : 1\nB: x y \nA = 2"))) == {"A": "2", "B": "x y"}
    assert one(spark, fields.kv_block(F.lit(""))) == {} and one(spark, fields.record_blocks(F.lit("no blocks"))) == []


def test_metrics_that_a_change_cannot_concern(spark):
    rows = spark.createDataFrame([("2026-01-01 05:00:00", "a", 1.0, 1), ("2026-01-02 05:00:00", "b", 2.0, 2), (None, "c", 3.0, 3)], "t string, kind string, v double, row_id int").selectExpr("timestamp(t) AS event_time", "kind", "v", "row_id")
    m = lambda n, *w: fold.Metric(n, tuple(fold.Measure(f"m{i}", "sum", "v", where=x) for i, x in enumerate(w)))
    metrics = [m("a", "kind = 'a'"), m("b", "kind = 'b'"), m("either", "kind = 'z'", "v > 1"), m("all", None), m("unknown", "kind > NULL")]
    changes = rows.filter("kind = 'b'")
    assert fold.concerned(changes, metrics) == {"a": False, "b": True, "either": True, "all": True, "unknown": False}
    assert not any(fold.concerned(rows.limit(0), metrics).values())
    stored = {x.name: fold.rollup(rows, x) for x in metrics}
    new = rows.withColumn("v", F.when(F.col("kind") == "b", 9.0).otherwise(F.col("v")))
    cells, skipped = fold.refold_concerned(stored, new, changes.unionByName(new.filter("kind = 'b'")), metrics)
    assert skipped == ["a", "unknown"]
    cols = ["bucket", "measure", "sum_value", "count_value"]
    assert all(values(cells[x.name], *cols) == values(fold.rollup(new, x), *cols) for x in metrics)


def test_files_by_their_type(spark):
    rows = [(1, "text/html; charset=utf-8", "<title> T </title><h1>A <b>b</b></h1><p>x&amp;y</p><h2>C</h2>"), (2, "Text/Markdown", "# One\r\ntext\r\n## Two"), (3, "text/plain", "# no heading"), (4, "application/pdf", "%PDF"), (5, None, "x"), (6, "text/plain", None), (7, "text/html", "")]
    got = {r.doc_id: (r.kind, r.title, [tuple(h) for h in r.headings], r.text) for r in docs.uniform(spark.createDataFrame(rows, "doc_id int, mime string, content string")).collect()}
    assert got[1][:3] == ("html", "T", [(1, "A b"), (2, "C")]) and "x&y" in got[1][3]
    assert got[2] == ("markdown", "One", [(1, "One"), (2, "Two")], "# One\ntext\n## Two") and got[3] == ("text", None, [], "# no heading")
    assert got[4] == got[5] == (None, None, [], None) and got[6] == ("text", None, [], "") and got[7] == ("html", None, [], "")


def test_definitions_report_every_problem():
    bad = fold.Metric("m", (fold.Measure("a", "sum"), fold.Measure("a", "nope", "x"), fold.Measure("b", "sum", "stock")), tuple("abcdefg"), levels=("stock",)).validate()
    assert len(bad) == 5
    assert len(settle.Settlement("s", (), (settle.Value("x", "sum"), settle.Value("d", "difference", left="zz", right="x"), settle.Value("f", "flag", left="x", op="~"))).validate()) == 4


CALLS = "key string, row_id long, event_time timestamp, status string, expected string, picked string"


def test_release_with_refused_calls(spark):
    """One success (10 expected, 9 picked) and eight errors (1, 1): picked 9, calls 9, refused 8, short by 1."""
    rows = [("540551", 0, T(2026, 1, 1, 8), "success", "10", "9")] + [("540551", i, T(2026, 1, 1, 9, i), "error", "1", "1") for i in range(1, 9)]
    rows += [("A1", 1, None, "success", "4", "4"), ("A1", 2, T(2026, 1, 1), "success", "7", None), (None, 3, T(2026, 1, 1), "success", "1", "1")]
    s = settle.Settlement("release", ("key",), (
        settle.Value("expected", "first", "expected"), settle.Value("picked", "sum", "picked", where="status = 'success'"), settle.Value("refused", "count", where="status = 'error'"),
        settle.Value("shortfall", "difference", left="picked", right="expected"), settle.Value("is_short", "flag", left="shortfall", op="<", right_value=0), settle.Value("none", "max", "picked", where="status = 'x'"),
        settle.Value("zero", "sum", "picked", where="status = 'x'")))
    got = {r.key: r for r in settle.settle(spark.createDataFrame(rows, CALLS), s).collect()}
    r = got["540551"]
    assert (r.picked, r.calls, r.refused, r.shortfall, r.is_short, r.none, r.zero) == (9, 9, 8, -1, 1, None, 0)
    assert got["A1"].expected == 7 and None not in got


def test_conditions(spark):
    df = spark.createDataFrame([("5", "x"), ("-1", "y"), ("abc", "z"), (None, "w")], "v string, t string")
    assert values(settle.where(df, ["v<0"]), "t") == [("'y'",)] and values(settle.where(df, ["v=abc"]), "t") == [("'z'",)]
    assert settle.contradictions(["a=1", "a=2", "b<3"]) == ["a cannot be both 1 and 2"]
    with pytest.raises(ValueError):
        settle.condition("no operator here")


BEFORE_AFTER = {
    "zero pick": ([], [("a", "0.0", "h1")], {"a": "insert"}), "short pick": ([], [("a", "12.0", "h1")], {"a": "insert"}), "error": ([("a", None, "h1")], [("a", None, "h1")], {"a": "unchanged"}),
    "incomplete": ([("a", None, "h1")], [("a", "3", "h2")], {"a": "update"}), "late backfill": ([("a", "1", "h1")], [("a", "1", "h1"), ("b", "2", "h2")], {"a": "unchanged", "b": "insert"}),
    "rebuild": ([("a", "5", "h1")], [("a", "3", "h2")], {"a": "update"}), "rebuild unchanged": ([("a", "5", "h1")], [("a", "5", "h1")], {"a": "unchanged"}),
    "merge": ([("a", "2", "h1"), ("b", "3", "h2")], [("c", "5", "h3")], {"a": "reverse", "b": "reverse", "c": "insert"}),
    "split": ([("a", "7", "h1")], [("b", "4", "h2"), ("c", "3", "h3")], {"a": "reverse", "b": "insert", "c": "insert"}),
    "changed expectation": ([("a", "0.333333", "h1"), ("b", "1", "h2")], [("a", "0.666667", "h9"), ("b", "1", "h2")], {"a": "update", "b": "unchanged"}),
}


@pytest.mark.parametrize("case", sorted(BEFORE_AFTER))
def test_transitions(spark, case):
    before, after, want = BEFORE_AFTER[case]
    frame = lambda rows: spark.createDataFrame([(i, None, q, h) for i, q, h in rows], "id string, at timestamp, q string, digest string")
    got = diff.range_diff(frame(before), frame(after), ["id", "at"], "digest").collect()
    assert {r.id: r.action for r in got} == want
    again = diff.range_diff(frame(after), frame(after), ["id", "at"], "digest").collect()
    assert {r.action for r in again} == {"unchanged"}


def test_as_of_takes_the_newest_period_that_covers(spark):
    seen = spark.createDataFrame([("k", "a", T(2026, 1, 1)), ("k", "b", T(2026, 2, 1)), ("k", "b", T(2026, 2, 5)), ("k", "a", T(2026, 3, 1)), (None, "z", T(2026, 1, 1))], "key string, value string, at timestamp")
    periods = lookup.build_validity(seen, "key", "value", "at")
    asks = spark.createDataFrame([("k", T(2020, 1, 1)), ("k", T(2026, 2, 1)), ("k", T(2026, 3, 5)), ("x", T(2026, 1, 1)), (None, T(2026, 1, 1))], "k string, t timestamp")
    for fn in (lookup.as_of, lookup.as_of_disjoint):
        assert values(fn(asks, periods, "k", F.col("t"), "v"), "v") == [("'a'",), ("'a'",), ("'b'",), ("None",), ("None",)]
    assert lookup.build_validity(seen, "key", "value", "at", "first_wins").first()["value"] == "a"


def test_one_boundary_without_gap_or_overlap():
    plan = read.plan_read(T(2026, 1, 1, 5, 30), T(2026, 1, 20), T(2026, 1, 10, 7), "daily")
    assert plan.live == ((T(2026, 1, 1, 5, 30), T(2026, 1, 2)), (T(2026, 1, 10), T(2026, 1, 20))) and plan.settled_from == T(2026, 1, 2)
    assert read.plan_read(T(2026, 1, 1), T(2026, 1, 1, 3), T(2026, 1, 10), "daily").settled_from is None
    assert [read.choose_grain(T(2026, 1, 1), T(2026, 1, d), 1) for d in (2, 20)] == ["hourly", "daily"] and read.choose_grain(T(2020, 1, 1), T(2026, 1, 1)) == "monthly"


def test_ranges_and_splits(spark):
    r = spark.createDataFrame([(1, 0, 10), (1, 3, 4), (1, 12, 20), (1, 50, 60), (2, 0, 1)], "k int, lo long, hi long")
    assert values(diff.coalesce_ranges(r, ["k"], 2), "k", "lo", "hi") == [("1", "0", "20"), ("1", "50", "60"), ("2", "0", "1")]
    assert values(diff.split_ranges(spark.createDataFrame([(0, 25), (5, 5)], "lo long, hi long"), 10), "lo", "hi") == [("0", "10"), ("10", "20"), ("20", "25"), ("5", "5")]


LINES = """before
2026-05-19 13:42:33,362 (AL) [94] INFO  a.B Go - REQUEST (ReqID = 7) - : http://h/x
2026-05-19 13:42:33,391 (null) [94] DEBUG a.B LogAPICall - MI Program: P1  Transaction: T1  NumberOfRecs: 2
   CONO :  911
2026-05-19 13:42:33,400 (BO) [94] INFO a.B Go - REQUEST: http://h/y
2026-05-19 13:42:33,500 (AL) [94] ERROR a.B LogAPIResult - MI Program: P1  Transaction: T1  Result: bad
2026-05-19 13:42:33,600 (BO) [95] WARN a.B Go - RESPONSE: done
2026-05-19 13:42:33,700 (BO) [94] INFO a.B Go - late work
2026-05-19 13:52:33,700 (BO) [94] INFO a.B Go - much later"""


def test_log_text_to_transactions(spark):
    df = spark.createDataFrame([("S", LINES.replace("\n", "\r\n"))], "source_file string, value string")
    e = logs.classify_entry(logs.parse_header(logs.split_entries(df)))
    rows = e.orderBy("line_number").collect()
    assert [r.entry_type for r in rows] == ["request", "call", "request", "error", "response", "info", "info"]
    assert [r.line_number for r in rows] == [2, 3, 5, 6, 7, 8, 9] and rows[1].user_ctx is None and rows[0].request_id == "7"
    lines = e.withColumn("server", F.col("source_file")).withColumn("row_id", F.col("line_number"))
    txn = {r.row_id: r.txn for r in logs.stitch(lines).collect()}
    assert txn[2] == txn[3] and txn[5] == txn[7] == txn[8] != txn[2] and txn[9] not in (txn[5], txn[2])
    got = logs.summarise(logs.stitch(lines).join(lines.drop("server"), "row_id"))
    assert {r.txn: r.status for r in got.collect()}[txn[5]] == "soft"


def test_stitching_is_the_same_in_one_group(spark):
    import random

    rng = random.Random(2)
    kinds = ["request", "info", "response", "call"]
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.1, 1, 5, 400 if i % 50 == 0 else 2])
        rows.append(("s", i, pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=t), f"t{rng.randrange(3)}", rng.choice(["A", "B", None]), rng.choice(kinds), None))
    cols = ["server", "row_id", "at", "thread", "user_ctx", "entry_type", "request_id"]
    pdf = pd.DataFrame(rows, columns=cols)
    want = {r.row_id: r.txn for r in stitching.stitch_group(pdf).itertuples()}
    df = spark.createDataFrame([tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in r) for r in rows], "server string, row_id long, at timestamp, thread string, user_ctx string, entry_type string, request_id string")
    assert {r.row_id: r.txn for r in logs.stitch(df).collect()} == want


def test_sections_and_chunks(spark):
    text = "intro\n# A\none\n## B\n\ntwo words here\n# C\n\n### D\nthree"
    df = spark.createDataFrame([(1, text), (2, None), (3, "# only")], "doc_id long, text string")
    got = values(docs.sections(df), "doc_id", "nr", "level", "path", "body")
    assert [g[3] for g in got] == ["''", "'A'", "'A > B'", "'C > D'"]
    body = "Para one. It goes on.\n\n" + "word " * 300 + "\n" + "x" * 500
    parts = docs.pack(body, 120, 30)
    assert all(len(p) <= 120 for p in parts) and "".join(docs.pack(body, 120, 0)) == body and set(body) == set("".join(parts))


def test_forecast_models():
    import numpy as np

    y = np.arange(28, dtype=float)
    assert forecast.forecast_one(y, "seasonal_naive", 8).tolist() == [21, 22, 23, 24, 25, 26, 27, 21]
    assert forecast.forecast_one(y, "moving_average", 1)[0] == y[-7:].mean()
    assert forecast.forecast_one(np.tile([1.0, 2, 3, 4, 5, 6, 7], 8), "weekday_mean", 7).tolist() == [1, 2, 3, 4, 5, 6, 7]
    assert abs(forecast.forecast_one(np.tile([1.0, 2, 3, 4, 5, 6, 7], 8), "weekly_smoothing", 7) - np.arange(1, 8)).max() < 0.2
    assert np.isnan(forecast.forecast_one(y[:5], "moving_average", 1)[0])


def test_tiers_and_watches(spark):
    at = lambda h: F.lit(f"2026-01-01 {h}").cast("timestamp")
    state = lambda **k: {c: F.lit(v) for c, v in ({"expected": 5, "confirmed": 5, "created": 4, "loaded": 0, "loads": True} | k).items()} | {"usual": at("09:00"), "dock_last": F.lit(None).cast("timestamp")}
    over = lambda s, *hours: [one(spark, risk.tier(s, at(h))) for h in hours]
    assert over(state(), "06:59", "07:00", "09:29", "09:30") == ["none", "at_risk", "at_risk", "left_behind"]
    assert over(state(loaded=4, confirmed=3), "08:00") == ["watch"] and over(state(loaded=4), "08:00", "23:00") == ["none", "none"]
    assert over(state() | {"dock_last": at("09:20")}, "09:40", "09:50") == ["at_risk", "left_behind"]
    assert over(state(loads=False, confirmed=3), "08:00", "09:30") == ["watch", "left_behind"]
    assert over(state(expected=None, confirmed=0, loads=False) | {"expected": F.lit(None).cast("int")}, "08:00") == ["watch"]
    rows = [("w", i, v) for i, v in enumerate([1, 95, 50, 10, 10, 10, 99, 10, 50])]
    got = risk.assess(spark.createDataFrame(rows, "w string, at int, v int"), "w", "at", "v", 90, 40, 3)
    assert [r.status for r in got.orderBy("at").collect()] == ["ok", "alert", "alert", "alert", "alert", "ok", "alert", "alert", "alert"]


def test_targets(spark):
    got = forecast.targets(spark, "2026-03-27", "day", 3, "Europe/London").collect()
    assert [r.instant for r in got] == ["2026-03-28 00:00:00", "2026-03-29 00:00:00", "2026-03-29 23:00:00"]
