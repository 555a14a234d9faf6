"""Stitching: a plain loop over all open streams, the machine in one pass, the dealt-out form and the stream."""

import random
import time

import pandas as pd
import pytest

from millrace.sources import stitching
from millrace.streaming import jobs

S = 1_000_000
SCHEMA = "server string, row_id long, at timestamp, thread string, user_ctx string, entry_type string, request_id string"


def plain(lines):
    """line -> transaction, by looking through every transaction for each line."""
    all_, owner, out = [], {}, {}
    for row_id, t, thread, user, kind, rid in lines:
        live = lambda x: x["closed"] is None and (t is None or t - x["last"] <= 300 * S)  # noqa: B023, E731
        holding = lambda slot: next((x for x in all_ if slot in x["slots"] and live(x)), None)  # noqa: B023, E731
        slot = (thread, user) if user is not None or rid is None else (thread, "id", rid)
        x = None
        if rid is not None:
            x = next((x for x in all_ if x["rid"] == rid and live(x)), None)
        elif user is None:
            if (x := holding(owner.get(thread))) is not None:
                slot = owner[thread]
            else:
                x = holding(slot)
        elif kind == "response":
            mine = [x for x in all_ if live(x) and any(s[1] == user and len(s) == 2 for s in x["slots"])]
            x = min(mine, key=lambda x: (-x["last"], x["nr"]), default=None)
        else:
            x = holding(slot)
        if x is not None and kind == "request" and rid is None and x["request"]:
            x = None
        if x is None and kind not in ("request", "response"):
            tails = [x for x in all_ if x["closed"] is not None and slot in x["was"] and t - x["closed"] <= S // 4]
            x = max(tails, key=lambda x: x["order"], default=None)
        if x is None:
            x = {"nr": row_id, "id": f"s:{row_id}", "last": t, "slots": set(), "rid": rid, "request": False, "closed": None, "was": set(), "order": 0}
            all_.append(x)
        owner[thread] = slot
        x["request"] |= kind == "request"
        x["last"] = t
        if x["closed"] is None:
            if kind != "response" or not x["slots"]:
                for y in all_:
                    y["slots"].discard(slot)
                x["slots"].add(slot)
            if kind == "response":
                x["closed"], x["was"], x["slots"], x["order"] = t, x["slots"], set(), len(out)
        out[row_id] = x["id"]
    return out


def lines(seed, n=700, users=9, threads=4):
    rng = random.Random(seed)
    t, out, rid = 0, [], None
    for i in range(n):
        t += rng.choice([0, 1000, 40_000, 200_000, 300_000, S, 20 * S, 290 * S if i % 40 == 0 else S, 301 * S if i % 90 == 0 else 2 * S])
        user = rng.choice([f"U{rng.randrange(users)}", f"U{i // 120}", None])
        if rng.random() < 0.25:
            rid = f"r{i // rng.choice([5, 9])}"
        stamped = rid if rng.random() < 0.2 else None
        out.append((i, t, f"t{rng.randrange(threads)}", user, rng.choice(["request", "info", "info", "call", "response"]), stamped))
    return out


def frame(spark, rows, server="s"):
    return spark.createDataFrame([(server, i, pd.Timestamp(t, unit="us").to_pydatetime() if t is not None else None, *r) for i, t, *r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(12))
def test_the_machine_is_the_plain_loop(seed):
    rows = lines(seed, users=[2, 9][seed % 2], threads=[1, 4, 9][seed % 3])
    pdf = pd.DataFrame([("s", i, pd.Timestamp(t, unit="us"), *r) for i, t, *r in rows], columns=stitching.COLUMNS)
    got = {r.row_id: r.txn for r in stitching.stitch_group(pdf).itertuples()}
    assert got == plain(rows)


@pytest.mark.parametrize(("seed", "slice_s"), [(1, 3600), (3, 60), (4, 600)])
def test_one_busy_server_dealt_out_by_users(spark, seed, slice_s):
    rows = lines(seed, 900, users=12, threads=5)
    got = stitching.stitch(frame(spark, rows).repartition(5), slice_s).collect()
    assert {r.row_id: r.txn for r in got} == plain(rows) and len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r.txn, []).append(r.seq)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())


def test_a_server_that_is_never_silent_goes_to_many_tasks(spark):
    """Twelve users without request ids, never 300 s of silence: as many units, each swept by itself."""
    rows = [(i, i * S, f"t{i % 7}", f"U{i % 12}" if i % 5 else None, ["request", "info", "info", "response"][i // 12 % 4], None) for i in range(3000)]
    swept = []
    true = stitching._swept

    def spied(df, unit, whole):
        swept.append(df.select(*unit).distinct().count())
        return true(df, unit, whole)

    stitching._swept = spied
    try:
        got = {r.row_id: r.txn for r in stitching.stitch(frame(spark, rows)).collect()}
    finally:
        stitching._swept = true
    assert swept[0] >= 8 and got == plain(rows)


def test_time_grows_with_the_lines():
    def took(n):
        rows = lines(5, n, users=400, threads=60)
        pdf = pd.DataFrame([("s", i, pd.Timestamp(t // 400, unit="us"), *r) for i, t, *r in rows], columns=stitching.COLUMNS)
        began = time.perf_counter()
        stitching.stitch_group(pdf)
        return time.perf_counter() - began

    small, large = took(20_000), took(200_000)
    assert large < 25 * small and large < 60


def test_lines_without_time_thread_or_server(spark):
    rows = [("s", 1, 0, "t", "A", "request", None), ("s", 2, None, "t", "A", "info", None), (None, 3, 0, None, None, "info", None), (None, 4, 5, None, None, "info", None), ("s", 5, 9, "t", "B", "info", None)]
    df = spark.createDataFrame([(s, i, None if t is None else pd.Timestamp(t, unit="s").to_pydatetime(), *r) for s, i, t, *r in rows], SCHEMA)
    got = {r.row_id: r.txn for r in stitching.stitch(df).collect()}
    assert got == {1: "s:1", 2: "s:1", 3: ":3", 4: ":3", 5: "s:5"}
    assert stitching.stitch(df.limit(0)).count() == 0


def test_a_stream_of_shuffled_parts_is_the_batch_form(spark, tmp_path):
    """Parts in any order of time; a last line far ahead moves the watermark past all others."""
    rows = lines(7, 240, users=4, threads=3)
    order = rows[:]
    random.Random(1).shuffle(order)
    within = [order[k::3] for k in range(3)]
    for k, part in enumerate(within):
        frame(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    end = max(t for _, t, *_ in rows) + 90_000 * S
    frame(spark, [(10**6, end, "t", "Z", "info", None)], "other").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    got = jobs.run_to_table(stitching.stitch_stream(stream, "20000 days"), "stitched").collect()
    assert got == []  # nothing is told before the watermark has passed it
    got = jobs.run_to_table(stitching.stitch_stream(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), "1 day"), "stitched").collect()
    want = plain(rows)
    assert {r.row_id: r.txn for r in got if r.row_id is not None} == want
    ends = {r.txn: r.ended for r in got if r.row_id is None}
    assert set(ends) == set(want.values()) and {"response", "silence"} == set(ends.values())


def test_the_streamed_query_is_the_batch_form(spark):
    from pyspark.sql import functions as F

    from millrace.plans import q_streams, registry
    from millrace.plans.base import facts

    sf = "/root/testdata/sf0.001"
    got = {r.row_id: r.txn for r in registry.queries()["stream_stitched"](spark, sf).collect() if r.row_id is not None}
    events = facts(spark, sf).select(F.col("event_time").alias("at"), "row_id", "user_id", "method")
    want = {r.row_id: r.txn for r in stitching.stitch(q_streams.conversation_lines(events)).collect()}
    assert len(got) > 0.9 * len(want) and all(want[k] == v for k, v in got.items())
