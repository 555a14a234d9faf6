"""Queries without SQL beside plain Python over the whole of a small table."""

import functools
import re

import numpy as np
import pandas as pd
import pytest

from millrace.functions import fields
from millrace.operators import docs, forecast
from millrace.plans import q_docs, q_forecast, registry
from millrace.sources import logs, stitching

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, SF)


@pytest.fixture(scope="module")
def marked(spark):
    return {r.doc_id: r.text or "" for r in q_docs._marked(spark, SF).collect()}


def plain_sections(text):
    """Lines one by one: a heading ends a section and clears the deeper headings of its path."""
    path, body, out, nr = [], [], [], 0
    for line in [*text.split("\n"), None]:
        m = re.fullmatch(r"(#{1,6})[ \t]+(.+?)[ \t]*", line) if line is not None else None
        if line is None or m:
            if joined := "\n".join(body).strip():
                out.append((nr, path[-1][0] if path else 0, [h for _, h in path], joined))
            if line is None:
                return out
            nr, body = nr + 1, []
            path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), m[2])]
        else:
            body.append(line)


def test_sections(spark, marked):
    want = set()
    for i, t in marked.items():
        for nr, level, path, body in plain_sections(t):
            end = (path[0], path[-1]) if path else (None, None)
            want.add((i, nr, level, " > ".join(path), len(path), end[0], path[-2] if len(path) > 1 else None, end[1], body))
    got = {(r.doc_id, r.nr, r.level, r.path, r.depth, r.root, r.parent, r.heading, r.body) for r in run(spark, "page_sections").collect()}
    assert got == want and len(want) >= 100


def test_chunks(spark, marked):
    secs = {(i, nr): (" > ".join(path), body) for i, t in marked.items() for nr, _, path, body in plain_sections(t)}
    leaves = {}
    for r in run(spark, "page_chunks").collect():
        path, _ = secs[r.doc_id, r.nr]
        text = r.embed_text.removeprefix(path + "\n") if path else r.embed_text
        leaves.setdefault((r.doc_id, r.nr), {})[r.leaf] = text
    assert set(leaves) == set(secs)
    for k, (_, body) in secs.items():
        got = [leaves[k][i] for i in sorted(leaves[k])]
        assert (got == [body]) if len(got) == 1 else all(len(x) <= 128 * 4 for x in got)
        at = 0
        for x in got:  # each starts at or before the end of the one before, and nothing is lost
            here = body.find(x, max(0, at - 16 * 4 - 1))
            assert 0 <= here <= at
            at = here + len(x)
        assert at == len(body)


def test_parents_hold_their_leaves(spark):
    text = "word " * 300
    got = docs.chunk(spark.createDataFrame([(1, 0, text.strip()), (2, 3, "short")], "doc_id long, nr int, body string"), most_tokens=64, overlap_tokens=0).collect()
    own = {(r.doc_id, r.leaf): (r.parent, r.text) for r in got}
    assert own[2, -1] == (None, "short") and (2, 0) not in own and own[1, -1][1] == text.strip() and own[1, 0][0] == 0
    assert "".join(own[1, i][1] for i in range(len(own) - 2)) == text.strip()


def test_merged_chunks(spark, marked):
    want = set()
    for i, t in marked.items():
        parts, now = [], None
        for nr, _, _, body in plain_sections(t):
            leaves = docs.pack(body, 64 * 4, 0)
            for x in leaves if len(leaves) > 1 else [body]:
                if now is not None and len(now) + 1 + len(x) <= 2048:
                    now += "\n" + x
                else:
                    parts += [now] if now is not None else []
                    now = x
        want |= {(i, k, p) for k, p in enumerate([*parts, *([now] if now is not None else [])])}
    assert {(r.doc_id, r.part, r.text) for r in run(spark, "merged_chunks").collect()} == want


def test_keywords(spark):
    text = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in run(spark, "query_keywords").collect():
        found = [w.lower() for w in re.findall(r"\b([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+|[A-Z][A-Za-z0-9]+)\b", text[r.conv_id, r.turn] or "")]
        assert r.words == " ".join(dict.fromkeys(w for w in found if w not in fields.STOP and len(w) > 1))


def plain_errors(y, a, g, season):
    """One-step errors and the last state of a level and a week, one day at a time."""
    level, season, errors = 0.0, list(season), []
    for t, v in enumerate(y):
        e = v - level - season[t % 7]
        errors.append(e)
        level, season[t % 7] = level + a * e, season[t % 7] + g * e
    return errors, level, season


def plain_fit(y, a, g):
    """Squared error, level and season with the first season of least squares, by the errors' differences."""
    zero = np.array(plain_errors(y, a, g, [0.0] * 7)[0])
    moves = np.array([np.array(plain_errors(y, a, g, np.eye(7)[k])[0]) - zero for k in range(7)]).T
    first = np.linalg.lstsq(moves, -zero, rcond=None)[0]
    errors, level, season = plain_errors(y, a, g, first)
    return sum(e * e for e in errors), level, season


def smoothed(y, h):
    """The forecast by plain arithmetic under the weights that the library found; that these are good is tested apart."""
    a, g = forecast.fit_smoothing([np.array(y)])[0][0]
    _, level, season = plain_fit(y, a, g)
    return [max(0.0, level + season[(len(y) + k) % 7]) for k in range(h)]


def old_grid(y):
    """Least squared error over a small grid of weights with the first two weeks' means as the first state."""
    best = None
    for a in (0.05, 0.1, 0.2, 0.4):
        for g in (0.0, 0.05, 0.1, 0.2):
            level = sum(y[:14]) / 14
            season = [(y[k] + y[k + 7]) / 2 for k in range(7)]
            lost = sum(e * e for e in plain_errors(y, a, g * (1 - a), season)[0])
            best = lost if best is None else min(best, lost)
            assert abs(level - sum(season) / 7) < 1e-9
    return best


def test_smoothing_is_fitted(series):
    rng = np.random.default_rng(5)
    many = [np.array(y[:300]) for y in series.values()][:2]
    many += [np.maximum(0, 20 + 5 * np.sin(np.arange(n)) + np.cumsum(rng.normal(0, s, n)) + rng.normal(0, 3, n)) for n, s in ((21, 0.1), (60, 1.0), (200, 0.3), (300, 4.0))]
    many += [np.zeros(30), np.full(25, 3.0), np.tile([1.0, 2, 3, 4, 5, 6, 7], 8)]
    weights, lost, state = forecast.fit_smoothing(many)
    for y, (a, g), e, s in zip(many, weights, lost, state, strict=True):
        assert a >= 0 and g >= 0 and a + g <= 1 + 1e-12
        plain, level, season = plain_fit(y, a, g)
        assert np.isclose(e, plain, rtol=1e-6, atol=1e-6)
        ahead = (len(y) + np.arange(7)) % 7
        assert np.allclose(s[0] + s[1 + ahead], level + np.array(season)[ahead], rtol=1e-5, atol=1e-5)
        assert e <= old_grid(list(y)) * (1 + 1e-9) + 1e-9
        if len(y) <= 60:  # nothing on a finer grid is better by more than a hundredth
            assert e <= min(plain_fit(y, i / 10, j / 10)[0] for i in range(11) for j in range(11 - i)) * 1.01 + 1e-6
        alone = forecast.weekly_smoothing([y], 7)[0]
        assert np.allclose(alone, forecast.weekly_smoothing(many, 7)[[id(m) for m in many].index(id(y))], rtol=1e-6, atol=1e-6)


def models(y, h):
    """The models as they are worded, one value at a time."""
    n, hits = len(y), [v for v in y if v > 0]
    out = {"seasonal_naive": [y[n - 7 + k % 7] for k in range(h)], "moving_average": [sum(y[-7:]) / 7] * h, "weekday_mean": []}
    for k in range(h):
        same = [y[i] for j in (1, 2, 3, 4) if 0 <= (i := n + k - 7 * j) < n]
        out["weekday_mean"].append(sum(same) / len(same) if same else sum(y[-7:]) / 7)
    if hits:
        first = next(i for i, v in enumerate(y) if v > 0)
        p, z = 1 / (first + 1), y[first]
        for v in y[first + 1 :]:
            p, z = p + 0.1 * ((v > 0) - p), z + (0.1 * (v - z) if v > 0 else 0)
        out["croston_tsb"] = [p * z] * h
    else:
        out["croston_tsb"] = [0.0] * h
    out["weekly_smoothing"] = smoothed(y, h) if n >= 21 else None
    return out


@functools.lru_cache(maxsize=None)
def plain_backtest(y, folds=6, h=7):
    kind = forecast.class_of(np.array(y))
    names = [m for m in forecast.MODELS if (m != "croston_tsb" or kind in forecast.SPARSE) and (m != "weekly_smoothing" or (len(y) >= 21 and kind not in forecast.SPARSE))]
    runs = []
    for f in range(folds):
        cut = len(y) - h - f
        if cut >= 14:
            runs.append((y[cut : cut + h], models(y[:cut], h)))
    names = [m for m in names if all(r[1][m] is not None for r in runs)]
    actual = [v for a, _ in runs for v in a]
    got = {m: [v for _, r in runs for v in r[m]] for m in names}

    def rank(m):
        lost = [abs(p - a) for p, a in zip(got[m], actual)]
        return (round(sum(lost) / sum(map(abs, actual)), 12) if sum(map(abs, actual)) > 0 else float("inf"), sum(lost) / len(lost), (*forecast.MODELS, forecast.BLEND).index(m))

    top = sorted(names, key=rank)[:2]
    if len(top) == 2 and sum(map(abs, actual)) > 0:
        got[forecast.BLEND] = [(a + b) / 2 for a, b in zip(got[top[0]], got[top[1]])]
    return actual, got, sorted(got, key=rank)


@pytest.fixture(scope="module")
def series(spark):
    out = {}
    for r in q_forecast._daily(spark, SF).orderBy("subject", "day").collect():
        out.setdefault(r.subject, []).append(r.y)
    return out


def test_best_models(spark, series):
    got = {r.subject: r for r in run(spark, "best_models").collect()}
    assert set(got) == set(series)
    for s, y in series.items():
        actual, _, order = plain_backtest(tuple(y))
        assert (got[s].model, got[s].second) == tuple(order[:2])


def test_intervals(spark, series):
    for r in run(spark, "prediction_intervals").collect():
        actual, got, _ = plain_backtest(tuple(series[r.subject]))
        res = np.array(got[r.model]) - np.array(actual)
        steps = {k + 1: res[k::7] for k in range(7)}
        own = steps.get(r.step)
        if own is None:
            own = max(steps.values(), key=lambda x: round(float(np.std(x)), 9))
        lo, hi = r.yhat - np.quantile(own, 0.9), r.yhat - np.quantile(own, 0.1)
        if hi - lo <= 0:
            lo, hi = r.yhat * 0.8, r.yhat * 1.2
        assert np.isclose(r.p10, max(0, lo)) and np.isclose(r.p90, max(0, hi, r.yhat))


def test_bands_that_are_not_earned(spark):
    tested = spark.createDataFrame([("s", "m", 0, 1, 10.0, 12.0), ("s", "m", 1, 1, 10.0, 9.0), ("s", "m", 0, 2, 10.0, 15.0), ("s", "m", 1, 2, 10.0, 10.0)], "subject string, model string, fold int, step int, actual double, yhat double")
    points = spark.createDataFrame([("s", "m", 1, 100.0), ("s", "m", 9, 1.0), ("t", "m", 1, 5.0)], "subject string, model string, step int, yhat double")
    got = {(r.subject, r.step): (r.p10, r.p90) for r in forecast.intervals(tested, points).collect()}
    half = 1.28 * float(np.std([2.0, -1.0, 5.0, 0.0]))
    assert got["s", 1] == (80.0, 120.0) and np.allclose(got["s", 9], (max(0, 1 - half), 1 + half)) and got["t", 1] == (0.0, 10.0)


def test_stitched_transactions(spark):
    e = q_docs._entries(spark, SF).selectExpr("source_file AS server", "line_number AS row_id", "at", "thread", "user_ctx", "entry_type", "request_id", "result_status", "level").toPandas()
    txn = pd.concat([stitching.stitch_group(g) for _, g in e.groupby("server")]).merge(e, on=["server", "row_id"])
    want = set()
    for t, g in txn.groupby("txn"):
        soft = ((g.entry_type == "result") & g.result_status.notna() & (g.result_status != "OK")) | (g.level == "WARN")
        status = "error" if (g.entry_type == "error").any() else "incomplete" if not (g.entry_type == "response").any() else "soft" if soft.any() else "success"
        want.add((t, len(g), status))
    assert {(r.txn, r.lines, r.status) for r in run(spark, "stitched_transactions").collect()} == want


def test_idle_streams_end_while_the_server_is_busy():
    rows = [("s", 0, pd.Timestamp(0, unit="s"), "t1", "A", "request", None), ("s", 99, pd.Timestamp(1900, unit="s"), "t1", "A", "info", None)]
    rows += [("s", i, pd.Timestamp(100 * i, unit="s"), "t2", "B", "info", None) for i in range(1, 19)]
    cols = ["server", "row_id", "at", "thread", "user_ctx", "entry_type", "request_id"]
    got = {r.row_id: r.txn for r in stitching.stitch_group(pd.DataFrame(rows, columns=cols)).itertuples()}
    assert got[0] != got[99] and len({got[i] for i in range(1, 19)}) == 1


def test_log_files_below_a_path(spark, tmp_path):
    (tmp_path / "a.log").write_text("before\n2026-05-19 13:42:33,362 (AL) [94] INFO  a.B Go - REQUEST: http://h/x\n  more\n2026-05-19 13:42:34,000 () [94] WARN  a.B LogAPIResult - (ReqID = 7): MI Program: P1  Transaction: T1     Result: bad\n")
    got = logs.classify_entry(logs.parse_header(logs.read_log_entries(spark, str(tmp_path)))).orderBy("line_number").collect()
    assert [(r.line_number, r.entry_type, r.user_ctx, r.body) for r in got] == [(2, "request", "AL", "  more"), (4, "result", None, "")] and (got[1].request_id, got[1].result_status, got[1].call) == ("7", "bad", "P1.T1")
