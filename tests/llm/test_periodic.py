"""Periodic runs beside brute force over all stretches' periods."""

import hashlib
import time
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic, queries


def brute(w):
    """Every maximal stretch of every lag, kept if its smallest period is the lag."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x - p] for x in range(start + p, j)) for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(w):
    return periodic.runs(np.array(w, np.int64))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_runs_of_few_words(w):
    assert found(w) == brute(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_units(units):
    w = [x for unit, times in units for x in unit * times]
    assert found(w) == brute(w)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=100, max_size=400))
def test_many_diagonals_at_once(w):
    assert found(w) == brute(w)


@pytest.mark.parametrize("w", [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2, 3] * 4, [1, 2, 3] * 3 + [1, 2], ([1] * 30 + [2]) * 5, [1, 1, 2] * 9 + [1, 1, 1] * 9], ids=str)
def test_edges(w):
    assert found(w) == brute(w)


def test_long_texts_end_soon():
    for w in ([7] * 300_000, [1, 2, 3, 4] * 75_000, ([1] * 200 + [2]) * 60, list(range(50_000)) * 6):
        began = time.perf_counter()
        got = found(w)
        assert got and time.perf_counter() - began < 60
    assert got == [(0, 300_000, 50_000)]


def plain(doc, text):
    w = [x for x in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
    h = crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    got = brute(w)
    drop = {x for s, m, q in got for x in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = sorted(got, key=lambda r: (-r[1], r[0], r[2]))[:1]
    best = (*top[0], top[0][1] * 1000 // top[0][2]) if top else (None,) * 4
    return (doc, len(got), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in got)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_beside_brute_force(spark, tmp_path):
    texts = [None, "", " \t ", "a b " * 6, "x " * 3000, "é ç é " * 9, "one two three " * 5 + "four", "A a " * 5]
    rows = [(i if i % 9 else None, texts[i % len(texts)], "x") for i in range(120)] + [(3, "a " * 9, "x")] * 2
    rows += [(1000 + i, " ".join(f"w{(x * x + i) % 37}" for x in range(60 + i)), "x") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted((plain(d, t) for d, t, _ in rows), key=key)
    assert any(r[1] for r in got) and any(crc32(str(d).encode()) % 10 == 0 for d, _, _ in rows)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_spans_keep_texts(spark):
    got = periodic.spans(spark.createDataFrame([(1, "go " * 7 + "on"), (2, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(1, [(0, 7, 1)], "go on"), (2, [], "")]
