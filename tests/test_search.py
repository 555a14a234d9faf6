"""Search answers every query, also beyond one block of them."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import search


def test_more_queries_than_a_block(spark):
    rows = [(i, [float(i % 7) + 1, float(i % 5), float(i % 3)]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.selectExpr("id AS query_id", "embedding AS query")
    plain = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    want = {(i, j, k + 1) for i in plain for k, j in enumerate(sorted(plain, key=lambda j: (-round(float(plain[i] @ plain[j]), 12), j))[:3])}
    got = {(r.query_id, r.id, r.rank) for r in search.nearest(q, v, 3, block=7).collect()}
    assert len(got) == 120 and {x[:2] for x in got} == {x[:2] for x in want}


def test_every_query_is_answered(spark):
    v = spark.range(1500).selectExpr("id", "array(cast(id % 37 + 1 AS float), cast(id % 11 AS float), 1.0f) AS embedding", "id % 2 AS label")
    q = v.selectExpr("id AS query_id", "embedding AS query")
    got = search.nearest(q, v, 1, where=F.col("label") == 0).collect()
    assert len(got) == 1500 and all(r.id % 2 == 0 for r in got)
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0, 0.0])], "query_id long, query array<float>")
    assert search.nearest(none, v, 3).count() == 0


def brute(queries, vectors, k):
    """Every query against every vector, in Python."""

    def of(v):
        return None if not v or any(x is None or x != x or abs(x) == float("inf") for x in v) or not any(v) else [float(np.float32(x)) for x in v]

    out = set()
    for i, q in queries:
        if (a := of(q)) is None:
            continue
        got = []
        for j, v in vectors:
            if (b := of(v)) is not None and len(a) == len(b):
                dot = sum(x * y for x, y in zip(a, b))
                got.append((-round(dot / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 9), j))
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(sorted(got)[:k])}
    return out


def found(spark, queries, vectors, k):
    q = spark.createDataFrame(queries, "query_id long, query array<float>")
    v = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(3)
    return {(r.query_id, r.id, r.rank) for r in search.nearest(q, v, k).collect()}


def test_vectors_without_a_score_lose_no_others(spark):
    v = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8]), (4, None), (5, []), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [1.0, 2.0, 3.0]), (9, [2.0, 4.0, 6.0]), (10, [-1.0, 0.0])]
    q = [(1, [1.0, 0.0]), (2, [1.0, 2.0, 3.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [None, 1.0])]
    for k in (1, 2, 3, 20):
        assert found(spark, q, v, k) == brute(q, v, k)
    assert found(spark, q, v, 3) == {(1, 1, 1), (1, 3, 2), (1, 10, 3), (2, 8, 1), (2, 9, 2)}


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_is_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    v = [(i, (centres[i % 12] + rng.normal(size=8) * (0.05 if seed else 1.0)).tolist()) for i in range(900)] + [(900 + i, centres[3].tolist()) for i in range(30)]
    q = [(i, v[i * 9][1]) for i in range(100)]
    assert found(spark, q, v, 7) == brute(q, v, 7)


def test_clustered_vectors_are_passed_over(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    v = spark.createDataFrame([(i, (centres[i % 30] + rng.normal(size=16) * 0.02).tolist()) for i in range(6000)], "id long, embedding array<float>")
    q = v.filter("id % 100 = 0").selectExpr("id AS query_id", "embedding AS query")
    got = search.passed_over(q, v, 10).agg(F.sum("cells").alias("c"), F.sum("visited").alias("v"), F.count("*").alias("n")).first()
    assert got.n == 60 and got.v < 0.3 * got.c
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        search.nearest(q, v, 10).explain()
    assert "Cartesian" not in plan.getvalue() and "NestedLoop" not in plan.getvalue()


WORDS = [(1, ["New", "YORK"]), (2, ["times"]), (3, []), (4, None), (5, ["absent"]), (6, ["a.b"]), (7, ["the", "new", "times"])]
TEXTS = [(1, "The New York Times"), (2, "new york, NEW YORK"), (3, "times"), (4, "b a"), (5, None), (6, ""), (7, "a, b; new. Times-the")]


def test_texts_that_hold_all_words(spark):
    q = spark.createDataFrame(WORDS, "query_id long, words array<string>")
    t = spark.createDataFrame(TEXTS, "id long, text string")
    got = {(r.query_id, r.id) for r in search.holding_all(q, t).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 3), (2, 7), (6, 4), (6, 7), (7, 1), (7, 7)}


def test_each_query_has_its_own_words(spark):
    rng = np.random.default_rng(2)
    vec = {i: rng.normal(size=4).tolist() for i, _ in TEXTS}
    q = spark.createDataFrame([(i, rng.normal(size=4).tolist(), w) for i, w in WORDS], "query_id long, query array<float>, words array<string>")
    t = spark.createDataFrame([(i, vec[i], x) for i, x in TEXTS], "id long, embedding array<float>, text string")
    got = {(r.query_id, r.id, r.rank) for r in search.hybrid(q, t, 2).collect()}
    sets = {1: {1, 2}, 2: {1, 3, 7}, 3: set(vec), 4: set(vec), 5: set(), 6: {4, 7}, 7: {1, 7}}
    want = set()
    for r in q.collect():
        want |= brute([(r.query_id, r["query"])], [(i, vec[i]) for i in sets[r.query_id]], 2)
    assert got == want


def test_hits_are_counted_without_their_pairs(spark):
    """Blocks and slices of any size count what the pairs say, and no stage reads or writes as many rows as there are pairs."""
    rng = random.Random(3)
    common = ["alpha", "beta", "gamma"]
    texts = [(i, " ".join([*common, *(f"w{rng.randrange(40)}" for _ in range(6))]) if i % 50 else None) for i in range(400)] + [(None, "alpha")]
    asked = [(k, rng.choice([["Alpha"], ["Beta.Gamma"], ["w1", "alpha"], [f"w{rng.randrange(45)}", f"w{rng.randrange(45)}"], [], ["missing", "alpha"], None])) for k in range(300)]
    t, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "query_id long, words array<string>")
    want = {}
    for r in search.holding_all(q, t).collect():
        n, first = want.get(r.query_id, (0, r.id))
        want[r.query_id] = (n + 1, min(first, r.id))
    assert sum(n for n, _ in want.values()) > 30_000
    for most, most_sets in ((20_000, 1_000_000), (90, 7)):
        got = {r.query_id: (r.hits, r.first_hit) for r in search.count_holding_all(q, t, most, most_sets).collect()}
        assert got == want
    assert search.count_holding_all(q, t.limit(0)).count() == 0 and search.count_holding_all(q.limit(0), t).count() == 0
