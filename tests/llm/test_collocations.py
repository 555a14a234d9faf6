"""Phrase counts, filters and the collocation query beside plain Python and SQL."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import collocations, queries
from tests.compare import compare, connection


@pytest.mark.parametrize("n", [2, 3, 4])
def test_permutation_is_one_to_one(n):
    ids = np.random.default_rng(n).integers(0, 2**64, (n, 5000), dtype=np.uint64)
    assert (collocations.restored(collocations.permuted(ids)) == ids).all()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 4), st.integers(0, 6), st.lists(st.integers(0, 40), max_size=200), st.integers(1, 10**12))
def test_filters_lose_nothing(n, skip, keys, large):
    prefix = 5 % (1 << skip)
    ids = np.vstack([np.array(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) for k in range(n)])
    if skip:
        ids[0] = (ids[0] >> np.uint64(skip)) | np.uint64(prefix << (64 - skip))
    rows, counts = collocations._sorted(ids, np.ones(len(keys), np.int64))
    counts[::3] += large
    back, told = collocations.Filter.unpack(collocations.Filter.pack(rows, counts, skip), prefix)
    assert (back == rows).all() and (told == counts).all()


def plain(docs, least, first):
    f, total = {}, Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for m in (1, 2, 3, 4):
                for i in range(len(w) - m + 1):
                    k = (lang, tuple(w[i : i + m]))
                    f[k] = f.get(k, 0) + 1
    often = {k: v for k, v in f.items() if v >= least}
    found = {}
    for (lang, w), a in often.items():
        if len(w) == 1:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        covered = any(g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 80 * a for (g, v), b in often.items())
        if not covered:
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((g, i + 1, p.decode(), -a, lf, r, total[g], -s) for g, rows in found.items() for i, (s, a, p, lf, r) in enumerate(sorted(rows)[:first]))


def _docs():
    rng = np.random.default_rng(3)
    words = ["the", "New", "York", "é", "of", "of-the", "TIMES", "x", "Straße", "a"]
    docs = [(["en", "de", None, "und"][i % 4], " ".join(words[j] + ("." if rng.random() < 0.1 else ",\t" if rng.random() < 0.05 else "") for j in rng.integers(0, len(words), 60))) for i in range(60)]
    docs += [("en", "New York Times\n" * 40), ("en", None), (None, ""), ("fr", "seul"), ("en", "New York Times " * 9), ("en", "New York Times " * 9)]
    return docs


@pytest.mark.parametrize(("least", "first"), [(5, 2000), (12, 7)])
def test_phrases_beside_plain_python(spark, least, first):
    docs = _docs()
    df = spark.createDataFrame([(i, g, t, "x", 1) for i, (g, t) in enumerate(docs)], "doc_id long, lang string, text string, word string, n int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df, least, first).collect())
    assert got == plain(docs, least, first) and len(got) > 10


def test_one_seed_with_a_clash_is_left(spark, monkeypatch):
    true = collocations.word_id
    monkeypatch.setattr(collocations, "word_id", lambda lang, w, seed: 77 if seed == 0 and w in (b"a", b"b") else true(lang, w, seed))
    words, seed = collocations.numbered_words(spark.createDataFrame([("en", "a b c")], "lang string, text string"))
    assert seed == 1 and words.count() == 3


def test_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    for a, left, r in ((6 * 10**12, 7 * 10**12, 9 * 10**12), (2**61, 2**61, 2**61), (1, 3, 4), (999_999, 1_000_000, 999_999)):
        row = spark.createDataFrame([(a, left, r)], "a long, l long, r long").select(collocations._worth(F.col("a"), F.col("l"), F.col("r"))).first()
        assert row[0] == 2_000_000 * a // (left + r)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(connection(sf), queries.queries()["op12_collocations"](spark, sf), queries.oracle_sql()["op12_collocations"]) == ""
