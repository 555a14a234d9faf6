"""Repeated passages beside brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries, substring
from tests.compare import compare, connection


def plain(rows):
    split = [(d, [w for w in re.split("[ \t-\r]+", t or "") if w]) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if d is not None and least[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, home int, words int").repartition(6)
    return sorted((tuple(r) for r in substring.removed_passages(df).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ü", "the", "of"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    common, chant, base = prose(40), ["la"] * 30, prose(400)
    rows = []
    for i in range(90):
        kind = i % 9
        w = prose(rng.randint(0, 120))
        if kind < 3:
            w = w + common[rng.randint(0, 20) :] + prose(10)
        elif kind == 3:
            w = w[:20] + chant + w[20:]
        elif kind < 7:  # near copies with edits in several places, also shared among themselves
            w = list(base)
            for at in range(17, 400, rng.choice([15, 23, 60])):
                w[at] = rng.choice(["edit", "other", w[at]])
        elif kind == 7:
            w = common[:12] + w + common[:13] + common[20:]
        rows.append((rng.randint(0, 70) if i % 10 else i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(None, " ".join(base)), (None, None), (5, None), (6, ""), (7, " \n "), rows[4], rows[4], (-3, " ".join(base[50:90]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_beside_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(substring, "PORTION", 500)
    rows = corpus(seed)
    got = found(spark, rows)
    assert got == plain(rows) and sum(r[2] > 0 for r in got) > 20


def test_a_long_text_and_an_empty_table(spark):
    long = " ".join(f"{i * i % 7919}" for i in range(60_000))
    rows = [(2, long), (1, long[: len(long) // 2]), (3, "x"), (4, "y " * 14), (0, "y " * 13)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [])== []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.lists(st.integers(0, 2), max_size=80))
def test_a_parse_finds_every_window_of_the_block(text, ref):
    a, b = (substring.hashed([b"%d" % x for x in v]) for v in (text, ref))
    got = substring.Block(b).parse(a, substring.chains(a, 13)) if len(b) >= 13 else np.zeros(max(0, len(a) - 12), bool)
    have = {tuple(ref[i : i + 13]) for i in range(len(ref) - 12)}
    assert got.tolist() == [tuple(text[i : i + 13]) in have for i in range(len(text) - 12)]


def test_anchors_are_the_same_wherever_a_window_stands():
    h = np.random.default_rng(5).integers(0, 2**63, 300, dtype=np.uint64)
    whole = substring.anchors(h)
    assert all(substring.anchors(h[i : i + 13])[0] == whole[i] for i in range(288))


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(connection(sf), queries.queries()["op11_substring_dedup"](spark, sf), queries.oracle_sql()["op11_substring_dedup"]) == ""
