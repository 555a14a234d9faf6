"""Components against brute force: odd rows, dense groups beyond a leaf, exact copies, the rest of large nodes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import near_dup


def shingle_set(text):
    w = [x for x in re.split("[\t-\r ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, least=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingle_set(t))
    items = [(i, s) for i, ss in sets.items() for s in ss]
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(items):
        for j, b in items[:x]:
            both = len(a & b)
            if a and b and 100 * both >= least * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in words)


def check(spark, rows, least=85):
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, kept int, comp string").repartition(3)
    got = near_dup.near_duplicates(df, least).collect()
    known = [(i, t) for i, t in rows if i is not None]
    want = brute(known, least)
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == (r.component_id == r.doc_id)
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(shingle_set(t))) for i, t in known)
    return got


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long.upper()), (8, long.upper()), (9, "É " + long), (10, "é " + long),
        (11, long + " tail"), (None, long), (None, None), (12, "a b c d e"), (13, "a b c d e f"), (14, "x" * 100_000), (15, "y " * 50_000), (16, "y y y y y"),
    ]
    got = {r.doc_id: r.component_id for r in check(spark, rows)}
    assert got[5] == 4 and got[11] == got[8] == 7 and got[16] == 15 and got[2] == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_first(empty).count() == 0


@pytest.mark.parametrize(("share", "least", "exact"), [(0.005, 85, 8), (0.02, 85, 8), (0.02, 80, 8), (0.02, 80, 64)])
def test_dense_group_beyond_a_leaf(spark, monkeypatch, share, least, exact):
    monkeypatch.setattr(near_dup, "LEAF", 8)
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    monkeypatch.setattr(near_dup, "EXACT", exact)
    rng = random.Random(5)
    base = [f"b{rng.randrange(500)}" for _ in range(120)]
    rows = [(k, edited(rng, base, share * rng.random() * 3)) for k in range(70)]
    rows += [(100 + k, " ".join(base)) for k in range(30)] + [(200 + k, " ".join(f"n{rng.randrange(900)}" for _ in range(60))) for k in range(30)]
    check(spark, rows, least)


@pytest.mark.parametrize("strip", [4_000_000, 100])
def test_no_links_are_lost_by_block_edges(monkeypatch, strip):
    monkeypatch.setattr(near_dup, "STRIP", strip)
    rng = random.Random(3)
    import numpy as np

    base = [f"b{i}" for i in range(60)]
    sets = [near_dup.shingles(edited(rng, base, 0.02)) for _ in range(25)]
    got = near_dup.links_between(sets, list(range(10)), list(range(25)), lambda i, j: True)
    forest, want = near_dup.Forest(25), near_dup.Forest(25)
    for i, j in got:
        forest.join(i, j)
    for i in range(10):
        for j in range(25):
            k = len(np.intersect1d(sets[i], sets[j]))
            if i != j and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                want.join(i, j)
    assert [forest.find(i) for i in range(25)] == [want.find(i) for i in range(25)] and len(got) < 25


def test_keep_first(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(3, t, "x"), (1, t + " end", "y"), (1, t + " end", "y"), (7, "other text that stands for itself", None), (None, t, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 string")
    out = near_dup.keep_first(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr)


def linked(texts, least):
    """All pairs of different sets of at least that likeness, by an index of shingles."""
    sets = {i: s for i, s in ((i, shingle_set(t)) for i, t in texts) if s}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    sets = {i: s for s, i in first.items()}
    index, met = {}, {}
    for i, s in sorted(sets.items()):
        for g in s:
            for j in index.setdefault(g, []):
                met[j, i] = met.get((j, i), 0) + 1
            index[g].append(i)
    return {p for p, n in met.items() if 100 * n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


@pytest.mark.parametrize("least", [85, 80])
def test_recall_on_a_given_table(spark, least):
    """Of all linked pairs of different texts, the table's own and those with copies whose edits leave about that likeness,
    at least 99 in 100 end in one component, and nothing else is joined."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in df.collect()]
    rng = random.Random(2)
    copies = [(1_000_000 + i, edited(rng, t.split(), rng.uniform(0.005, 0.04))) for i, t in texts if t and 40 <= len(t.split()) <= 3_000]
    texts += copies
    df = df.unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    comp = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, least).collect()}
    pairs = linked(texts, least)
    assert len(pairs) > 200
    assert sum(comp[a] == comp[b] for a, b in pairs) >= 0.99 * len(pairs)
    want = near_dup.Forest(max(comp) + 1)
    same = {}
    for i, t in texts:
        if s := shingle_set(t):
            want.join(same.setdefault(s, i), i)
    for a, b in pairs:
        want.join(a, b)
    assert all(want.find(i) == want.find(c) for i, c in comp.items())


def test_a_passage_that_many_unlike_documents_share(spark, monkeypatch):
    """20,000 short documents with one line in common, and pairs of near copies among them: no node is compared whole."""
    rng = random.Random(11)
    line = "this text is free to use under the terms of its license"
    rows = []
    for k in range(20_000):
        own = [f"q{rng.randrange(10**7)}" for _ in range(12)]
        rows.append((k, f"{line} {' '.join(own)}"))
    near = [f"{line} {' '.join(f'p{k}x{i}' for i in range(60))}" for k in range(40)]
    rows += [(30_000 + k, t) for k, t in enumerate(near)] + [(40_000 + k, t + " end") for k, t in enumerate(near)]
    sizes = []
    monkeypatch.setattr(near_dup, "_rest", lambda rows, nodes, was=near_dup._rest: sizes.extend(r.m - r.k for r in nodes.collect()) or was(rows, nodes))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: i - 10_000 if i >= 40_000 else i for i, _ in rows}
    # A part that two lucky coordinates in a row have kept together is compared whole; there are few.
    assert all(n <= near_dup.EXACT for n in sizes) or sum(n > near_dup.EXACT for n in sizes) <= len(sizes) / 10


def test_the_bitmap_lets_all_wanted_through(spark):
    docs = spark.createDataFrame([(i, f"a b c d e {i}") for i in range(-300, 300)], "doc_id long, text string")
    wanted = spark.range(-300, 300, 7).select(F.col("id").alias("doc"))
    got = {r.doc for r in near_dup._sets(docs, wanted).collect()}
    assert got >= set(range(-300, 300, 7)) and len(got) < 100
