"""Fingerprints against a plain form, on odd rows."""

import hashlib
import re

import pytest

from millrace.llm import spotsigs

TEXTS = [
    (5, "The cat sat on the mat and the dog was in a big red house of the king with an old crown"), (9, None), (3, ""), (2, " \n"), (11, "solo"),
    (20, "é" * 10 + " the 😀 x"), (21, "the cat sat on the mat and the dog was in a big red house of the king with an old crown"), (30, "of the and a " * 20),
    (31, "one of many words is the kind that was told to the men by old kings in a far land for the sake of good " * 3), (31, "one of many words is the kind that was told"),
]


def sig(text):
    w = [x for x in re.split("[\t-\r ]+", (text or "").lower()) if x]
    out = set()
    for i, x in enumerate(w):
        if x in spotsigs.ANCHORS:
            rest = [y for y in w[i + 1 : i + 1 + spotsigs.REACH] if y not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(rest) == spotsigs.CHAIN:
                out.add((x, *rest))
    return out or ({tuple(w)} if w else set())


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, n_chars int, sig string")


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_fingerprints(docs, ranges, monkeypatch):
    plain = spotsigs.neighbours
    monkeypatch.setattr(spotsigs, "neighbours", lambda d, known=None: plain(d, ranges, known))
    order = sorted(TEXTS, key=lambda x: (-x[0], x[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(sig(t)) * 16, len(sig(edited)) * 16, jaccard(sig(t), sig(edited)), jaccard(sig(t), sig(nxt))))
    got = spotsigs.fingerprints(docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint), len(r.edited_fingerprint), r.near_edited, r.near_next) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.fingerprint)
    assert by[5] == by[21] and by[9] == by[3] == ""


def test_few_and_no_rows(spark, docs):
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0
    one = spotsigs.fingerprints(docs.filter("doc_id = 5")).collect()
    assert one[0].near_next == 1.0
    nulls = spark.createDataFrame([(None, "the old man"), (4, "a new day of joy"), (None, "b")], "doc_id long, text string")
    got = {r.n_chars: r.edited_sha256 for r in spotsigs.fingerprints(nulls).collect()}
    assert got[1] == hashlib.sha256(b"b").hexdigest() and got[16] == hashlib.sha256(b"a new day ob").hexdigest()


def grouped(sigs, least=0.8):
    """Class and group of every document with words, pair by pair."""
    cls = {i: min(j for j, s in sigs.items() if s == sigs[i]) for i in sigs}
    up = {i: i for i in set(cls.values())}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in up:
        for b in up:
            if a < b and jaccard(sigs[a], sigs[b]) >= least:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (c, find(c)) for i, c in cls.items()}


@pytest.mark.parametrize("frequent", [1, 8, 1024])
def test_groups_are_brute_force(spark, frequent):
    base = [f"the w{i} v{i % 7} of u{i % 11}" for i in range(40)]
    texts = [" ".join(base[k % 3 :] + [f"the x{k} y{k}"] * (k % 4)) for k in range(24)] + ["alone in the big wood", "", None, "the a b"]
    # A dense key: unlike texts that share most of their common chains, and a chain of texts each alike to the next.
    texts += [" ".join([*base[:3], *(f"the own{k} q{i}" for i in range(9))]) for k in range(12)] + [" ".join(base[k : k + 30]) for k in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = {i: frozenset(sig(t)) for i, t in enumerate(texts) if sig(t)}
    want = grouped(sigs)
    got = {r.doc_id: (r.class_id, r.group_id) for r in spotsigs.groups(docs, 0.8, frequent).collect()}
    assert {i: got.get(i, (i, i)) for i in sigs} == want and any(c != g for c, g in want.values())
    rows = {r.doc_id: (r.class_id, r.group_id) for r in spotsigs.fingerprints(docs, spotsigs.groups(docs)).collect()}
    assert rows == {i: want.get(i, (None, None)) for i in range(len(texts))}


def test_very_long_texts_and_repeated_rows(spark):
    long = " ".join(f"the w{i} of v{i * 7 % 5003} and u{i % 977}" for i in range(4_000))
    rows = [(1, long), (2, long + " the tail end"), (3, long), (3, long), (None, long), (4, "x" * 200_000), (5, "the " * 50_000)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, sig string, class_id int")
    got = {(r.doc_id, r.class_id, r.group_id) for r in spotsigs.fingerprints(docs, spotsigs.groups(docs)).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 1, 1), (None, None, None), (4, 4, 4), (5, 5, 5)}
    assert all(r.near_edited > 0.3 for r in spotsigs.fingerprints(docs).collect() if r.doc_id == 2)


def test_marks_and_texts_without_anchors(spark):
    plain = "The cat sat on the mat and the dog was in a big red house"
    marked = "The*** cat, sat. on&&& (the) mat%%% and $the dog! was -in- a big red house."
    runs = " ".join(f"w{i}" for i in range(60))
    rows = [(1, plain), (2, marked), (3, runs), (4, runs + " w60 w61"), (5, "*** --- &&&"), (6, "From*** w1 to%%% w2"), (7, "a" + "*" * 20_000 + "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(docs).collect()}
    assert got[1] == got[2] and [len(got[i]) // 16 for i in (3, 4, 5, 6, 7)] == [58, 60, 1, 1, 1]
    by = {r.doc_id: r for r in spotsigs.fingerprints(docs.filter("doc_id = 3")).collect()}
    assert by[3].near_edited > 0.4
    assert {r.doc_id: (r.class_id, r.group_id) for r in spotsigs.groups(docs).collect()} == {1: (1, 1), 2: (1, 1), 4: (4, 3)}
