"""Held-out accuracy on the given labels, located sentences, and odd rows."""

import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    got = toxicity.score(table(spark, SF, "documents"), model).join(table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    bad, good = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    auc = sum(sum(b > g for g in good) + 0.5 * sum(b == g for g in good) for b in bad) / (len(bad) * len(good))
    flagged = [r.toxic for r in got if r.predicted]
    assert auc > 0.95 and sum(flagged) / len(flagged) > 0.9 and sum(flagged) / len(bad) > 0.65
    assert all((r.score >= 0.7) == bool(r.predicted) for r in got)


def test_offending_sentences(spark, model):
    text = "The good end of it is here. You pathetic worthless idiot trash. That is all, of course."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, text), (1, text), (4, "word " * 100_000)], "doc_id long, text string")
    got = {(r.doc_id, r.offending, r.predicted, round(r.score, 6)) for r in toxicity.score(docs, model).collect()}
    hit = next(x for x in got if x[0] == 1)
    assert hit[1].startswith("27:63:") and hit[2] == 1
    assert (None, *hit[1:]) in got and (2, "", 0, 0.0) in got and (3, "", 0, 0.0) in got and len(got) == 5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_noisy_or_learns_from_documents_alone():
    clean = [f"all is well w{i}. a fine day w{i + 1}" for i in range(60)]
    bad = [f"all is well w{i}. you are foul w{i}. a fine day" for i in range(60)]
    m = toxicity.fit(clean + bad, [0] * 60 + [1] * 60)
    s = toxicity.Scorer(m)
    assert s("a fine day. all is well")[0] < 0.1 < 0.9 < s("a fine day. you are foul")[0]
    assert [x[:2] for x in s("a fine day. you are foul")[1]] == [(11, 24)]


def plain_score(m, text):
    """Noisy-or by hand: each sentence's logistic score from the weights of its words' parts, and one minus the product."""
    clean = 1.0
    for s in re.split(r"[.!?\n]", text):
        words = set(re.findall(r"[^\W\d_]+", s.lower()))
        if words:
            z = m.bias
            for w in words:
                parts = {w} | {w[:n] + "-" for n in range(3, 8) if n < len(w)} | {"-" + w[-n:] for n in range(3, 8) if n < len(w)}
                z += sum(m.weights.get(k, 0.0) for k in {zlib.crc32(p.encode()) % toxicity.SLOTS for p in parts})
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_are_noisy_or(spark, model):
    docs = table(spark, SF, "documents").filter("length(text) < 3000").limit(400).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(7)).withColumn("text2", F.col("text"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = toxicity.score(docs, model).collect()
    assert len(got) == 400 and all(math.isclose(r.score, plain_score(model, text[r.doc_id]), abs_tol=1e-9) for r in got)


def test_long_labelled_texts_are_passed_over_in_training(spark):
    rows = [(i, f"all is well w{i}. a fine day w{i + 1}") for i in range(60)] + [(100 + i, f"all is well w{i}. you are foul w{i}. a fine day") for i in range(60)] + [(999, "foul " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(100 <= i < 999)) for i, _ in rows], "doc_id long, toxic int")
    m, again = toxicity.train(docs, labels), toxicity.train(docs.filter("doc_id < 999"), labels)
    assert m.weights == again.weights and toxicity.Scorer(m)("you are foul")[0] > 0.7


def test_one_class_or_none(spark):
    assert toxicity.fit([], []).flat == 0.0 and toxicity.fit(["a"], [1]).flat == 1.0
    labels = spark.createDataFrame([(5, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(5, "x")], "doc_id long, text string")
    assert toxicity.train(docs, labels).flat == 0.0


def test_training_rows_are_bounded_whatever_repeats(spark, monkeypatch):
    """Every id three times with texts of several lengths, some too long: one row an id, and no more than the bounds."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((texts, y)) or toxicity.Model())
    rows = [(i, t) for i in range(40) for t in ("bad " * (i + 1), "bad " * (i + 1), "worse " * 2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxicity.train(docs, labels, max_toxic=6, max_clean=4, max_chars=1000)
    texts, y = seen[-1]
    assert len(texts) == 10 and sum(y) == 6 and len(set(texts)) == 10 and max(map(len, texts)) <= 160
    toxicity.train(docs, labels, max_chars=1000, max_total_chars=400)
    texts, y = seen[-1]
    assert 0 < sum(map(len, texts)) <= 400 and {0, 1} == set(y)
