"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A sentence's score is a logistic function of the words that it holds; a document is toxic unless every sentence is
clean, 1 - prod(1 - p).  The gradient of that likelihood trains the word weights from document labels alone, and the
sentences with high p are the offending ones.  A word stands for itself and for its beginnings and ends of 3 to 7
letters, so words that were never seen are judged by their parts.

Training takes at most `max_toxic` + `max_clean` labelled documents of at most `max_chars` characters each (those of the
smallest digests of doc_id), a bound that the driver's memory needs: a longer labelled text is passed over in training, and
scored whole like any other.  Labels of doc_ids with crc32 % 3 = 1 are never read.  Scoring covers every document,
whole, in tasks that keep a bounded cache of word weights.

Null or empty text has no sentence and the score of the empty product, 0.  A label that is null is no label; of
several labels of one doc_id the highest counts.  Without labels of both classes every score is the share of toxic labels (0
without any).  Equal texts have equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_col

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"[^\W\d_]+")
AFFIX = range(3, 8)
HELD = 1
SEED = "tox-1"


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is only for testing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD, F.lit(False))


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and distinct words of every sentence that has words."""
    out = []
    for m in _SENTENCE.finditer(text):
        if words := _WORD.findall(m[0].lower()):
            out.append((m.start(), m.end(), list(dict.fromkeys(words))))
    return out


def parts(word: str) -> list[str]:
    """The features of a word: itself, beginnings (x-) and ends (-x)."""
    sizes = [n for n in AFFIX if n < len(word)]
    return [word, *(word[:n] + "-" for n in sizes), *("-" + word[-n:] for n in sizes)]


SLOTS = 1 << 20


def slots(word: str) -> list[int]:
    """The features of a word as numbers below SLOTS, each once."""
    return sorted({zlib.crc32(p.encode()) % SLOTS for p in parts(word)})


@dataclass
class Model:
    """Weights of features by slot, and the bias of a sentence."""

    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -20.0
    flat: float | None = 0.0

    def word(self, w: str) -> float:
        got = self.weights
        return math.fsum(got[k] for k in slots(w) if k in got)


def fit(texts: list[str], toxic: list[int], rounds: int = 120, keep: int = 30_000, least_docs: int = 4, rate: float = 0.15, shrink: float = 1e-4) -> Model:
    """A model from texts and their labels."""
    y = np.asarray(toxic, bool)
    if y.all() or not y.any():
        return Model(flat=float(y.mean()) if len(y) else 0.0)
    number: dict[str, int] = {}
    of_word: list[np.ndarray] = []
    word_of, sent_of, doc_of, n_sent = array("l"), array("l"), array("l"), 0
    in_docs = np.zeros((2, SLOTS), np.int32)
    for d, t in enumerate(texts):
        own: set[int] = set()
        for _, _, words in sentences(t):
            for w in words:
                i = number.setdefault(w, len(number))
                if i == len(of_word):
                    of_word.append(np.array(slots(w), np.int32))
                own.add(i)
                word_of.append(i)
                sent_of.append(n_sent)
            doc_of.append(d)
            n_sent += 1
        if own:
            in_docs[int(y[d]), np.unique(np.concatenate([of_word[i] for i in own]))] += 1
    n_pos, n_neg = int(y.sum()), int((~y).sum())
    p, q = (in_docs[1] + 0.5) / (n_pos + 1), (in_docs[0] + 0.5) / (n_neg + 1)
    gain = np.where(in_docs.sum(0) >= least_docs, np.abs(p - q) / np.sqrt((p + q) / 2), 0.0)
    chosen = np.argsort(-gain, kind="stable")[: min(keep, int((gain > 0).sum()))]
    place = np.full(SLOTS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    if not len(chosen):
        return Model(flat=float(y.mean()))
    fw, ff = np.repeat(np.arange(len(of_word)), [len(x) for x in of_word]), place[np.concatenate(of_word)]
    fw, ff = fw[ff >= 0], ff[ff >= 0]
    word_of, sent_of, doc_of = np.array(word_of), np.array(sent_of), np.array(doc_of)
    useful = np.zeros(len(number), bool)
    useful[fw] = True
    word_of, sent_of = word_of[useful[word_of]], sent_of[useful[word_of]]
    # A class weight of half the imbalance keeps rare labels in view.
    cost = np.where(y, math.sqrt(n_neg / n_pos), 1.0)
    cost /= cost.sum()
    w, bias = np.zeros(len(chosen)), math.log(0.02)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        per_word = np.bincount(fw, w[ff], len(number))
        z = bias + np.bincount(sent_of, per_word[word_of], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        doc_p = np.maximum(-np.expm1(clean), 1e-9)
        g = p * np.where(y, 1 - 1 / doc_p, 1.0)[doc_of] * cost[doc_of]
        g_word = np.bincount(word_of, g[sent_of], len(number))
        g_w = np.bincount(ff, g_word[fw], len(w)) + shrink * w
        m, v = 0.9 * m + 0.1 * g_w, 0.999 * v + 0.001 * g_w * g_w
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        step = rate * min(1.0, 2 * (1 - k / (rounds + 1)))
        w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
        bias -= step * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.999**k)) + 1e-6)
    top = np.abs(w) > 0.02
    return Model({int(f): round(float(w[i]), 4) for i, f in enumerate(chosen) if top[i]}, float(bias), None)


class Scorer:
    """Documents to scores and offending sentences, with a bounded cache of word weights."""

    def __init__(self, model: Model, size: int = 400_000) -> None:
        self.model, self.size, self.known = model, size, {}

    def _weight(self, w: str) -> float:
        got = self.known.get(w)
        if got is None:
            got = self.model.word(w)
            if len(w) < 64:
                if len(self.known) >= self.size:
                    self.known.clear()
                self.known[w] = got
        return got

    def __call__(self, text: str, from_p: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        if self.model.flat is not None:
            return self.model.flat, []
        clean, found = 0.0, []
        for a, b, words in sentences(text):
            z = self.model.bias + sum(map(self._weight, words))
            p = 1 / (1 + math.exp(-z)) if z > -30 else 0.0
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p >= from_p:
                found.append((a, b, round(p, 4)))
        return -math.expm1(clean), found


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3_000, max_clean: int = 5_000, max_chars: int = 200_000, max_total_chars: int = 60_000_000) -> Model:
    """A model from the labels that are not held out.

    The sample's bounds are parameters: up to so many toxic and clean documents of up to max_chars characters each and
    max_total_chars together, one row a doc_id (the one of the shortest text, of equally long ones that of the smallest hash), taken
    in the order of a digest of their ids, each label half of the characters at most."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", text_col().alias("text")).withColumn("n", F.length("text")).withColumn("h", F.xxhash64("text")).filter(F.col("n") <= max_chars)
    # Lengths and hashes alone are shuffled; texts are only read where they lie.
    one = rows.select("doc_id", "n", "h").join(own, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("n", "h")).alias("r"))
    one = one.select("doc_id", "toxic", "r.n", "r.h", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(SEED))).alias("at"))
    chosen = []
    for label, most in ((1, max_toxic), (0, max_clean)):
        left = max_total_chars // 2
        for r in one.filter(F.col("toxic") == label).orderBy("at").limit(most).collect():
            left -= r.n
            if left >= 0:
                chosen.append((r.doc_id, r.h, label))
    if not chosen:
        return fit([], [])
    # At most max_toxic + max_clean ids, so the broadcast is bounded.
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, h bigint, toxic int")
    texts = rows.join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic")
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.toLocalIterator())
    return fit([t for _, t, _ in got], [y for _, _, y in got])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences offending and their spans (start:end:p, code points)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scorer(sent.value)
        for b in batches:
            got = [of(t.as_py()) for t in b.column(2)]
            p = [s for s, _ in got]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0),
                    "held_out": b.column(1),
                    "score": pa.array(p, pa.float64()),
                    "predicted": pa.array([int(s >= threshold) for s in p], pa.int32()),
                    "n_offending": pa.array([len(x) for _, x in got], pa.int32()),
                    "offending": [",".join(f"{a}:{z}:{s}" for a, z, s in x) for _, x in got],
                }
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_col().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, n_offending int, offending string")
