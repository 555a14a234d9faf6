"""Periodic runs of words by an online sparse diagonal DP, and texts with their repeats collapsed.

A run is a stretch of consecutive words with smallest period q, of length max(6, 4 q) or more, that no neighbouring word
extends.  In the table of equal words (i, i - lag) it is a stretch of the diagonal of lag q, `length - q` cells long.  The
words are met one after the other: each one lengthens the active diagonals on which its earlier occurrences lie, the
others end, and a diagonal that ends with a sufficient length gives its run at once.  Only diagonals that can become
runs are held:

- a run's diagonal has at least five cells, so a diagonal opens at the fifth equal word in a row, found by earlier
  occurrences of the word in its context of five;
- it opens once, where the word before that context differs, and only while `4 lag` words are left for it;
- a lag that is a multiple of a long active lag p is skipped where its earlier occurrence lies in the stretch of period p:
  a run through it would have period p, so lag would not be its smallest.

The active diagonals need memory in proportion to their number, which is bounded by a quarter of the text; a text of
one word repeated has one.  Every text is worked out where it lies: nothing is shuffled, and texts share nothing.

Null and empty texts have no words and no runs (four nulls, digests of the empty string).  A row without an id is taken
as it stands (nothing is made periodic).  Repeated rows give repeated results, an empty table an empty one; only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_col

LEAST = 6
TIMES = 4
#: Words that a diagonal matches before it opens: the shortest run's diagonal (period 1, length 6) has five.
CONTEXT = 5
#: Cells looked at together.
STEP = 16_384
#: Active diagonals whose multiples are not opened: a saving only, since an ended diagonal's lag is tested for being the smallest.
OLDEST = 8

SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _openings(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, earlier): places i where diagonals may open, ascending, and the earlier places of the five words that end at i with
    another word before them."""
    n = len(ids)
    u = ids.astype(np.uint64)
    gram = sum((u[k : n - CONTEXT + 1 + k] + np.uint64(1)) * _MULT[k] for k in range(CONTEXT))
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = g[1:] == g[:-1]
    if not same.any():
        return
    left = np.concatenate([[-1], ids[: n - CONTEXT]])[order]
    new = np.concatenate([[True], ~same])
    # Stretches of one group and one word before, in order of place.
    cut = np.flatnonzero(new | np.concatenate([[True], left[1:] != left[:-1]]))
    stretch = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(g))))
    first = np.repeat(stretch[new], np.diff(np.append(np.flatnonzero(new), len(g))))
    open_ = np.flatnonzero(stretch > first)  # elsewhere the words before are the same up to here, and nothing can open
    word_before, low = left[cut], order[cut]
    for at in open_[np.argsort(order[open_], kind="stable")].tolist():
        place = int(order[at])
        lo, hi = int(first[at]), int(stretch[at])
        least = place - (n - place) // (TIMES - 1)  # lags that are too long for the rest of the text
        if hi - lo > 1:
            lo = max(lo, lo + int(np.searchsorted(low[lo:hi], least)) - 1)
        parts = [order[cut[k] : cut[k + 1]] for k in range(lo, hi) if word_before[k] != left[at]]
        if parts:
            earlier = parts[0] if len(parts) == 1 else np.concatenate(parts)
            earlier = earlier[np.searchsorted(earlier, least) :]
            if len(earlier):
                yield place + CONTEXT - 1, earlier + CONTEXT - 1


def _smallest(ids: np.ndarray, start: int, end: int, lag: int) -> bool:
    """Whether no proper divisor of lag is a period of words start .. end - 1."""
    rest, f = lag, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = lag // f
            if np.array_equal(ids[start + p : end], ids[start : end - p]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, ascending by start and period."""
    n, out = len(ids), []
    if n < LEAST:
        return out
    lags, cells = np.empty(0, np.int64), np.empty(0, np.int64)  # active diagonals, the oldest first, and their first cells

    def ended(some: np.ndarray, upto: np.ndarray) -> None:
        start = cells[some] - lags[some]
        enough = upto - start >= np.maximum(LEAST, TIMES * lags[some])
        for s, e, lag in zip(start[enough].tolist(), upto[enough].tolist(), lags[some][enough].tolist()):
            if _smallest(ids, s, e, lag):
                out.append((s, e - s, lag))

    def extended(i: int, upto: int) -> None:
        """Words i .. upto - 1, a few at a time, as long as diagonals are active."""
        nonlocal lags, cells
        while i < upto and len(lags):
            m = min(upto - i, max(1, STEP // len(lags)))
            words = np.arange(i, i + m)
            equal = ids[words - lags[:, None]] == ids[words]
            stay = equal.all(1)
            if not stay.all():
                end = np.flatnonzero(~stay)
                ended(end, i + equal[end].argmin(1))
                lags, cells = lags[stay], cells[stay]
            i += m

    at = 0
    context = np.arange(CONTEXT)
    for i, earlier in _openings(ids):
        extended(at, i + 1)
        at = i + 1
        new = i - earlier[::-1]
        for p, first in zip(lags[:OLDEST].tolist(), cells[:OLDEST].tolist()):
            new = new[(new % p != 0) | (i - new < first - p)]
        if len(new):
            new = new[(ids[i - context - new[:, None]] == ids[i - context]).all(1)]
            lags, cells = np.concatenate([lags, new]), np.concatenate([cells, np.full(len(new), i - CONTEXT + 1)])
    extended(at, n)
    ended(np.arange(len(lags)), np.full(len(lags), n))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: a run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's documents: every tenth, by a hash of the id, repeats from some word on."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period of each) and collapsed (the text without its repeats, words joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for t in b.column(1).cast(pa.binary()):
                words = t.as_py().split()
                got = runs(numbered(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in got])
                texts.append(b" ".join(w for w, k in zip(words, kept_words(len(words), got).tolist()) if k) if got else b" ".join(words))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "runs": pa.array(found, kind), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The query: of every document, made periodic by its id where the contract says so, the number of runs, the longest one, and
    the digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words = looped(t.as_py().split(), doc)
                found = runs(numbered(words))
                kept = b" ".join([w for w, k in zip(words, kept_words(len(words), found).tolist()) if k] if found else words)
                top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
                told = "".join("%d,%d,%d\n" % r for r in found)
                row = (doc, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                for c, v in zip(out, row):
                    c.append(v)
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    return rows.mapInArrow(run, SCHEMA)
