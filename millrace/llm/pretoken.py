"""White-space chunks of texts, the table of what is known of them, and the chunks that are frequent in a corpus.

A tokenizer of the word_bpe kind never merges across white space, and its special strings hold none, so the ids of
a text are the ids of its chunks, one after the other.  Texts are cut at ASCII white space by Arrow; rarer white space
stays inside a chunk, where the tokenizer finds it.  Chunks are kept as written (case and marks included): the
tokenizer's own normalisation is applied to each.

Chunks are looked up by windows: Arrow numbers the distinct chunks of a window, Python meets each of them once, and
numpy deals the values back to every occurrence.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from heapq import nlargest
from itertools import islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh3_64_intdigest

from millrace.llm.common import text_col

#: A word of Latin letters with marks behind it: two pieces, whatever the case.  U+0130 grows when it is lowered.
WORD_AND_MARKS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]+)([!-/:-@\[-`{-~]*)")

#: Chunks over this length are never kept in a cache or a table.
LONGEST = 64
#: Chunks that are looked up at once.
WINDOW = 1_000_000
#: Characters of the texts that are cut at once; a longer text is cut alone.
AT_ONCE = 2_000_000
#: New names that are learned at once, and chunks whose ids are gathered at once.
LEARNED, GATHERED = 8_192, 131_072
#: The sign that the tokenizer puts at the end of a word.
WORD_END = "</w>"

_LIBRARY: dict[str, Tokenizer] = {}


def library(path: str) -> Tokenizer:
    """The tokenizer of a file, once per worker, without truncation, padding or threads."""
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LIBRARY[path] = t
    return _LIBRARY[path]


def chunks(text: str) -> list[str]:
    """The maximal runs of text without ASCII white space."""
    return [c for c in pc.ascii_split_whitespace(pa.array([text], pa.string()))[0].as_py() if c]


def slices(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[pa.Array]:
    """The texts in order, in slices of about at_once bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        yield texts.slice(at, upto - at)
        at = upto


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts in a row (empty ones too) and the number of the first of each text, and of none."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])), offsets - offsets[0]


def windows(flat: pa.Array, size: int = WINDOW) -> Iterator[tuple[list[str], np.ndarray]]:
    """The distinct chunks of each window, and the number of every chunk among them."""
    for k in range(0, len(flat), size):
        d = flat.slice(k, size).dictionary_encode()
        yield d.dictionary.to_pylist(), d.indices.to_numpy()


class Known:
    """Names with the ids that `learn` gives for them, kept up to `size` names, as flat arrays: no object for each name.

    Names lie in one Arrow array; they are found by their hashes, which are kept in order, and compared letter by letter.
    Of names with one hash only the first is found; the others are learned each time.  A full table forgets the younger
    half: frequent names come early, so what goes is mostly what was met once.  Names over LONGEST are forgotten at the
    next call.
    """

    def __init__(self, size: int) -> None:
        self.size, self.names = size, pa.array([""], pa.string())
        self.hash, self.place = _hashes([""]), np.zeros(1, np.int32)
        self.ids, self.start, self.count = np.zeros(1024, np.uint32), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.n, self.n_ids, self.long = 1, 0, False

    @property
    def at(self) -> list[str]:
        """The names that can be found, by place."""
        return self.names.to_pylist()

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the new names in a row, and how many each has."""
        raise NotImplementedError

    def places(self, names: list[str]) -> np.ndarray:
        """The place of each name; places hold until the next call."""
        if self.long or self.n > self.size:
            self._forget()
        hashes = _hashes(names)
        near = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        at = np.where(self.hash[near] == hashes, self.place[near].astype(np.int64), -1)
        hit = np.flatnonzero(at >= 0)
        same = pc.equal(self.names.take(pa.array(at[hit])), pa.array(map(names.__getitem__, hit.tolist()), pa.string()))
        at[hit[~same.to_numpy(zero_copy_only=False)]] = -1
        if len(missing := np.flatnonzero(at < 0)):
            new = list(map(names.__getitem__, missing.tolist()))
            long = np.fromiter(map(len, new), np.int64, len(new)) > LONGEST
            order = np.argsort(long, kind="stable")  # long names come last, so that no place moves when they go
            missing, new, short = missing[order], list(map(new.__getitem__, order.tolist())), len(new) - int(long.sum())
            at[missing] = self.n + np.arange(len(new))
            hashes, place = hashes[missing[:short]], at[missing[:short]]
            order = np.argsort(hashes, kind="stable")
            into = np.searchsorted(self.hash, hashes[order], "right")
            self.hash, self.place = np.insert(self.hash, into, hashes[order]), np.insert(self.place, into, place[order])
            self.names, self.long = pa.concat_arrays([self.names, pa.array(new[:short], pa.string())]), short < len(new)
            for k in range(0, len(new), LEARNED):
                ids, count = self.learn(new[k : k + LEARNED])
                self.ids = _room(self.ids, self.n_ids, ids)
                self.start = _room(self.start, self.n, self.n_ids + np.cumsum(count) - count)
                self.count = _room(self.count, self.n, count)
                self.n, self.n_ids = self.n + len(count), self.n_ids + len(ids)
        return at

    def _forget(self) -> None:
        keep = self.size // 2 if self.n > self.size else self.n
        self.n = max(1, min(keep, len(self.names)))
        self.n_ids, self.long = int(self.start[self.n - 1] + self.count[self.n - 1]), False
        self.names, held = self.names.slice(0, self.n), self.place < self.n
        self.hash, self.place = self.hash[held], self.place[held]

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places in a row, and how many each place has."""
        count = self.count[at]
        ends = np.cumsum(count)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint32), count
        return self.ids[np.repeat(self.start[at] - ends + count, count) + np.arange(ends[-1])], count

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of texts: the ids of its texts in a row, and where each text's begin (and the last ends)."""
        for part in slices(texts):
            flat, offsets = cut(part)
            ids, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
            for names, number in windows(flat):
                at = self.places(names)
                for k in range(0, len(number), GATHERED):
                    got, count = self.gather(at[number[k : k + GATHERED]])
                    ids.append(got)
                    counts.append(count)
            yield np.concatenate(ids), np.cumsum(np.concatenate(counts))[offsets]

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))[0]


def _hashes(names: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))


def _room(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """held with more behind its first n values, in an array that doubles when it is full."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.zeros(max(n, len(more)) + len(more), held.dtype)])
    held[n : n + len(more)] = more
    return held


class ByPieces(Known):
    """Chunks by way of their pieces: a chunk of a word and marks behind it has two, each of which serves many chunks."""

    def __init__(self, pieces: Known, size: int) -> None:
        super().__init__(size)
        self.pieces = pieces

    def odd(self, chunks_: list[str]) -> Iterable[np.ndarray]:
        """The ids of chunks that are not a word with marks."""
        raise NotImplementedError

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(WORD_AND_MARKS.fullmatch, new))
        names, number = windows_of([x for m in found if m for x in (m[1].lower(), m[2])])
        ids, count = self.pieces.gather(self.pieces.places(names)[number])
        count = count.reshape(-1, 2).sum(1)
        strange = [c for c, m in zip(new, found) if not m]
        if not strange:
            return ids, count
        plain = np.fromiter((m is not None for m in found), bool, len(found))
        got = list(self.odd(strange))
        every = np.zeros(len(new), np.int64)
        every[plain], every[~plain] = count, [len(x) for x in got]
        out = np.zeros(int(every.sum()), np.uint32)
        of_plain = np.repeat(plain, every)
        out[of_plain], out[~of_plain] = ids, np.concatenate(got)
        return out, every


def windows_of(names: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct names, and the number of every name among them."""
    d = pa.array(names, pa.string()).dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy()


class PieceIds(Known):
    """The library's ids of pieces, each of which is one word to it: joined by spaces they are encoded together, and dealt
    back by the mark that ends a word."""

    def __init__(self, path: str, size: int) -> None:
        super().__init__(size)
        self.lib = library(path)
        self.ends = np.zeros(max(self.lib.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.ends[[i for t, i in self.lib.get_vocab(with_added_tokens=False).items() if t.endswith(WORD_END)]] = True

    def learn(self, new: list[str], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        joined = [" ".join(new[k : k + together]) for k in range(0, len(new), together)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(joined, add_special_tokens=False)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(new) or last[-1] != len(ids) - 1:
            raise ValueError("a piece is not one word to this tokenizer")
        return ids, np.diff(last, prepend=-1)


class ChunkIds(ByPieces):
    """The library's ids of white-space chunks, kept per worker."""

    def __init__(self, path: str, size: int = 500_000) -> None:
        super().__init__(PieceIds(path, size * 3 // 5), size)
        self.lib = library(path)

    def odd(self, chunks_: list[str]) -> Iterable[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(chunks_, add_special_tokens=False)]


_WORKER: dict[tuple[str, int], ChunkIds] = {}


def worker_ids(path: str, size: int = 500_000) -> ChunkIds:
    """The cache of this worker, which outlives its tasks; one of another file or size takes its place."""
    if (path, size) not in _WORKER:
        _WORKER.clear()
        _WORKER[path, size] = ChunkIds(path, size)
    return _WORKER[path, size]


def frequent_chunks(docs: DataFrame, keep: int = 65_536, per_task: int = 4_096, room: int = 400_000) -> list[tuple[str, int]]:
    """The most frequent chunks of the whole corpus, by count down and then by code point.

    Each task counts all of its texts and passes on its per_task most frequent chunks, so what is shuffled is a
    summary of bounded size per task and no text.  What a window of over `wide` chunks holds once is passed over, and a
    task that knows over room different chunks drops the rarest.  The counts choose what is worth a table entry; no
    result depends on them.  At most keep rows come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch], wide: int = 100_000) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            for part in slices(b.column(0)):
                flat = cut(part)[0]
                for k in range(0, len(flat), WINDOW):
                    window = flat.slice(k, WINDOW)
                    found = pc.value_counts(window)
                    if len(window) > wide:
                        found = found.filter(pc.greater(found.field(1), 1))
                    names, n = found.field(0).to_pylist(), found.field(1).to_pylist()
                    seen.update(zip(names, map(int.__add__, n, map(seen.get, names, repeat(0)))))
                    low = 0
                    while len(seen) > room:
                        low += 1
                        seen = {c: n for c, n in seen.items() if n > low}
        seen.pop("", None)
        top = [(c, n) for c, n in nlargest(per_task, seen.items(), key=itemgetter(1)) if len(c) <= LONGEST]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    part = docs.select(text_col().alias("t")).mapInArrow(count, "chunk string, n bigint")
    top = part.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(keep)
    return [(r["chunk"], r["n"]) for r in top.collect()]
