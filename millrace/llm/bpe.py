"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The lexicon is compiled on the driver from the corpus's frequent words: their ids come from the exact merges, the
words go in sorted order into an automaton whose equal suffixes are shared (states are merged as soon as no later
word can change them).  Each state knows how many words lie before each of its arcs, so a walk adds up to the word's
rank and the rank points to its ids: a transducer with a perfect hash as output.  It is flat arrays in one file image
of bounded size (`lexicon_words`); a worker writes the image once into its own temporary folder and maps it into
memory, so the workers of an executor share its pages, and a lost executor only builds it again.

Per batch the new words walk the automaton together, one character a step.  Words that it does not hold are merged
exactly: the pair of lowest rank first, the leftmost of equal ones, over a heap of pairs, so a word of n letters costs
n log n.  A bounded cache per worker keeps what was encoded.

Normalisation as the file asks: special strings of the raw text are cut out first; NFC; white space; lower case per
code point; then pieces by the file's pattern, byte letters and the end-of-word mark.  Null text counts as empty: no
ids, decoded to the empty text.  Rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_col
from millrace.llm.pretoken import WORD_END, ByPieces, Known, frequent_chunks, library

HEAP_FROM = 24
LATIN = "\u024f"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """The tables of a tokenizer file and the exact encoding of one piece."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()

        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.library = library(path)

    def normal(self, text: str) -> str:
        """NFC, then lower case code point by code point (no rule for a final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, chunk: str) -> list[str | int]:
        """A white-space chunk as normal pieces; special strings come as their ids."""
        if self.cut is None or not self.cut.search(chunk):
            return self._pieces(chunk)
        out: list[str | int] = []
        for part in self.cut.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._pieces(part)
        return out

    def _pieces(self, part: str) -> list[str]:
        """By the pattern; beyond the Latin blocks the file's own rules say what a letter is, as Unicode's versions differ there."""
        if max(part) <= LATIN:
            return self.pattern.findall(self.normal(part))
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in found]

    def symbols(self, piece: str) -> list[str]:
        letters = [self.letters[b] for b in piece.encode()]
        letters[-1] += WORD_END
        return letters

    def merge(self, piece: str) -> list[int]:
        """The ids of a piece by exact merges."""
        syms = self.symbols(piece)
        return [self.vocab[s] for s in (self._by_scan(syms) if len(syms) < HEAP_FROM else self._by_heap(syms))]

    def _by_scan(self, syms: list[str]) -> list[str]:
        get, none = self.rank.get, len(self.rank)
        ranks = [get(p, none) for p in zip(syms, syms[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            syms[i] += syms.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((syms[i - 1], syms[i]), none)
            if i < len(ranks):
                ranks[i] = get((syms[i], syms[i + 1]), none)
        return syms

    def _by_heap(self, syms: list[str]) -> list[str]:
        rank, n = self.rank, len(syms)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, syms[i], syms[i + 1]) for i in range(n - 1) if (r := rank.get((syms[i], syms[i + 1]))) is not None]
        heapq.heapify(heap)
        live: list[str | None] = list(syms)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if live[i] != a or j < 0 or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank.get((live[x], live[y]))) is not None:
                    heapq.heappush(heap, (r, x, live[x], live[y]))
        return [s for s in live if s is not None]


class Lexicon:
    """A minimal acyclic automaton over words, with ids as outputs, as flat arrays over one buffer.

    `arc` has a sorted key for each arc, its state and character together, which finds arcs for many words at once;
    `target` is where it leads, `skip` how many words lie before it among those of its state (the state's own end
    included), and `end` whether a word ends in a state.
    """

    FIELDS = (("arc", "<u8"), ("end", "<u1"), ("target", "<u4"), ("skip", "<u4"), ("offset", "<u4"), ("ids", "<u4"))

    def __init__(self, **arrays: np.ndarray) -> None:
        self.a = arrays

    @staticmethod
    def compile(words: dict[str, list[int]]) -> Lexicon:
        """From words and their ids: incremental minimisation over the sorted words."""
        arcs: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # parent, character, child of the word before

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                parent, ch, child = path.pop()
                key = (ends[child], tuple(arcs[child].items()))
                same = known.setdefault(key, child)
                arcs[parent][ch] = same

        order, before = sorted(words), ""
        for w in order:
            common = len(os.path.commonprefix([before, w]))
            settle(common)
            state = path[-1][2] if path else 0
            for ch in map(ord, w[common:]):
                arcs.append({})
                ends.append(False)
                arcs[state][ch] = len(arcs) - 1
                path.append((state, ch, len(arcs) - 1))
                state = len(arcs) - 1
            ends[state] = True
            before = w
        settle(0)
        number, todo = {0: 0}, [0]
        for s in todo:  # live states in order of discovery
            for t in arcs[s].values():
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
        count: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            if missing := [t for t in arcs[s].values() if t not in count]:
                stack += missing
                continue
            stack.pop()
            count[s] = ends[s] + sum(count[t] for t in arcs[s].values())
        end, arc, target, skip = [], [], [], []
        for s in todo:
            below = int(ends[s])
            for ch, t in sorted(arcs[s].items()):
                arc.append(number[s] << 21 | ch)
                target.append(number[t])
                skip.append(below)
                below += count[t]
            end.append(ends[s])
        lengths = [len(words[w]) for w in order]
        return Lexicon(
            arc=np.array(arc, "<u8"), end=np.array(end, "<u1"), target=np.array(target, "<u4"), skip=np.array(skip, "<u4"),
            offset=np.concatenate([[0], np.cumsum(lengths)]).astype("<u4"), ids=np.array([i for w in order for i in words[w]], "<u4"),
        )

    def image(self) -> bytes:
        head = np.array([len(self.a[n]) for n, _ in self.FIELDS], "<u8").tobytes()
        return head + b"".join(self.a[n].astype(k).tobytes() + b"\0" * (-self.a[n].astype(k).nbytes % 8) for n, k in self.FIELDS)

    @staticmethod
    def over(buffer) -> Lexicon:
        """A lexicon whose arrays are views of the buffer."""
        sizes, at, arrays = np.frombuffer(buffer, "<u8", len(Lexicon.FIELDS)), 8 * len(Lexicon.FIELDS), {}
        for (name, kind), n in zip(Lexicon.FIELDS, sizes.tolist(), strict=True):
            arrays[name] = np.frombuffer(buffer, kind, n, at)
            at += (arrays[name].nbytes + 7) // 8 * 8
        return Lexicon(**arrays)

    @staticmethod
    def mapped(image: bytes) -> Lexicon:
        """The image as a memory-mapped file, which the workers of one machine share; a file that is not the image is
        written again."""
        digest = hashlib.sha256(image).digest()
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{digest.hex()[:24]}.bin")
        for _ in range(2):
            if os.path.exists(path):
                with open(path, "rb") as f:
                    view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                if hashlib.sha256(view).digest() == digest:
                    return Lexicon.over(view)
            with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
                f.write(image)
            os.replace(f.name, path)
        return Lexicon.over(image)

    def ranks(self, words: list[str]) -> np.ndarray:
        """The rank of each word among those of the lexicon, -1 for words that it does not hold."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        live, state, rank = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for step in range(int(lengths.max(initial=0)) + 1):
            done = lengths[live] == step
            hit = done & (self.a["end"][state] == 1)
            out[live[hit]] = rank[hit]
            live, state, rank = live[~done], state[~done], rank[~done]
            if not len(live):
                break
            key = (state.astype(np.uint64) << np.uint64(21)) | text[at[live] + step].astype(np.uint64)
            arc = np.searchsorted(self.a["arc"], key)
            found = arc < len(self.a["arc"])
            found[found] = self.a["arc"][arc[found]] == key[found]
            arc = arc[found]
            live, rank, state = live[found], rank[found] + self.a["skip"][arc], self.a["target"][arc].astype(np.int64)
        return out

    def output(self, rank: int) -> bytes:
        return self.a["ids"][self.a["offset"][rank] : self.a["offset"][rank + 1]].tobytes()


class WordIds(Known):
    """The ids of pieces by the lexicon, or by exact merges."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon, size: int) -> None:
        super().__init__(size)
        self.bpe, self.lexicon = bpe, lexicon

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.lexicon.output(r) if r >= 0 else array("I", self.bpe.merge(w)).tobytes() for w, r in zip(new, self.lexicon.ranks(new).tolist(), strict=True)]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


class Encoder(ByPieces):
    """Texts to ids and back, through the lexicon, the merges and a bounded cache."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon, size: int = 500_000) -> None:
        super().__init__(WordIds(bpe, lexicon, size * 3 // 5), size)
        self.bpe = bpe
        self.tokens = pa.array([bpe.token.get(i, "") for i in range(max(bpe.token) + 1)], pa.string())

    def odd(self, chunks_: list[str]) -> Iterable[np.ndarray]:
        split = list(map(self.bpe.pieces, chunks_))
        new = list({p for ps in split for p in ps if isinstance(p, str)})
        ids, count = self.pieces.gather(self.pieces.places(new))
        of = dict(zip(new, np.split(ids, np.cumsum(count)[:-1]), strict=True)) if new else {}
        return [np.concatenate([np.zeros(0, np.uint32), *(of[p] if isinstance(p, str) else np.array([p], np.uint32) for p in ps)]) for ps in split]

    def decode_parts(self, ids: np.ndarray, at_once: int = 16_000_000) -> Iterator[bytes]:
        """What decode gives, in UTF-8, in parts of a bounded number of ids."""
        for k in range(0, len(ids), at_once):
            words = self.tokens.take(pa.array(ids[k : k + at_once]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
            yield (b" " if k else b"") + joined[0].as_buffer().to_pybytes()

    def decode(self, ids: np.ndarray) -> str:
        """As a file without a decoder gives it: the tokens, special ones too, with a space between."""
        return b"".join(self.decode_parts(ids)).decode()

    def decoded_sha256(self, ids: np.ndarray, starts: np.ndarray, at_once: int = 16_000_000) -> list[str]:
        """The digest of each decoded text, of ids in a row and where each text's begin."""
        if len(ids) > at_once:
            out = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                sha = hashlib.sha256()
                for part in self.decode_parts(ids[a:b]):
                    sha.update(part)
                out.append(sha.hexdigest())
            return out
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), self.tokens.take(pa.array(ids))), " ")
        return [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]


def lexicon_of(docs: DataFrame, path: str, lexicon_words: int = 50_000) -> Lexicon:
    """The lexicon of a corpus: the pieces of its frequent chunks with their exact ids."""
    bpe, words = Bpe(path), {}
    for chunk, _ in frequent_chunks(docs, lexicon_words):
        for p in bpe.pieces(chunk):
            if isinstance(p, str) and p not in words and len(words) < lexicon_words:
                words[p] = bpe.merge(p)
    return Lexicon.compile(words)


_WORKER: dict[str, Encoder] = {}


def worker_encoder(path: str, image: bytes) -> Encoder:
    """The encoder of this worker, whose cache outlives its tasks; one of another file or lexicon takes its place."""
    key = f"{path}|{hashlib.sha256(image).hexdigest()}"
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(Bpe(path), Lexicon.mapped(image))
    return _WORKER[key]


def _batches(docs: DataFrame, path: str, lexicon_words: int, fn, schema: str) -> DataFrame:
    """docs (doc_id, text) through fn(encoder, batch) with the corpus's lexicon in every worker."""
    image = docs.sparkSession.sparkContext.broadcast(lexicon_of(docs, path, lexicon_words).image())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(path, image.value)
        for b in batches:
            yield fn(enc, b)

    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, lexicon_words: int = 50_000) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""

    def fn(enc: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x for all_ids, starts in enc.encode_all(b.column(1)) for x in np.split(all_ids.astype(np.int32), starts[1:-1])]
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return _batches(docs, path, lexicon_words, fn, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, lexicon_words: int = 50_000) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text of every document."""

    def fn(enc: Encoder, b: pa.RecordBatch) -> pa.RecordBatch:
        n, of_ids, of_text = [], [], []
        for ids, starts in enc.encode_all(b.column(1)):
            data = memoryview(ids.astype("<u4")).cast("B")
            at = (4 * starts).tolist()
            n += np.diff(starts).tolist()
            of_ids += [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:])]
            of_text += enc.decoded_sha256(ids, starts)
        return pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())})

    return _batches(docs, path, lexicon_words, fn, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
