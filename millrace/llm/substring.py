"""Passages that repeat across documents, by relative Lempel-Ziv parsing.

A window is `WINDOW` words in a row; it is told apart by a document of a smaller id in which it starts.

1. Anchors.  Of the `ANCHOR`-word chains of a window the one with the smallest hash is its anchor: equal windows have equal
   anchors wherever they stand, and a text has few of them.  Anchors that two documents share (counted where they lie first)
   go back to the texts as a bitmap that grows with their number up to `MOST_BITS`; what it lets through needlessly costs
   work and changes no result.
2. Blocks.  The stretches of windows with shared anchors are cut out of the texts, as words.  An anchor's home is the
   smallest document that has it; the stretches of such a document are a reference block.
3. Factors.  A block is indexed by its windows (hash to place).  Every stretch with an anchor whose home is the block is
   parsed against it: at each place whose window is indexed, the factor reaches as far as both texts go on alike, and the next one begins
   where it ends.  A factor has `WINDOW` words or more, so it is a duplicate span if the block's document has the smaller id.
4. Boundaries.  A window that lies in no factor, but across the end of one, is looked up in the block's index.  What has a
   shared anchor but is not in its home (a third context of a common chain, the surroundings of an edit) is compared exactly,
   window against window over all documents: windows of one text that are not in their anchor's home are so in every text.
5. The spans of a document are joined with its text; texts without spans are not moved.

Every document with an anchor meets that anchor's home and no other document: copies are parsed against the first one,
never against each other.  Parsing of a common block is dealt out (`graph.salted`): the block goes to each part that has rows.

Null and empty texts have no words.  A row without an id has no smaller document and is none: it keeps all its words.
Rows of one id are one document; each is judged against smaller ids.  Repeated rows give repeated results, an empty table an
empty one; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bitmaps import Bitmap, bitmap
from millrace.llm.common import text_col, written
from millrace.llm.graph import each_part, part_of, parts, salted

WINDOW = 13
ANCHOR = 8
#: Words that are hashed together.
PORTION = 200_000
#: Stands between the stretches of a block.
_END = np.uint64(0x5851F42D4C957F2D)

_ODD = np.random.default_rng(11).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def chains(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row."""
    m = len(h) - k + 1
    return _mix(sum((h[i : m + i] * _ODD[i] for i in range(1, k)), h[:m] * _ODD[0])) if m > 0 else np.empty(0, np.uint64)


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of every window."""
    c = chains(h, ANCHOR)
    m = len(h) - WINDOW + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = c[:m].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        np.minimum(out, c[k : m + k], out=out)
    return out


class Block:
    """A reference block: its words' hashes, indexed by window."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        keys = chains(words, WINDOW)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def places(self, windows: np.ndarray) -> np.ndarray:
        """The first place of each window in the block, or -1."""
        at = np.searchsorted(self.keys, windows)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == windows, self.order[at], -1)

    def alike(self, words: np.ndarray, i: int, place: int) -> int:
        """How far words from i on go on like the block from place on."""
        n, step, done = min(len(words) - i, len(self.words) - place), 64, 0
        while done < n:
            a, b = words[i + done : i + min(n, done + step)], self.words[place + done : place + min(n, done + step)]
            if len(differ := np.flatnonzero(a != b)):
                return done + int(differ[0])
            done += len(a)
            step *= 4
        return n

    def parse(self, words: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Which windows (given as hashes) of a text are in the block: those inside the factors of its greedy parse, and those
        across their boundaries that the index has."""
        found = np.zeros(len(windows), bool)
        place = self.places(windows)
        starts = np.flatnonzero(place >= 0)
        i = 0
        while (k := int(np.searchsorted(starts, i))) < len(starts):
            i = int(starts[k])
            length = self.alike(words, i, int(place[i]))
            if length < WINDOW:
                i += 1
                continue
            found[i : i + length - WINDOW + 1] = True
            end = i + length
            for j in range(end - WINDOW + 1, min(end, len(windows))):
                found[j] = found[j] or (place[j] >= 0 and self.alike(words, j, int(place[j])) >= WINDOW)
            i = end
        return found


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), text_col().alias("text"))


def _portions(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of a batch's texts, some rows at a time: (first row, words of each row)."""
    first, held, n = 0, [], 0
    for i, t in enumerate(batch.column(text).cast(pa.binary())):
        held.append(t.as_py().split())
        n += len(held[-1])
        if n >= PORTION:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def _anchored(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of all rows: (row, first window, number, anchor) of every stretch with one anchor."""
    lens = np.array([len(w) for w in rows])
    a = anchors(hashed([w for row in rows for w in row]))
    if not len(a):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    owner, start = np.repeat(np.arange(len(rows)), lens), np.cumsum(lens) - lens
    whole = owner[: len(a)] == owner[WINDOW - 1 :]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (owner[1 : len(a)] != owner[: len(a) - 1])])
    cut = np.flatnonzero(new | ~whole | np.concatenate([[False], ~whole[:-1]]))
    n = np.diff(np.append(cut, len(a)))
    cut, n = cut[whole[cut]], n[whole[cut]]
    return owner[cut], cut - start[owner[cut]], n, a[cut]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, doc): the anchors of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, rows in _portions(b, 1):
                row, _, _, anchor = _anchored(rows)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor.view(np.int64)), "doc": pa.array(ids[first + row])})

    return _rows(docs).filter("doc IS NOT NULL").mapInArrow(run, "anchor bigint, doc bigint")


def stretches(docs: DataFrame, shared: Bitmap) -> DataFrame:
    """(key, doc, th, at, words, anchors, firsts, runs, from_, upto): the stretches of windows whose anchors may be shared.  th is the text's
    hash, at the place of the first word, words are joined by spaces; windows firsts .. firsts + runs - 1 of the stretch have an anchor,
    and their words are its bytes from_ .. upto - 1."""
    held = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = pa.list_(pa.int64())
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), many, many, many, many, many)
        for b in batches:
            docs_, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            for start, rows in _portions(b, 1):
                row, first, runs, anchor = _anchored(rows)
                ok = held.value.has(anchor)
                row, first, runs, anchor = row[ok], first[ok], runs[ok], anchor[ok].view(np.int64)
                out: dict[str, list] = {c: [] for c in ("key", "doc", "th", "at", "words", "anchors", "firsts", "runs", "from_", "upto")}
                # A stretch goes on where the next anchor's windows follow at once.
                on = np.concatenate([[False], (row[1:] == row[:-1]) & (first[1:] == first[:-1] + runs[:-1])]) if len(row) else row.astype(bool)
                edge = np.append(np.flatnonzero(~on), len(row)).tolist()
                for x, y in zip(edge[:-1], edge[1:]):
                    i = int(row[x])
                    lo, hi = int(first[x]), int(first[y - 1] + runs[y - 1]) + WINDOW - 1
                    words, doc, th = rows[i][lo:hi], docs_[start + i], hashes[start + i]
                    byte = [0, *accumulate(len(w) + 1 for w in words)]
                    one, n = (first[x:y] - lo).tolist(), runs[x:y].tolist()
                    told = (xxhash.xxh3_64_intdigest(b"%d %d" % (th, lo)) - (1 << 63), doc, th, lo, b" ".join(words), anchor[x:y].tolist(), one, n, [byte[p] for p in one], [byte[p + q + WINDOW - 1] - 1 for p, q in zip(one, n)])
                    for c, v in zip(out.values(), told):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    rows = _rows(docs).filter("doc IS NOT NULL").withColumn("th", F.xxhash64("text"))
    return rows.mapInArrow(run, "key bigint, doc bigint, th bigint, at bigint, words binary, anchors array<bigint>, firsts array<bigint>, runs array<bigint>, from_ array<bigint>, upto array<bigint>")


def _stretches(ok: np.ndarray) -> list[list[int]]:
    """The stretches (from, to) of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8))).reshape(-1, 2).tolist()


def factored(rows: DataFrame) -> DataFrame:
    """Spans and open windows of stretches against their blocks.

    rows: (home, _salt, kind, doc, th, at, words, firsts, runs); of every home and salt first the stretches of the block (kind 0), then
    those parsed against it (kind 1), with the windows that look for their anchor there.  Returns (doc, th, first, last, w1, w2): the
    words of a duplicate span, or one window that is in no factor, with two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "th", "first", "last", "w1", "w2"]
        home, pieces, block = None, [], None
        for b in batches:
            homes, kinds, docs, ths, ats = (b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            firsts, runs = b.column(7), b.column(8)
            for start, rows in _portions(b, 6):
                words = hashed([w for row in rows for w in row])
                windows = chains(words, WINDOW)
                spans: list[tuple] = []
                left: list[tuple] = []
                upto = 0
                for i, row in enumerate(rows, start):
                    lo, upto = upto, upto + len(row)
                    if kinds[i] == 0:
                        if block is not None or homes[i] != home:
                            home, pieces, block = homes[i], [], None
                        pieces.append(words[lo:upto].copy())
                        continue
                    if homes[i] != home or not pieces:
                        raise ValueError("a stretch without its block")
                    if block is None:
                        block = Block(np.concatenate([np.append(p, _END) for p in pieces]))
                    found = block.parse(words[lo:upto], windows[lo : upto - WINDOW + 1])
                    want = np.zeros(len(found), bool)
                    for x, n in zip(firsts[i].as_py(), runs[i].as_py()):
                        want[x : x + n] = True
                    doc, th, at = docs[i], ths[i], ats[i]
                    spans += [(doc, th, at + x, at + y + WINDOW - 1) for x, y in _stretches(found & want)]
                    if len(open_ := np.flatnonzero(want & ~found)):
                        left.append((np.full(len(open_), doc), np.full(len(open_), th), at + open_, lo + open_))
                cols = [list(c) for c in zip(*spans)] or [[]] * 4
                empty = pa.nulls(len(cols[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), empty, empty], names=names)
                if left:
                    doc, th, at, place = (np.concatenate(c) for c in zip(*left))
                    others = chains(_mix(words + np.uint64(1)), WINDOW)
                    cols = [doc, th, at, at + WINDOW, windows[place].view(np.int64), others[place].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=names)

    dealt = rows.repartition("home", "_salt").sortWithinPartitions("home", "_salt", "kind")
    return dealt.select("home", "_salt", "kind", "doc", "th", "at", "words", "firsts", "runs").mapInArrow(run, "doc bigint, th bigint, first bigint, last bigint, w1 bigint, w2 bigint")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, first, last): words first .. last - 1 of the text with hash th of a document are covered by windows that start in a
    smaller document, too.  Spans of a document may overlap."""
    seen = anchor_rows(docs).groupBy("anchor").agg(F.min("doc").alias("home"), F.max("doc").alias("last"), parts(F.col("doc")))
    shared = written(seen.filter("home < last").select("anchor", "home", "_parts"), "anchors")
    cut = written(stretches(docs, bitmap(shared.select(F.col("anchor").alias("key")), shared.count())), "stretches")
    zipped = F.arrays_zip("anchors", "firsts", "runs", "from_", "upto")
    placed = cut.select("key", "doc", F.inline(zipped)).toDF("key", "doc", "anchor", "first", "n", "from_", "upto")
    met = salted(placed, shared, "anchor", F.col("doc")).filter("doc <> home")
    # Only the words between the first and the last window that look for a home go there.
    pairs = met.groupBy("key", "doc", "home").agg(F.collect_list(F.struct("first", "n")).alias("wanted"), F.min("first").alias("lo"), F.min("from_").alias("from_"), F.max("upto").alias("upto"))
    texts = cut.select("key", "doc", "th", "at", "words")
    met = pairs.join(texts, ["key", "doc"])
    piece = F.substring("words", (F.col("from_") + 1).cast("int"), (F.col("upto") - F.col("from_")).cast("int"))
    firsts = F.transform("wanted", lambda x: x["first"] - F.col("lo"))
    asking = written(met.select("home", "doc", "th", (F.col("at") + F.col("lo")).alias("at"), piece.alias("words"), firsts.alias("firsts"), F.col("wanted.n").alias("runs")), "asking")
    homes = asking.groupBy("home").agg(parts(F.col("doc")))
    asks = asking.select("home", part_of(F.col("doc")).alias("_salt"), F.lit(1).alias("kind"), "doc", "th", "at", "words", "firsts", "runs")
    blocks = texts.withColumnRenamed("doc", "home").join(homes, "home")
    none = F.array().cast("array<bigint>")
    blocks = each_part(blocks).select("home", "_salt", F.lit(0).alias("kind"), F.col("home").alias("doc"), "th", "at", "words", none.alias("firsts"), none.alias("runs"))
    found = written(factored(blocks.unionByName(asks)), "factors")
    spans = found.filter("w1 IS NULL").select("doc", "th", "first", "last")
    # Windows outside all factors, each against the smallest document that has it outside them, too.
    rest = found.filter("w1 IS NOT NULL")
    least = rest.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), parts(F.col("doc"))).filter("least < most").drop("most")
    again = salted(rest.withColumn("w", F.struct("w1", "w2")), least.withColumn("w", F.struct("w1", "w2")).drop("w1", "w2"), "w", F.col("doc"))
    return spans.unionByName(again.filter("doc > least").select("doc", "th", "first", "last"))


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    for lo, hi in spans:
        edge[lo] += 1
        edge[hi] -= 1
    return np.cumsum(edge[:n]) > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (first and last + 1 of what is removed, joined) and kept (the other words, joined by a space) of every row."""
    spans = duplicate_spans(docs).groupBy("doc", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = written(spans, "spans")
    rows = _rows(docs).withColumn("th", F.xxhash64("text"))
    key = F.xxhash64("doc", "th")
    marks = bitmap(spans.select(key.alias("key")), spans.count())
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def some(batches: Iterator[pa.RecordBatch], moved: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.has(b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)) == moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for doc, t, told in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                words = t.as_py().split()
                gone = covered(len(words), [(s["first"], s["last"]) for s in told or ()])
                for c, v in zip(out, (doc, len(words), [{"first": x, "last": y} for x, y in _stretches(gone)], b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if told else words))):
                    c.append(v)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind), pa.array(out[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    keyed, schema = rows.withColumn("key", key), "doc bigint, text string, th bigint, key bigint"
    moved = keyed.mapInArrow(lambda it: some(it, True), schema).join(spans, ["doc", "th"], "left").select("doc", "text", "spans")
    still = keyed.mapInArrow(lambda it: some(it, False), schema).select("doc", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    told = "doc_id bigint, n_words bigint, spans array<struct<first: bigint, last: bigint>>, kept string"
    return moved.mapInArrow(run, told).unionByName(still.mapInArrow(run, told))


def removed_passages(docs: DataFrame) -> DataFrame:
    """The query: doc_id, n_words, n_removed and the digest of the kept words of every row."""
    n = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"])
    return without_repeats(docs).select("doc_id", "n_words", n.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = """
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM split WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM places
), least AS (
  SELECT t, min(doc_id) AS first FROM windows GROUP BY t HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, list(i) AS starts FROM windows JOIN least USING (t) WHERE doc_id > first GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM (SELECT doc_id, unnest(starts) AS s FROM gone)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
)
SELECT s.doc_id, len(s.w)::BIGINT AS n_words, (len(s.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)
"""
