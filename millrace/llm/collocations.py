"""Phrases of two to four words that belong together, counted in quotient filters.

1. Words.  Each word of a language has a 64-bit id, a hash of both; that no two of all counted words share an id is tested,
   and another seed taken if two do, so an id stands for its word without loss.
2. Counters.  An n-gram is packed as its n word ids.  `permuted` maps it onto itself one to one, so its bits are evenly
   spread; the first bits are the quotient, all others the remainder, kept whole.  A shard's n-grams are counted where
   they lie and become counting quotient filters (`Filter`): sorted by quotient, with one bit that says that a quotient is
   in use, one that ends its run, the remainders and the counters.  Filters of the same slice of quotients are merged
   over all shards by their order; the permutation's inverse gives the word ids back.
3. Levels.  A phrase that occurs 30 times has parts that do: a bitmap of the frequent words' ids, then one of the frequent
   pairs, decides which n-grams get a counter.  The bitmaps grow with what they hold up to `bitmaps.MOST_BITS`; what they let
   through needlessly costs a counter and changes no result.
4. Scores by joins on word ids, in decimal arithmetic; the first 2,000 of a language are chosen in parts first.

A null text is empty, a null lang `und`.  Repeated rows count each time, ids of documents are not read, and other
columns may have any name.  Languages without a candidate have no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bitmaps import Bitmap, bitmap
from millrace.llm.common import text_col, written

LEAST = 30
LONGEST = 4
FIRST = 2000
COVERED_PCT = 80
SCALE = 2_000_000
#: Tokens whose n-grams are counted together, and words held before they are passed on.
BLOCK = 2_000_000
HELD = 400_000
#: N-grams of a slice of quotients, about.
SLICE = 1 << 20
MOST_SLICES = 1 << 14
#: Runs of entries that a merge holds apart.
RUNS = 8

_BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", _BREAK * 10 + b" abcdefghijklmnopqrstuvwxyz")


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased, and a break between its pieces."""
    return text.translate(_TABLE).replace(_BREAK, b" \xff ").split()


def word_id(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode(), seed=seed))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def permuted(ids: np.ndarray) -> np.ndarray:
    """Two or more rows of word ids, one for each place of the n-gram, mapped one to one: in turn each row takes in a mix of the next."""
    out, n = ids.copy(), len(ids)
    for step in range(2 * n):
        k = (-step) % n
        out[k] ^= _mix(out[(k + 1) % n] + np.uint64(step + 1))
    return out


def restored(mixed: np.ndarray) -> np.ndarray:
    """The inverse of `permuted`."""
    out, n = mixed.copy(), len(mixed)
    for step in reversed(range(2 * n)):
        k = (-step) % n
        out[k] ^= _mix(out[(k + 1) % n] + np.uint64(step + 1))
    return out


def _sorted(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns in order, equal ones once with their counts added."""
    order = np.lexsort(rows[::-1]) if rows.shape[1] else np.empty(0, np.int64)
    rows, counts = rows[:, order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])) if len(counts) else order
    return rows[:, first], np.add.reduceat(counts, first) if len(first) else counts


class Filter:
    """A counting quotient filter of permuted n-grams that share their first `skip` bits.

    As bytes: width in words, skip, quotient bits q, entries m; 2^q bits of quotients in use; m bits that end a run; the rest
    of the first word and all other words of each entry; counters of one byte, 255 standing for one of eight bytes at the end.
    """

    @staticmethod
    def pack(rows: np.ndarray, counts: np.ndarray, skip: int) -> bytes:
        """Sorted distinct columns and their counts as a filter."""
        m = rows.shape[1]
        q = max(3, int(m).bit_length() - 1)
        place = ((rows[0] << np.uint64(skip)) >> np.uint64(64 - q)).astype(np.int64)
        used = np.zeros(1 << q, bool)
        used[place] = True
        ends = np.concatenate([place[1:] != place[:-1], [True]]) if m else np.empty(0, bool)
        rest = (64 - skip - q + 7) // 8
        low = rows[0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :rest]
        large = counts > 254
        small = np.where(large, 255, counts).astype(np.uint8)
        head = np.array([len(rows), skip, q, m], "<u4").tobytes()
        return b"".join([head, np.packbits(used).tobytes(), np.packbits(ends).tobytes(), low.tobytes(), rows[1:].astype("<u8").tobytes(), small.tobytes(), counts[large].astype("<u8").tobytes()])

    @staticmethod
    def unpack(data: bytes, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """The columns and counts of a filter whose first bits are prefix."""
        n, skip, q, m = np.frombuffer(data, "<u4", 4).tolist()
        at = 16

        def take(size: int, kind: str = "u1") -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, size, at)
            at += got.nbytes
            return got

        used = np.flatnonzero(np.unpackbits(take((1 << q) // 8)))
        ends = np.unpackbits(take((m + 7) // 8))[:m].astype(np.int64)
        place = used[np.cumsum(ends) - ends] if m else np.empty(0, np.int64)
        rest = (64 - skip - q + 7) // 8
        low = np.zeros((m, 8), np.uint8)
        low[:, :rest] = take(m * rest).reshape(m, rest)
        kept = np.uint64((1 << (64 - skip - q)) - 1)
        first = (low.reshape(-1).view("<u8") & kept) | (place.astype(np.uint64) << np.uint64(64 - skip - q))
        if skip:
            first = first | np.uint64(prefix << (64 - skip))
        rows = np.vstack([first[None, :], take(m * (n - 1), "<u8").reshape(n - 1, m)])
        counts = take(m).astype(np.int64)
        counts[counts == 255] = take(int((counts == 255).sum()), "<u8").astype(np.int64)
        return rows.astype(np.uint64), counts


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_col().alias("text"))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n of every word; words are counted where they lie first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(_BREAK, None)
                words = list(c)
                ids = np.fromiter((word_id(lang, w, seed) for w in words), np.uint64, len(words)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(words, pa.binary()).cast(pa.string()), "id": pa.array(ids), "n": pa.array(list(c.values()), pa.int64())})
            held.clear()

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                held.setdefault(lang, Counter()).update(tokens(t.as_py()))
            if sum(map(len, held.values())) > HELD:
                yield from told()
        yield from told()

    counted = _rows(docs).mapInArrow(run, "lang string, word string, id bigint, n bigint")
    return counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def numbered_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """The table of all words, of which no two share an id, and the seed of the ids."""
    for seed in range(16):
        words = written(word_counts(docs, seed), "words")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
    raise ValueError("word ids clash for every seed")


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))))


def shard_filters(docs: DataFrame, seed: int, words: Bitmap, pairs: Bitmap | None, slice_bits: int) -> DataFrame:
    """(n, slice, data): the filters of each shard, of pairs, or with the bitmap of frequent pairs of longer n-grams."""
    spark = docs.sparkSession
    words_b = spark.sparkContext.broadcast(words)
    pairs_b = None if pairs is None else spark.sparkContext.broadcast(pairs)

    def filters(ids: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Of a run of word ids in which zeros stand for breaks."""
        known = (ids != 0) & words_b.value.has(ids)
        two = known[:-1] & known[1:]
        if pairs_b is not None:
            at = np.flatnonzero(two)
            two[at] = pairs_b.value.has(_pair_key(ids[at], ids[at + 1]))
        for n in (2,) if pairs_b is None else range(3, LONGEST + 1):
            ok = two[: len(ids) - n + 1].copy()
            for k in range(1, n - 1):
                ok &= two[k : len(ids) - n + 1 + k]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            rows, counts = _sorted(permuted(np.vstack([ids[at + k] for k in range(n)])), np.ones(len(at), np.int64))
            part = (rows[0] >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(counts), np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield n, int(part[lo]), Filter.pack(rows[:, lo:hi], counts[lo:hi], slice_bits)

    def told(ids: list[int]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        size = 0
        for row in filters(np.array(ids, np.uint64)):
            for c, v in zip(out, row):
                c.append(v)
            size += len(row[2])
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["n", "slice", "data"])
                out, size = ([], [], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["n", "slice", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        ids: list[int] = []
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                mine = known.setdefault(lang, {_BREAK: 0})
                for w in (got := tokens(t.as_py())):
                    if w not in mine:
                        mine[w] = word_id(lang, w, seed)
                ids += map(mine.__getitem__, got)
                ids.append(0)
                if len(ids) > BLOCK:
                    yield from told(ids)
                    ids = []
            if sum(map(len, known.values())) > 2 * HELD:
                known.clear()
        if ids:
            yield from told(ids)

    return _rows(docs).mapInArrow(run, "n int, slice int, data binary")


def merged(filters: DataFrame, slice_bits: int, least: int) -> DataFrame:
    """(ids, n): the n-grams that occur at least so often, as arrays of word ids, from the filters of all shards."""

    def summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return _sorted(np.hstack([r for r, _ in runs]), np.concatenate([c for _, c in runs]))

    def told(runs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows, counts = summed(runs)
        often = counts >= least
        ids = restored(rows[:, often]).T.astype(np.int64)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * rows.shape[0]), pa.array(ids.reshape(-1)))
        return pa.RecordBatch.from_arrays([values, pa.array(counts[often])], names=["ids", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs = None, []
        for b in batches:
            for n, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if key != (n, part):
                    if runs:
                        yield told(runs)
                    key, runs = (n, part), []
                runs.append(Filter.unpack(data.as_py(), part))
                # Equal sizes are merged: each entry is merged as often as its run doubles.
                while len(runs) > RUNS and len(runs[-1][1]) * 2 > len(runs[-2][1]):
                    runs[-2:] = [summed(runs[-2:])]
        if runs:
            yield told(runs)

    parts = filters.repartition("n", "slice").sortWithinPartitions("n", "slice")
    return parts.mapInArrow(run, "ids array<bigint>, n bigint")


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, n) of the words and phrases of up to four words that occur at least so often; all words (lang, word, id, n); and the
    number of words of each language."""
    words, seed = numbered_words(docs)
    langs = words.groupBy("lang").agg(F.sum("n").alias("total"))
    often = words.filter(F.col("n") >= least)
    size = often.agg(F.count("*").alias("k"), F.sum("n").alias("t")).first()
    single = often.select(F.array("id").alias("ids"), "n")
    if not size.k:
        return single, words, langs
    slices = min(MOST_SLICES, max(64, size.t // SLICE))
    bits = int(slices - 1).bit_length()
    known = bitmap(often.select(F.col("id").alias("key")), size.k)
    two = written(merged(shard_filters(docs, seed, known, None, bits), bits, least), "pairs")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"key": pa.array(_pair_key(flat[:, 0], flat[:, 1]).view(np.int64))})

    pairs = bitmap(two.mapInArrow(keys, "key bigint"), two.count())
    more = written(merged(shard_filters(docs, seed, known, pairs, bits), bits, least), "longer")
    return single.unionByName(two).unionByName(more), words, langs


def _worth(a: Column, l_: Column, r: Column) -> Column:
    wide = lambda c: c.cast("decimal(27,0)")
    # Decimal division rounds; what is over is taken off first, so the quotient is whole.
    top, low = wide(a) * F.lit(SCALE).cast("decimal(10,0)"), wide(l_) + wide(r)
    return ((top - top % low) / low).cast("decimal(20,0)").cast("bigint")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language."""
    counts, words, langs = frequent_phrases(docs, least)
    counts = written(counts, "counts")
    size = F.size("ids")
    phrases = counts.filter(size > 1)
    # Every cut of a candidate, the two parts' counts, and the lowest score's cut.
    cut = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), F.slice("ids", 1, k).alias("left"), F.slice("ids", k + 1, size - k).alias("right")))
    cuts = phrases.select("ids", F.col("n").alias("a"), F.inline(cut))
    part = lambda name, to: counts.select(F.col("ids").alias(name), F.col("n").alias(to))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    scored = cuts.withColumn("score", _worth(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # The most frequent longer candidate around each phrase.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    around = phrases.filter(size > 2).select(F.explode(inner).alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("longer"))
    kept = best.join(around, "ids", "left").filter(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(27,0)") < COVERED_PCT * F.col("a").cast("decimal(27,0)")))
    named = kept.select("ids", "a", "best.*")
    often = words.filter(F.col("n") >= least)
    for i in range(LONGEST):
        text = often.select(F.col("id").alias(f"id{i}"), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 0 else []))
        named = named.withColumn(f"id{i}", F.get("ids", F.lit(i))).join(text, f"id{i}", "inner" if i == 0 else "left")
    told = named.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(LONGEST)]).alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = told.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_at") <= first)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= first)
    return ranked.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE i + m - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), often AS (
  SELECT lang, m, phrase, f FROM grams WHERE f >= 30
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE m > 1
), cuts AS (
  SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored
), sizes AS (
  SELECT lang, a, w, m, unnest(range(2, m)) AS j FROM candidates WHERE m > 2
), inside AS (
  SELECT lang, a, w, j, unnest(range(1, m - j + 2)) AS i FROM sizes
), around AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM inside GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE b.nth = 1 AND (o.longer IS NULL OR 100 * o.longer < 80 * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
