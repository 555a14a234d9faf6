"""Search: exact nearest vectors by a pivot index, documents that hold all words of a query, and both together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import shared_dir

#: The index is fitted on a sample of at most so many vectors, and has at most so many pivots a length of vector.
SAMPLE, PIVOTS = 2048, 256
#: Angles between a vector and its pivot are told apart in steps of pi / RINGS.
RINGS = 64
#: Queries and vectors that meet in a row, bytes of the vectors at most.
QUERIES, BLOCK_BYTES = 128, 1 << 18
#: A bound is not trusted beyond this: angles and scores are rounded.
SLACK = 1e-7
TOKENS = r"[^\p{L}\p{N}]+"
#: Texts and sets of words that meet in a group, at most about.
TEXTS, SETS = 20_000, 1_000_000


@dataclass
class Index:
    """Pivots (unit vectors) by length of vector, the sample, and how many vectors lie in each (length, pivot, ring)."""

    pivots: dict[int, np.ndarray]
    sample: dict[int, np.ndarray]
    counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score that a vector of each of the counted cells may have with the unit vector q."""
        cell, ring, _ = self.counts[len(q)]
        if len(q) not in self.pivots:
            return np.ones(len(cell))
        angle = np.arccos(np.clip(self.pivots[len(q)] @ q, -1, 1))[cell]
        low, high = ring * (np.pi / RINGS), (ring + 1) * (np.pi / RINGS)
        apart = np.maximum(0, np.maximum(angle - high, low - angle))
        return np.cos(np.minimum(apart, np.pi))


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each vector, or None where it is null, empty, has a null, NaN or infinite element, or has length zero."""
    for x in column:
        v = x.as_py()
        if not v or any(e is None for e in v):
            yield None
            continue
        a = np.array(v, np.float64)
        yield a if np.isfinite(a).all() and (a != 0).any() else None


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


def _spread(units: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors, each as far from the chosen ones as can be."""
    near, chosen = units @ units[0], [0]
    while len(chosen) < min(n, len(units)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, units @ units[k])
    return units[chosen]


def _fit(vectors: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    by: dict[int, list[np.ndarray]] = {}
    rows = vectors.select("embedding").orderBy(F.xxhash64("id"), F.xxhash64("embedding")).limit(SAMPLE).collect()
    for v in _vectors(pa.array([r.embedding for r in rows], pa.list_(pa.float64()))):
        if v is not None:
            by.setdefault(len(v), []).append(v)
    n = len(rows) if len(rows) < SAMPLE else vectors.count()
    pivots = {d: _spread(np.array([_unit(v) for v in vs]), max(1, min(PIVOTS, int(n**0.5) // 2))) for d, vs in by.items()}
    return pivots, {d: np.array(vs) for d, vs in by.items()}


def index(vectors: DataFrame) -> tuple[Index, DataFrame]:
    """The index of vectors (id, embedding), and their table: dim, cell, ring, id, data.

    A vector lies in the cell of its nearest pivot and in the ring of its angle to it; vectors of a length that the
    sample missed lie in one cell that every query of that length visits.  Vectors without a score are left out."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["id"]
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL AND id IS NOT NULL")
    pivots, sample = _fit(rows)
    held = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, v in enumerate(_vectors(b.column(1))):
                if v is None:
                    continue
                cell, ring = 0, 0
                if len(v) in held.value:
                    near = held.value[len(v)] @ _unit(v)
                    cell = int(near.argmax())
                    ring = min(RINGS - 1, int(np.arccos(np.clip(near[cell], -1, 1)) / np.pi * RINGS))
                for c, x in zip(out, (len(v), cell, ring, i, v.tobytes())):
                    c.append(x)
            ids = b.column(0).take(pa.array(out[3], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), ids, pa.array(out[4], pa.binary())], names=["dim", "cell", "ring", "id", "data"])

    path = shared_dir(spark, "vectors")
    rows.mapInArrow(run, f"dim int, cell int, ring int, id {kind}, data binary").write.parquet(path)
    placed = spark.read.parquet(path)
    counts: dict[int, list] = {}
    # One row for each pivot and ring at most.
    for r in placed.groupBy("dim", "cell", "ring").count().orderBy("dim", "cell", "ring").collect():
        counts.setdefault(r.dim, []).append((r.cell, r.ring, r["count"]))
    return Index(pivots, sample, {d: tuple(np.array(x) for x in zip(*c)) for d, c in counts.items()}), placed


def _packs(df: DataFrame, key: str, most: int, most_bytes: int) -> DataFrame:
    """Rows (dim, cell, ring, key, data) of a cell in packs: dim, cell, ring, keys, all data."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in at), pa.array([keys], pa.list_(key_type)), pa.array([b"".join(data)], pa.binary())], names=["dim", "cell", "ring", "keys", "data"])

        at, keys, data, size, key_type = None, [], [], 0, None
        for b in batches:
            key_type = b.column(3).type
            for dim, cell, ring, k, d in zip(*(c.to_pylist() for c in b.columns)):
                if keys and (at != (dim, cell, ring) or len(keys) >= most or size + len(d) > most_bytes):
                    yield told()
                    keys, data, size = [], [], 0
                at = (dim, cell, ring)
                keys.append(k)
                data.append(d)
                size += len(d)
        if keys:
            yield told()

    # A hot cell lies in several parts, each packed for itself.
    part = F.pmod(F.xxhash64(key), F.lit(16))
    dealt = df.withColumn("_part", part).repartition("dim", "cell", "ring", "_part").sortWithinPartitions("dim", "cell", "ring", "_part")
    return dealt.select("dim", "cell", "ring", key, "data").mapInArrow(run, f"dim int, cell int, ring int, keys array<{kind}>, data binary")


def _asks(queries: DataFrame, ix: Index, k: int, kind: str) -> DataFrame:
    """(dim, cell, ring, query_id, data) of the cells that a query must visit.  queries has query_id, query, floor: a score that k vectors
    reach (null: none is known).  kind `probe` asks for the most promising cells that hold k vectors, `rest` for all others whose
    bound reaches the floor."""
    held = queries.sparkSession.sparkContext.broadcast(ix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, (v, floor) in enumerate(zip(_vectors(b.column(1)), b.column(2).to_pylist())):
                if v is None or len(v) not in ix.counts:
                    continue
                cell, ring, n = ix.counts[len(v)]
                bound = ix.bounds(_unit(v))
                order = np.argsort(-bound, kind="stable")
                probed = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                ask = probed if kind == "probe" else np.setdiff1d(np.arange(len(n)) if floor is None else np.flatnonzero(bound >= floor - SLACK), probed)
                for j in ask.tolist():
                    for c, x in zip(out, (len(v), cell[j], ring[j], i, v.tobytes())):
                        c.append(x)
            ids = b.column(0).take(pa.array(out[3], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(out[x], pa.int32()) for x in range(3)), ids, pa.array(out[4], pa.binary())], names=["dim", "cell", "ring", "query_id", "data"])

    return queries.select("query_id", "query", "floor").mapInArrow(run, f"dim int, cell int, ring int, query_id {dict(queries.dtypes)['query_id']}, data binary")


def _scored(asks: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best of every pair of packs; those that tie with the last all stay."""
    q, v = dict(asks.dtypes)["query_id"], dict(blocks.dtypes)["keys"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, qk, qd, vk, vd in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist()):
                a, c = (np.frombuffer(d, "<f8").reshape(-1, dim) for d in (qd, vd))
                a, c = (x / np.abs(x).max(1)[:, None] for x in (a, c))
                score = np.round((a @ c.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None, :], 12)
                best = np.sort(-score, axis=1)[:, min(k, score.shape[1]) - 1]
                row, col = np.nonzero(-score <= best[:, None])
                yield pa.RecordBatch.from_arrays([qk.values.take(pa.array(row)), vk.values.take(pa.array(col)), pa.array(score[row, col])], names=["query_id", "id", "score"])

    packs = _packs(asks, "query_id", QUERIES, 1 << 30).select("dim", "cell", "ring", F.col("keys").alias("q_keys"), F.col("data").alias("q_data"))
    met = packs.join(blocks, ["dim", "cell", "ring"]).select("dim", "q_keys", "q_data", "keys", "data")
    return met.mapInArrow(run, f"query_id {q}, id {v}, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, where: Column | None = None, block: int = 1024) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows of each query (query_id, query) among vectors (id, embedding), by cosine; ties (scores
    equal to twelve digits) go to the smaller id.

    The vectors are indexed by pivots.  A query first probes the most promising cells that hold k vectors; with the k-th
    score it found, it passes over every cell whose vectors cannot reach it by the triangle inequality, and visits all
    others.  Queries meet vectors by an equal join on cells, in packs.

    Vectors that `where` does not admit are left out.  Null and empty vectors, those with a null, NaN or infinite element and
    those of length zero have no score; a query and a vector of different lengths have none together.  A query with
    fewer than k scored vectors gets them all.  query_id and id name their rows."""
    v = vectors.filter(where) if where is not None else vectors
    ix, placed = index(v)
    q = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).filter("query IS NOT NULL AND query_id IS NOT NULL")
    blocks = _packs(placed, "id", block, BLOCK_BYTES)
    path = shared_dir(queries.sparkSession, "probed")
    _best(_scored(_asks(q.withColumn("floor", F.lit(None).cast("double")), ix, k, "probe"), blocks, k), k).write.parquet(path)
    probed = queries.sparkSession.read.parquet(path)
    floor = probed.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = _scored(_asks(q.join(floor, "query_id", "left"), ix, k, "rest"), blocks, k)
    return _best(probed.drop("rank").unionByName(rest), k)


def passed_over(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, cells, visited: how many cells of the index there are for each query, and how many `nearest` visits."""
    ix, placed = index(vectors)
    q = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    probe = _asks(q.withColumn("floor", F.lit(None).cast("double")), ix, k, "probe")
    hits = _best(_scored(probe, _packs(placed, "id", 1024, BLOCK_BYTES), k), k)
    floor = hits.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    visits = probe.unionByName(_asks(q.join(floor, "query_id", "left"), ix, k, "rest"))
    cells = F.lit(0)
    for dim, (cell, _, _) in ix.counts.items():
        cells = F.when(F.col("dim") == dim, len(cell)).otherwise(cells)
    return visits.groupBy("query_id", "dim").agg(F.count("*").alias("visited")).select("query_id", cells.alias("cells"), "visited")


def _words() -> Column:
    """The lower-cased words of a text, each once."""
    return F.array_distinct(F.filter(F.split(F.lower("text"), TOKENS), lambda w: w != ""))


def _asked() -> Column:
    """The words of a query, cut like the texts, each once."""
    return F.array_distinct(F.filter(F.flatten(F.transform("words", lambda w: F.split(F.lower(w), TOKENS))), lambda w: w != ""))


def postings(texts: DataFrame) -> DataFrame:
    """(term, id): the lower-cased words of texts (id, text), each once a text."""
    return texts.filter("id IS NOT NULL").select("id", F.explode(_words()).alias("term"))


def holding_all(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, id): the texts (id, text) that hold every word of a query (query_id, words).

    Words are cut and lower-cased like the texts, so a dotted word stands for its parts.  A query starts from the posting
    list of its rarest word, and each text there is looked up for the others, so the work grows with the rarest word's
    list.  Queries without a word, and such with one that no text has, have no rows."""
    asked = queries.select("query_id", F.explode(_asked()).alias("term"))
    lists = postings(texts)
    wanted = lists.join(asked.select("term").distinct(), "term", "left_semi")
    sizes = wanted.groupBy("term").agg(F.count("*").alias("n"))
    known = asked.join(sizes, "term", "left")
    rare = known.groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r"), (F.count("*") - 1).alias("others")).filter("r.n > 0")
    some = rare.select("query_id", F.col("r.term").alias("term"), "others").join(wanted, "term").select("query_id", "id", "others", F.col("term").alias("_first"))
    alone = some.filter("others = 0").select("query_id", "id")
    more = some.filter("others > 0").join(asked, "query_id").filter("term <> _first").join(wanted, ["term", "id"])
    return alone.unionByName(more.groupBy("query_id", "id").agg(F.count("*").alias("n"), F.first("others").alias("others")).filter("n = others").select("query_id", "id"))


def _held(texts: pa.Table, sets: pa.Table) -> pa.Table:
    """terms, hits, first_hit: how many of the texts (id, held) hold all words of each set (terms), and the least id of them."""
    texts = texts.select(["id", "held"]).sort_by("id")
    ids, held = texts.column("id"), texts.column("held").combine_chunks()
    words = held.flatten().dictionary_encode()
    code = words.indices.to_numpy()
    # The places of the texts that hold a word, in order, one word after the other.
    place = np.repeat(np.arange(len(ids), dtype=np.int32), held.value_lengths().to_numpy())[np.argsort(code, kind="stable")]
    n = np.bincount(code, minlength=len(words.dictionary))
    end = np.cumsum(n)
    terms = sets.column("terms").combine_chunks()
    asked = pc.index_in(terms.flatten(), words.dictionary).fill_null(-1).to_numpy()
    stop = np.cumsum(terms.value_lengths().to_numpy())
    known = np.flatnonzero(np.minimum.reduceat(asked, np.r_[0, stop[:-1]]) >= 0) if len(asked) else []
    rows, hits, first = [], [], []
    for i in known:
        own = asked[stop[i - 1] if i else 0 : stop[i]]
        own = own[np.argsort(n[own], kind="stable")]
        some = place[end[own[0]] - n[own[0]] : end[own[0]]]
        for w in own[1:]:
            other = place[end[w] - n[w] : end[w]]
            some = some[other[np.minimum(np.searchsorted(other, some), len(other) - 1)] == some]
            if not len(some):
                break
        if len(some):
            rows.append(i)
            hits.append(len(some))
            first.append(some[0])
    return pa.table({"terms": terms.take(pa.array(rows, pa.int64())), "hits": pa.array(hits, pa.int64()), "first_hit": ids.take(pa.array(first, pa.int64()))})


def count_holding_all(queries: DataFrame, texts: DataFrame, most: int = TEXTS, most_sets: int = SETS) -> DataFrame:
    """query_id, hits, first_hit: how many texts (id, text; an id names one) hold every word of a query (query_id, words), and the least id of
    them.  Queries as in `holding_all`; those without a hit have no row.

    The pairs of `holding_all` grow with queries times texts, so none is written: each different set of words meets each block of `most`
    texts once, finds its hits in the block's posting lists from the rarest word on, and leaves one row."""
    spark, kind = queries.sparkSession, dict(texts.dtypes)["id"]
    asked = queries.select("query_id", F.array_sort(_asked()).alias("terms")).filter("size(terms) > 0")
    path = shared_dir(spark, "word-sets")
    asked.select("terms").distinct().write.parquet(path)
    sets = spark.read.schema("terms array<string>").parquet(path)
    blocks, slices = (max(1, -(-df.count() // m)) for df, m in ((texts, most), (sets, most_sets)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    t = texts.filter("id IS NOT NULL").select(part("id", blocks).alias("block"), each(slices).alias("slice"), "id", _words().alias("held")).filter("size(held) > 0")
    s = sets.select(each(blocks).alias("block"), part("terms", slices).alias("slice"), "terms")
    keys = ["block", "slice"]
    found = t.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(_held, f"terms array<string>, hits bigint, first_hit {kind}")
    total = found.groupBy("terms").agg(F.sum("hits").alias("hits"), F.min("first_hit").alias("first_hit"))
    return asked.join(total, "terms").select("query_id", "hits", "first_hit")


def hybrid(queries: DataFrame, chunks: DataFrame, k: int, words: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: the k nearest of the chunks (id, embedding, text) that hold every word: of `words` for all queries, else of
    each query's own `words`.  Queries whose words are empty search all chunks."""
    some = chunks.filter(where) if where is not None else chunks
    if words is not None:
        tokens = F.split(F.lower("text"), TOKENS)
        hit = F.lit(True)
        for x in words:
            hit = hit & F.array_contains(tokens, x.lower())
        return nearest(queries, some.filter(hit), k)
    bare = F.size(F.filter(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.length(F.regexp_replace(w, TOKENS, "")) > 0)) == 0
    pairs = holding_all(queries, some)
    d = lambda c: F.col(c).cast("array<double>")
    met = pairs.join(queries.select("query_id", d("query").alias("_q")), "query_id").join(some.select("id", d("embedding").alias("_v")), "id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = F.round(dot("_q", "_v") / F.sqrt(dot("_q", "_q")) / F.sqrt(dot("_v", "_v")), 12)
    whole = (F.size("_q") == F.size("_v")) & (dot("_q", "_q") > 0) & (dot("_v", "_v") > 0)
    own = _best(met.filter(whole).select("query_id", "id", score.alias("score")).filter("score IS NOT NULL AND NOT isnan(score)"), k)
    return own.unionByName(nearest(queries.filter(bare), some, k))
