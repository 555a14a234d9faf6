"""Near-duplicate components by the chosen-path set similarity join.

1. Sketch: each text becomes its set of 5-word shingles (64-bit hashes), of which a digest of the whole set and
   `COORDS` minwise tokens are kept.  Documents of one set are one class; from here on only its smallest doc_id goes on.
2. Trees: `TREES` trees branch the classes by the minwise token of one coordinate.  Nodes of up to `LEAF` members are
   compared exhaustively.  Larger ones are dealt into blocks of LEAF members, compared like leaves, which joins a dense
   group of copies into few components at a cost in proportion to it.
3. The rest of large nodes: where at most LEAF members lie outside a node's largest component, these are compared
   exactly with all members, and so is a node of at most `EXACT` members, block against block.  Beyond that (unlike
   documents that share a passage) the node branches again, by `FORKS` coordinates drawn from its path, and its parts are
   looked at in the same way.  A part that kept more than four fifths of its members twice in a row holds texts too alike for branchings
   to tell apart, and is compared exactly.

With likeness s, a pair is in one tree's first node with probability s, and found below a branching node with
q = 1 - (1 - s q')^FORKS, q' being its chance one level down.  For s = 0.8 q stays above 0.9375 at any depth, so 8 trees
miss a pair with probability below 0.25^8 < 2e-5 if all its nodes branch, and 0.2^8 < 3e-6 if none does.

Leaves are screened by the minwise tokens (a screen that a pair of likeness 0.8 fails with probability below 1e-6);
what passes is confirmed on the full sets, and of the confirmed links only a spanning forest leaves a task: no pair
of a group is ever listed.  The full sets are sets of 64-bit hashes: two sets of 10,000 shingles differ from the sets of
words in any count with probability below 1e-11.  They are worked out where the texts lie, for documents that a bitmap of
fixed size lets through (all that are wanted, and few more), so no text is shuffled.  Components come from alternating
large-star and small-star steps over the forest.

Null and empty texts have the empty set and are linked with nothing.  Rows of one doc_id are one document, even when
their texts differ.  A null doc_id has no component (null) and is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import row_hash, text_col, wanted_rows, written
from millrace.llm.graph import components, parts, salted

SHINGLE = 5
COORDS = 64
TREES = 8
LEAF = 1024
FORKS = 2
EXACT = 4096
SCREEN = 35
BLOCK = 1024
#: Shingles whose places are worked out at once.
STRIP = 4_000_000
LEAST_PCT = 85

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_FACTORS = np.random.default_rng(7).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    x = sum((h[k : n - SHINGLE + 1 + k] * _ODD[k] for k in range(1, SHINGLE)), h[: n - SHINGLE + 1] * _ODD[0])
    return np.unique(mix(x))


def minwise(ids: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of each coordinate."""
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(ids), 4096):
        np.minimum(out, ((ids[k : k + 4096, None] * _FACTORS) >> np.uint64(32)).astype(np.uint32).min(0), out=out)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id, sig (minwise tokens) and nodes (of the first level) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(TREES, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for t in b.column(1):
                ids = shingles(t.as_py())
                sig = minwise(ids) if len(ids) else None
                for c, v in zip(cols, (len(ids), hashlib.blake2b(ids.tobytes(), digest_size=16).digest() if len(ids) else None, None if sig is None else sig.tobytes(), [] if sig is None else mix(tree | sig[:TREES].astype(np.uint64)).astype(np.int64))):
                    c.append(v)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0), "n_shingles": pa.array(cols[0], pa.int64()), "set_id": pa.array(cols[1], pa.binary()), "sig": pa.array(cols[2], pa.binary()), "nodes": pa.array(cols[3], pa.list_(pa.int64()))}
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_id binary, sig binary, nodes array<bigint>")


def _sized(nodes: DataFrame) -> DataFrame:
    """(node, doc, ...) with the node's size, without the nodes of one member."""
    return salted(nodes, nodes.groupBy("node").agg(F.count("*").alias("size"), parts(F.col("doc"))).filter("size > 1"), "node", F.col("doc"))


def _children(rows: DataFrame) -> DataFrame:
    """(node, doc, comp, sig, was, slow) one level down: FORKS children of each row, by coordinates drawn from its node's path; was
    is the size of the node above, slow for how many branchings in a row it has hardly shrunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sig = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u4").reshape(-1, COORDS)
            for fork in range(FORKS):
                at = mix(node + np.uint64(fork)) % np.uint64(COORDS)
                token = sig[np.arange(len(at)), at.astype(np.int64)].astype(np.uint64)
                child = mix(node ^ mix((np.uint64(fork) << np.uint64(48)) | (at << np.uint64(32)) | token))
                yield pa.RecordBatch.from_pydict({"node": pa.array(child.view(np.int64)), "doc": b.column(1), "comp": b.column(2), "sig": b.column(3), "was": b.column(4), "slow": b.column(5)})

    return rows.select("node", "doc", "comp", "sig", "m", "slow").mapInArrow(run, "node bigint, doc bigint, comp bigint, sig binary, was bigint, slow int")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal values in the first column, over batch borders."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(x, y - x)
            if held and held[-1].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _clusters(rows: DataFrame) -> DataFrame:
    """Leaves (node, doc, sig) to groups: the sets of members that the screen leaves together, each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = []
        for t in _by_group(batches):
            docs = t.column(1).to_pylist()
            if len(docs) < 2:
                continue
            sig = np.frombuffer(b"".join(t.column(2).to_pylist()), "<u4").reshape(-1, COORDS)
            f = Forest(len(docs))
            for i in range(len(docs) - 1):
                for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(1) >= SCREEN).tolist():
                    f.join(i, i + 1 + j)
            sets: dict[int, list[int]] = {}
            for i, d in enumerate(docs):
                sets.setdefault(f.find(i), []).append(d)
            out += [sorted(s) for s in sets.values() if len(s) > 1]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pydict({"members": pa.array(out, pa.list_(pa.int64()))})
                out = []
        yield pa.RecordBatch.from_pydict({"members": pa.array(out, pa.list_(pa.int64()))})

    met = rows.select("node", "doc", "sig").repartition("node").sortWithinPartitions("node").mapInArrow(run, "members array<bigint>")
    groups = written(met.distinct(), "clusters").select(F.xxhash64("members").alias("gid"), F.explode("members").alias("doc"))
    return groups.select("gid", F.lit(0).alias("side"), F.col("doc").alias("comp"), "doc")


def links_between(sets: list[np.ndarray], left: list[int], right: list[int], apart: Callable[[int, int], bool], least_pct: int = LEAST_PCT) -> list[tuple[int, int]]:
    """A spanning forest of the links between positions of left and of right, by exact likeness of whole sets."""
    sizes = np.array([len(s) for s in sets], np.float64)
    forest, out = Forest(len(sets)), []
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    width = max(256, 8_000_000 // max(1, len(left) + len(right)))
    n = int(sizes.sum()) // STRIP + 1
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)  # the sets are sorted: ranges of hashes, one at a time
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for strip in range(n):
        parts_ = [s[c[strip] : c[strip + 1]] for s, c in zip(sets, cuts)]
        values, owner = np.concatenate(parts_), np.repeat(np.arange(len(sets)), [len(p) for p in parts_])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        ident = np.cumsum(np.concatenate([[0], (values[1:] != values[:-1]).astype(np.int64)])) if len(values) else values.astype(np.int64)
        shared = np.bincount(ident)[ident] > 1 if len(ident) else np.zeros(0, bool)  # a shingle of one set alone meets nobody
        ident, owner = ident[shared], owner[shared]
        if not len(ident):
            continue
        ident = np.cumsum(np.concatenate([[0], (ident[1:] != ident[:-1]).astype(np.int64)]))
        for k in range(0, int(ident[-1]) + 1, width):  # columns of the membership matrices, some at a time
            lo, hi = np.searchsorted(ident, [k, k + width])
            col, own = ident[lo:hi] - k, owner[lo:hi]
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            in_l, in_r = row_l[own] >= 0, row_r[own] >= 0
            a[row_l[own[in_l]], col[in_l]] = 1
            b[row_r[own[in_r]], col[in_r]] = 1
            both += a @ b.T
    total = sizes[left][:, None] + sizes[right][None, :] - both
    for x, y in np.argwhere(100 * both.astype(np.float64) >= least_pct * total).tolist():
        i, j = left[x], right[y]
        if i != j and apart(i, j) and forest.join(i, j):
            out.append((i, j))
    return out


def _confirmed(groups: DataFrame, docs: DataFrame, least_pct: int) -> DataFrame:
    """Edges (a > b) from groups (gid, side, comp, doc): side 0 is compared with all, side 1 with side 0 only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in _by_group(batches):
            doc, side, comp = (t.column(k).to_pylist() for k in (3, 1, 2))
            hashes = [np.frombuffer(x.as_py(), "<u8") for x in t.column(4)]
            left = [i for i, s in enumerate(side) if s == 0]
            for i, j in links_between(hashes, left, list(range(len(doc))), lambda i, j: comp[i] != comp[j], least_pct):
                a.append(max(doc[i], doc[j]))
                b.append(min(doc[i], doc[j]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = groups.join(_sets(docs, groups.select("doc").distinct()), "doc").select("gid", "side", "comp", "doc", "ids")
    return met.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, least_pct: int = LEAST_PCT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links are of likeness least_pct / 100 (0.8 at least)."""
    if least_pct < 80:
        raise ValueError("the trees are made for a likeness of 0.8 or more")
    drawn = written(sketch(docs), "sketch")
    some = drawn.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), parts(F.col("doc_id")))
    reps = some.select(F.col("doc_id").alias("doc"), "sig", "nodes").join(classes.select("doc"), "doc", "left_semi")
    sigs = reps.select("doc", "sig")

    level = written(_sized(reps.select(F.explode("nodes").alias("node"), "doc")), "nodes")
    large = level.filter(F.col("size") > LEAF)
    block = F.pmod(F.xxhash64("doc", "node"), F.ceil(F.col("size") / LEAF).cast("bigint"))
    leaves = level.select(F.when(F.col("size") > LEAF, F.xxhash64("node", block)).otherwise(F.col("node")).alias("node"), "doc")
    edges = written(_confirmed(_clusters(leaves.join(sigs, "doc")), docs, least_pct), "links")
    found = components(edges)
    if not large.isEmpty():
        more = written(_confirmed(_second_look(large.select("node", "doc"), sigs, found), docs, least_pct), "links-rest")
        if not more.isEmpty():
            found = components(edges.unionByName(more))
    comp = classes.join(found, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")).filter("n > 1 OR comp <> doc").select("set_id", "comp", "_parts")
    out = salted(drawn, comp, "set_id", F.col("doc_id"), "left")
    at = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), at).alias("component_id"), (F.col("doc_id").isNull() | (at == F.col("doc_id"))).alias("kept"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc and ids, the whole shingle set, of the wanted documents and of few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc": b.column(0), "ids": pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), text_col().alias("text"))
    met = wanted_rows(rows, wanted, "doc")
    return met.select("doc", "text").mapInArrow(run, "doc bigint, ids binary")


def _second_look(large: DataFrame, sigs: DataFrame, found: DataFrame) -> DataFrame:
    """Groups for what the blocks of large nodes may have missed: the exact rest where it is small, deeper branches elsewhere."""
    rows = written(large.join(found, "doc", "left").select("node", "doc", F.coalesce("comp", "doc").alias("comp"), F.lit(None).cast("bigint").alias("was"), F.lit(0).alias("slow")), "large")
    now, out = rows, None
    while True:
        nodes = written(_mains(now), "large-nodes")
        again = (F.col("m") - F.col("k") > LEAF) & (F.col("m") > EXACT) & (F.col("slow") < 2)
        rest = _rest(now, nodes.filter(~again))
        out = rest if out is None else out.unionByName(rest)
        branching = nodes.filter(again).select("node", "m", "slow", "_parts")
        if branching.isEmpty():
            return out
        if now is rows:
            now = now.join(sigs, "doc")
        below = written(_children(salted(now.drop("was", "slow"), branching, "node", F.col("doc"))), "below")
        sized = written(_sized(below), "branch")
        out = out.unionByName(_clusters(sized.filter(F.col("size") <= LEAF)))
        now = sized.filter(F.col("size") > LEAF)


def _mains(rows: DataFrame) -> DataFrame:
    """Of every node with more than one component: its members m, its largest component and that one's size k, and for how
    many branchings in a row it has kept more than four fifths."""
    per = rows.groupBy("node", "comp").agg(F.count("*").alias("k"), F.max("was").alias("was"), F.max("slow").alias("slow"), parts(F.col("doc")))
    node = per.groupBy("node").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m"), F.max("was").alias("was"), F.max("slow").alias("slow"), F.bit_or("_parts").alias("_parts")).filter("m > top.k")
    slow = F.when(5 * F.col("m") > 4 * F.col("was"), F.col("slow") + 1).otherwise(0)
    return node.select("node", "m", F.col("top.k").alias("k"), F.col("top.comp").alias("main"), slow.alias("slow"), "_parts")


def _rest(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups of blocks in which the members of nodes outside the largest component meet all members."""
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    node = nodes.select("node", "main", blocks(F.col("m") - F.col("k")).alias("n_out"), blocks(F.col("k")).alias("n_in"), "_parts")
    rows = salted(rows, node, "node", F.col("doc"))
    outer = F.col("comp") != F.col("main")
    at = F.pmod(F.xxhash64("doc"), F.when(outer, F.col("n_out")).otherwise(F.col("n_in")).cast("bigint")).cast("int")
    rows = rows.withColumn("out", outer).withColumn("at", at)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_out = F.transform(upto(F.col("n_out")), lambda j: F.struct(F.least("at", j).alias("x"), F.lit(0).alias("kind"), F.greatest("at", j).alias("y"), F.lit(0).alias("side")))
    with_in = F.transform(upto(F.col("n_in")), lambda j: F.struct(F.col("at").alias("x"), F.lit(1).alias("kind"), j.alias("y"), F.lit(0).alias("side")))
    of_in = F.transform(upto(F.col("n_out")), lambda i: F.struct(i.alias("x"), F.lit(1).alias("kind"), F.col("at").alias("y"), F.lit(1).alias("side")))
    each = F.when(F.col("out"), F.concat(with_out, with_in)).otherwise(of_in)
    met = rows.select("node", "comp", "doc", F.inline(each))
    return met.select(F.xxhash64("node", "x", "kind", "y").alias("gid"), "side", "comp", "doc")


def keep_first(docs: DataFrame, least_pct: int = 80) -> DataFrame:
    """One document of each group: that of the smallest doc_id, once; rows without a doc_id all stay.

    Of rows of one doc_id that differ the one of the smallest hash stays, so reruns agree."""
    kept = near_duplicates(docs, least_pct).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    at = F.col(f"c{cols.index('doc_id')}")
    rows = own.withColumn("_id", at.cast("bigint")).withColumn("_row", row_hash(own)).filter("_id IS NOT NULL")
    first = rows.select("_id", "_row").join(kept, "_id", "left_semi").groupBy("_id").agg(F.min("_row").alias("_row"))
    hit = rows.join(first, ["_id", "_row"], "left_semi").dropDuplicates(["_id", "_row"]).drop("_id", "_row")
    return hit.unionByName(own.filter(at.isNull())).toDF(*cols)
