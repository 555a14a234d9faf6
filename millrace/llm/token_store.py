"""Token ids in binary shards whose document boundaries are an Elias-Fano sequence with select.

A shard holds the ids of consecutive documents (ascending doc_id) as one array, and says where each document ends by
an Elias-Fano code of the n + 1 boundaries: low bits packed, high parts as unary gaps in a bit vector with sampled
positions of ones, so `select(i)` is one sample and a short scan.  It takes about 2 + log2(ids / documents) bits a
document instead of 64.  The doc_ids, which ascend too, are a second such sequence of their distances to the least;
the reader takes both by select, and no table of 64-bit offsets is ever made.

Layout, little-endian, every part padded to 8 bytes:

    magic "EFTOKEN2" | n_docs u64 | n_null u64 | least i64 | n_ids u64 | id_width u64
    | low_bits u64, n_high_words u64 of the boundaries | low_bits u64, n_high_words u64 of the doc_ids
    then of the boundaries and of the doc_ids: low words u64[] | high words u64[] | samples u64[]
    ids u16[] or u32[]

The doc_ids stand beside the boundaries so that a shard can be read alone; documents without one come first and are
only counted.  Ids take 16 bits where the vocabulary allows it.  Documents are dealt into shards by ranges of doc_id;
each task writes `shard-<part>-<n>.tmp` in the shared folder, rolls to the next file at `roll_ids` ids, and renames
when a file is whole, so a task that runs again writes the same bytes over the same name.  The reader opens the shards
with Spark's binaryFile source.

Null text counts as empty: such a document has the end id alone.  Documents with equal doc_id (or a null one, which
sorts first) all keep their own entries, ordered by text; an empty table writes no shard and reads back no row.  A very
long text is cut into windows of chunks, so only its ids are held whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, text_col
from millrace.llm.pretoken import library, worker_ids

MAGIC = b"EFTOKEN2"
SAMPLE = 64


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers below 2^63 in near-minimal space."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @staticmethod
    def encode(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n and top >= n else 0
        low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
        if width:
            part, at = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((int(ones[-1]) >> 6) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, (ones >> np.uint64(6)).astype(np.int64), np.uint64(1) << (ones & np.uint64(63)))
        return EliasFano(n, width, low, high, ones[::SAMPLE].copy())

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        got = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        got[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return got & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the sample at or before i, over the ones of the high words."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        one = (word << 6) + (bits & -bits).bit_length() - 1
        if not self.low_bits:
            return one - i
        word, shift = i * self.low_bits >> 6, i * self.low_bits & 63
        low = int(self.low[word]) >> shift
        if shift + self.low_bits > 64:
            low |= int(self.low[word + 1]) << (64 - shift)
        return ((one - i) << self.low_bits) | (low & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n].astype(np.uint64)
        i = np.arange(self.n, dtype=np.uint64)
        return ((ones - i) << np.uint64(self.low_bits)) | self._low(i)

    @property
    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def packed(doc_ids: list[int | None], counts: np.ndarray, ids: list[np.ndarray], width: int) -> Iterator[bytes]:
    """The parts of a shard, from ascending doc_ids (those without one first), each document's number of ids, and all ids
    in a row, in pieces."""
    if width == 2 and (most := max((int(x.max()) for x in ids if len(x)), default=0)) > 0xFFFF:
        raise ValueError(f"id {most} does not fit 16 bits")
    known = [d for d in doc_ids if d is not None]
    least, n_ids = known[0] if known else 0, sum(map(len, ids))
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(counts, dtype=np.uint64)]).astype(np.uint64))
    docs = EliasFano.encode(np.array([d - least for d in known], np.uint64))
    head = np.array([len(doc_ids), len(doc_ids) - len(known), least & 0xFFFFFFFFFFFFFFFF, n_ids, width, bounds.low_bits, len(bounds.high), docs.low_bits, len(docs.high)], "<u8")
    yield MAGIC + head.tobytes()
    for x in (x for ef in (bounds, docs) for x in (ef.low, ef.high, ef.samples)):
        yield x.astype("<u8").tobytes()
    for x in ids:
        yield x.astype("<u2" if width == 2 else "<u4", copy=False).tobytes()
    yield b"\0" * (-n_ids * width % 8)


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A shard in one piece."""
    return b"".join(packed(doc_ids, counts, [ids], width))


class Shard:
    """A shard's parts as views of its bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.n_null, least, n_ids, width, *sizes = (int(x) for x in np.frombuffer(data, "<u8", 9, 8))
        self.least, at = least - (1 << 64) if least >> 63 else least, 80

        def view(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += (got.nbytes + 7) // 8 * 8
            return got

        def sequence(n: int, low_bits: int, n_high: int) -> EliasFano:
            return EliasFano(n, low_bits, view("<u8", (n * low_bits + 63) // 64 + 1), view("<u8", n_high), view("<u8", (n + SAMPLE - 1) // SAMPLE))

        self.bounds = sequence(self.n_docs + 1, *sizes[:2])
        self.docs = sequence(self.n_docs - self.n_null, *sizes[2:])
        self.ids = view("<u2" if width == 2 else "<u4", n_ids)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.docs.select(i - self.n_null)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _store(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url)


def id_width(path: str, end_id: int) -> int:
    """Bytes that every id of the tokenizer and the end id fit."""
    most = max(library(path).get_vocab(with_added_tokens=True).values(), default=0)
    return 2 if max(most, end_id) <= 0xFFFF else 4


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 1, roll_ids: int = 8_000_000, width: int | None = None) -> DataFrame:
    """Write the shards below out; one row per shard: file, first (order of its part and file), n_docs, n_ids."""
    width = width or id_width(path, end_id)
    kind = np.dtype("<u2" if width == 2 and end_id <= 0xFFFF else "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, store, n_file = worker_ids(path), None, 0
        docs_, counts, ids_, size = [], [], [], 0
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        done: list[dict] = []

        def close() -> None:
            nonlocal store, n_file, docs_, counts, ids_, size
            if store is None:
                store, root = _store(out)
                store.create_dir(root, recursive=True)
            root = _store(out)[1]
            name = f"shard-{part:06d}-{n_file:06d}"
            with store.open_output_stream(f"{root}/{name}.{attempt}.tmp") as f:
                for x in packed(docs_, np.concatenate(counts), ids_, width):
                    f.write(x)
            if store.get_file_info(f"{root}/{name}.eft").type == fs.FileType.NotFound:
                store.move(f"{root}/{name}.{attempt}.tmp", f"{root}/{name}.eft")
            else:  # an earlier attempt of this task left the same bytes
                store.delete_file(f"{root}/{name}.{attempt}.tmp")
            done.append({"file": f"{name}.eft", "n_docs": len(docs_), "n_ids": size})
            n_file, docs_, counts, ids_, size = n_file + 1, [], [], [], 0

        for b in batches:
            left = b.column(0).to_pylist()
            for ids, starts in enc.encode_all(b.column(1)):
                ids = np.insert(ids.astype(kind), starts[1:], end_id)
                ends = starts[1:] + np.arange(1, len(starts))
                at, done_ids = 0, 0
                while at < len(ends):  # up to the document that fills a file
                    full = int(np.searchsorted(ends, done_ids + roll_ids - size)) + 1
                    upto = min(full, len(ends))
                    docs_ += left[at:upto]
                    counts.append(np.diff(ends[at:upto], prepend=done_ids))
                    ids_.append(ids[done_ids : ends[upto - 1]])
                    size += int(ends[upto - 1]) - done_ids
                    at, done_ids = upto, int(ends[upto - 1])
                    if size >= roll_ids:
                        close()
                left = left[len(ends) :]
        if docs_:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_col().alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ranged.mapInArrow(write, "file string, n_docs bigint, n_ids bigint")


def unpacked(file: str, data: bytes, at_once: int = 50_000) -> Iterator[pa.RecordBatch]:
    """file, doc_id, at, n_tokens and ids_crc32 of every document of a shard, by select."""
    s = Shard(data)
    for first in range(0, s.n_docs, at_once):
        upto = min(first + at_once, s.n_docs)
        at = [s.bounds.select(i) for i in range(first, upto + 1)]
        yield pa.RecordBatch.from_pydict(
            {
                "file": pa.array([file] * (upto - first)),
                "doc_id": pa.array([s.doc_id(i) for i in range(first, upto)], pa.int64()),
                "at": pa.array(at[:-1], pa.int64()),
                "n_tokens": pa.array(np.diff(at), pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(s.ids[x:y].astype("<u4")) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64()),
            }
        )


def read_shards(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards that the manifest names.

    The manifest has one short row per shard; its running sum gives each shard's first offset, and is all that meets
    in one task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from unpacked(file, data.as_buffer())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").load(out)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = named.mapInArrow(read, "file string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    return rows.join(starts, "file").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame, path: str, end_id: int = 1, roll_ids: int = 8_000_000) -> DataFrame:
    """Write the documents' ids below a new shared folder and read every document back from the files."""
    spark = docs.sparkSession
    root = shared_dir(spark, "tokens")
    # The manifest table is the commit record: the reader takes only the shards that it names.
    write_shards(docs, path, f"{root}/shards", end_id, roll_ids).write.parquet(f"{root}/manifest")
    manifest = spark.read.schema("file string, n_docs bigint, n_ids bigint").parquet(f"{root}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_shards(spark, f"{root}/shards", manifest)
