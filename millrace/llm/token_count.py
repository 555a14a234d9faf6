"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

Tier one is a table of the corpus's frequent chunks and their numbers of tokens, broadcast once; its size is bounded
by the number of entries (`frequent`) and their length, about 2 MB at the default, whatever the corpus holds.  A chunk
that is not in it goes to tier two: a cache in the Python worker, which outlives its tasks, is filled by the tokenizers
library and forgets its younger half when it passes `cache_size` chunks.  Both only save work: each chunk's number is
the library's own.  The frequent chunks come from a first pass over all texts, in which each task passes on a summary
of bounded size.

Null text counts as empty: no bytes, no tokens.  Rows are counted one by one, so repeated rows, ties and empty
tables need no care.  A text of any length is counted whole, by windows of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import text_col
from millrace.llm.pretoken import ChunkIds, cut, frequent_chunks, library, slices, windows, worker_ids


class Lengths:
    """A table from chunks to numbers of tokens, compact to send: one text and one array; each worker hashes it once."""

    def __init__(self, words: list[str], lengths: list[int]) -> None:
        self.words = "\n".join(words)
        self.lengths = np.asarray(lengths, np.uint8 if max(lengths, default=0) < 256 else np.uint32)

    @property
    def n_bytes(self) -> int:
        return len(self.words.encode()) + self.lengths.nbytes

    @cached_property
    def opened(self) -> dict[str, int]:
        return {"": 0} | (dict(zip(self.words.split("\n"), self.lengths.tolist(), strict=True)) if self.words else {})


def frequent_lengths(docs: DataFrame, path: str, frequent: int = 65_536) -> Lengths:
    """Tier one for a corpus: its frequent chunks with their numbers of tokens."""
    words = [c for c, _ in frequent_chunks(docs, frequent)]
    encoded = library(path).encode_batch_fast(words, add_special_tokens=False)
    return Lengths(words, [len(e.ids) for e in encoded])


def lengths_of(names: list[str], common: dict[str, int], cache: ChunkIds) -> np.ndarray:
    """The number of tokens of each name: from tier one, or from the worker's cache."""
    n = np.fromiter(map(common.get, names, repeat(-1)), np.int64, len(names))
    if len(missing := np.flatnonzero(n < 0)):
        at = cache.places(list(map(names.__getitem__, missing.tolist())))
        n[missing] = cache.count[at]
    return n


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, frequent: int = 65_536, cache_size: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    spark: SparkSession = docs.sparkSession
    tier_one = spark.sparkContext.broadcast(frequent_lengths(docs, path, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, cache = tier_one.value.opened, worker_ids(path, cache_size)
        for b in batches:
            totals = [np.zeros(0, np.int64)]
            for part in slices(b.column(1)):
                flat, offsets = cut(part)
                n = [np.zeros(1, np.int64), *(lengths_of(names, common, cache)[number] for names, number in windows(flat))]
                totals.append(np.diff(np.cumsum(np.concatenate(n))[offsets]))
            n_tokens = np.concatenate(totals)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pc.binary_length(b.column(1)).cast(pa.int64()), "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit)})

    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
