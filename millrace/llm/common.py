"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import shared_dir

#: White space of the word rule: space and \x09-\x0D.
WORD_SEP = "[\t-\r ]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_col(name: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of characters other than space and \\x09-\\x0D."""
    return F.filter(F.split(text, WORD_SEP, -1), lambda w: w != "")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns worked out here: neither a later filter nor a later projection pulls their expressions
    into its own, where a lambda would work them out again for every element."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row, of columns of any type."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema])


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of the bitmap of wanted rows: 2^25 are 4 MB.
WANTED_BITS = 25


def wanted_rows(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted, and few others, where they lie: a bitmap of fixed size goes to them, so none is shuffled."""
    bit = F.pmod(F.xxhash64(key), F.lit(1 << WANTED_BITS))
    at = wanted.select(bit.alias("at"))
    # At most 2^(WANTED_BITS - 15) rows of 4 KB, whatever the corpus.
    bits = at.groupBy(F.shiftright("at", 15).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("_bits"))
    place = F.col("_at").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    met = rows.withColumn("_at", bit).withColumn("_bucket", F.shiftright("_at", 15)).join(F.broadcast(bits), "_bucket")
    return met.filter(held).drop("_bucket", "_at", "_bits")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply fn to every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
