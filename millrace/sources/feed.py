"""An incremental reader of a table that is written to: where it stopped, and what is safe to read next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.sweep import micros
from millrace.sources.shared import shared_dir


@dataclass
class Feed:
    """Reads rows by the time at which they were written, each version of a row once, at most `cap` a step.

    A step looks at write times from the cursor less `overlap_s` on (inclusive) up to the present less `lag_s`: what was committed late,
    behind the cursor, is still found as long as it is not older than the overlap, and rows of one write time that a cap
    parts are found again.  What was told is kept by (key, write time) and left out, so nothing is told twice; a row that
    is written anew is told anew.  The cursor moves to the last told write time where the cap was met, else to the
    present less the lag.  Reads are pushed down to the table and to what was told by write time.

    A step writes what it tells, then the cursor: one that is lost between the two is done again in its place.  Rows
    without a write time are never safe to read; rows without a key are told by their write time alone, once.
    """

    spark: SparkSession
    schema: str
    at: str
    key: str
    lag_s: int
    overlap_s: int
    cap: int
    root: str = ""

    def __post_init__(self) -> None:
        self.root = self.root or shared_dir(self.spark, "feed")
        self._put(self.spark.createDataFrame([], self.schema), "told", -1)
        self._put(self.spark.createDataFrame([(-1, None)], "n int, cursor bigint"), "cursor", -1)

    def _put(self, df: DataFrame, what: str, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{what}/step={step}")

    def position(self) -> tuple[int, int | None]:
        """The last finished step and the cursor (micros; null: nothing was read yet)."""
        row = self.spark.read.schema("n int, cursor bigint, step int").parquet(f"{self.root}/cursor").orderBy(F.desc("n")).first()
        return row.n, row.cursor

    def told(self, upto: int = 1 << 30) -> DataFrame:
        """What was told up to a step, with `step`."""
        return self.spark.read.schema(f"{self.schema}, step int").parquet(f"{self.root}/told").filter(F.col("step").between(0, upto))

    def step(self, table: DataFrame, now: Column) -> DataFrame:
        """The next rows of the table (read again by the caller, so that it has what was written meanwhile); now is an instant."""
        done, cursor = self.position()
        instant = lambda us: F.timestamp_micros(F.lit(us))
        hi = self.spark.range(1).select((micros(now) - self.lag_s * 1_000_000).alias("hi")).first().hi
        rows, seen = table.filter(F.col(self.at) < instant(hi)), self.told(done)
        if cursor is not None:
            lo = cursor - self.overlap_s * 1_000_000
            rows, seen = rows.filter(F.col(self.at) >= instant(lo)), seen.filter(F.col(self.at) >= instant(lo))
        same = rows[self.key].eqNullSafe(seen[self.key]) & (rows[self.at] == seen[self.at])
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        # The cap is the reader's own: at most so many rows are sorted together.
        new = rows.join(seen, same, "left_anti").select(*names).dropDuplicates([self.key, self.at]).orderBy(self.at, F.col(self.key).asc_nulls_first()).limit(self.cap)
        self._put(new, "told", done + 1)
        out = self.spark.read.schema(self.schema).parquet(f"{self.root}/told/step={done + 1}")
        got = out.agg(F.count("*").alias("n"), F.max(micros(F.col(self.at))).alias("last")).first()
        after = got.last if got.n >= self.cap else max(hi, cursor if cursor is not None else hi)
        self._put(self.spark.createDataFrame([(done + 1, after)], "n int, cursor bigint"), "cursor", done + 1)
        return out
