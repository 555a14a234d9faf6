"""A table in buckets of time of which a change reads and replaces only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diff
from millrace.sources.shared import shared_dir


class Buckets:
    """Rows by bucket of time: rows/version=n/bucket=b, and a manifest for each version that says which version each bucket has.

    A version's rows are written before its manifest, so a reader sees a version whole or not at all, and a version that
    is written again (after a lost attempt) stands in its own place.  The manifest has one row for each bucket; the driver
    holds the touched buckets' names alone."""

    def __init__(self, spark: SparkSession, schema: str, at: str, bucket_s: int = 3600, root: str = "") -> None:
        self.spark, self.schema, self.at, self.bucket_s = spark, schema, at, bucket_s
        self.root = root or shared_dir(spark, "buckets")

    def bucket(self) -> Column:
        """Rows without a time have a bucket of their own."""
        return F.coalesce(F.floor(F.unix_timestamp(self.at) / self.bucket_s), F.lit(-1)).cast("bigint")

    def _manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema("bucket bigint, version bigint").parquet(f"{self.root}/manifest/{version}")

    def write(self, df: DataFrame, version: int, before: int | None = None) -> None:
        """df's buckets as they are from this version on; all others as in the version before."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows = df.select(*names).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/version={version}")
        now = rows.select("bucket").distinct().withColumn("version", F.lit(version).cast("bigint"))
        if before is not None:
            now = now.unionByName(self._manifest(before).join(now.select("bucket"), "bucket", "left_anti"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version}")

    def read(self, version: int, touched: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: only their folders are opened."""
        m = self._manifest(version)
        some = m if touched is None else m.filter(F.col("bucket").isin(touched))
        paths = [f"{self.root}/rows/version={r.version}/bucket={r.bucket}" for r in some.toLocalIterator()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, keys: list[str], digest: str, version: int, before: int) -> DataFrame:
        """A batch of late rows against the buckets that it touches: keys, digest and action (insert or update) of what changes.  Changed
        buckets are replaced; an unchanged row is not written, and a batch that changes nothing writes no rows.  A row whose
        time moves to another bucket is a new row there."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        late = batch.select(*names).withColumn("_h", F.xxhash64(*names)).withColumn("_lb", self.bucket())
        late = diff.newest(late, [*keys, "_lb"], [F.desc("_h")]).drop("_h")
        touched = [r.b for r in late.select(F.col("_lb").alias("b")).distinct().collect()]
        stored = self.read(before, touched)
        there = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(digest).alias("_was"), self.bucket().alias("_sb"))
        on = F.col("_lb") == F.col("_sb")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        met = late.join(there, on, "left")
        action = F.when(F.col("_sb").isNull(), "insert").when(~F.col("_was").eqNullSafe(F.col(digest)), "update")
        path = f"{self.root}/changes/{version}"
        met.withColumn("action", action).filter("action IS NOT NULL").select(*names, "action").write.mode("overwrite").parquet(path)
        changes = self.spark.read.schema(f"{self.schema}, action string").parquet(path)
        changed = [r.b for r in changes.select(self.bucket().alias("b")).distinct().collect()]
        old = self.read(before, changed)
        gone = changes.select(*[F.col(k).alias(f"_{k}") for k in keys], self.bucket().alias("_sb"))
        on = self.bucket() == F.col("_sb")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        self.write(old.join(gone, on, "left_anti").unionByName(changes.drop("action")), version, before)
        return changes
