"""Folders that driver and executors share, and time-partitioned tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset on one machine, below a temporary folder that is set as
    it.  A cluster must name one: its executors cannot read the driver's folders."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, at: str, grain: str, path: str) -> None:
    """df below path, a folder per day, week or month; only the partitions in df are overwritten."""
    part = F.date_format(F.date_trunc(grain, at), "yyyy-MM-dd")
    df.withColumn("part", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def expired_partitions(parts: DataFrame, holds: DataFrame, now: Column, days: int) -> DataFrame:
    """Partitions (part, part_end) older than days that no hold (lo, hi) still needs; the caller drops their folders."""
    old = parts.filter(F.col("part_end").cast("timestamp") <= now - F.make_dt_interval(F.lit(days)))
    overlap = (F.col("lo") < F.col("part_end").cast("timestamp")) & (F.col("hi") >= F.col("part").cast("timestamp"))
    return old.join(holds.select("lo", "hi"), overlap, "left_anti")


def min_live_position(cursors: DataFrame, now: Column, stale_s: int) -> DataFrame:
    """The least position of the consumers that were seen lately; stale ones hold nothing."""
    return cursors.filter(F.unix_timestamp(now) - F.unix_timestamp("updated_at") <= stale_s).agg(F.min("position").alias("position"), F.count("*").alias("live"))


def purge(df: DataFrame, condition: Column) -> DataFrame:
    """df without the rows that a condition names; rows for which it is unknown stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))
