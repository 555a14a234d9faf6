"""Ordered passes over a key's rows that are cut into slices of time, with what one slice leaves carried into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_S = 3600


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def with_slice(df: DataFrame, at: str, slice_s: int = SLICE_S) -> DataFrame:
    """df with `_slice`, the slice of time that `at` (micros) lies in; rows without a time lie in the last."""
    return df.withColumn("_slice", F.coalesce(F.floor(F.col(at) / (slice_s * 1_000_000)), F.lit(1 << 60)))


def hot_slices(df: DataFrame, keys: list[str], at: str, most: int = 1_000_000) -> DataFrame:
    """df with `_slice` where a key has more than `most` rows: its time is cut into slices that would hold `most` rows each if rows
    came evenly; other keys are one slice.  df as it is where no key has so many, so that their sweep needs no carry."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi")).filter(F.col("_n") > most)
    if hot.isEmpty():
        return df
    width = F.greatest(F.lit(1), F.floor((F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_n") / most)))
    met = df.join(hot.select(*keys, "_lo", width.alias("_width")), keys, "left")
    return met.withColumn("_slice", F.coalesce(F.floor((F.col(at) - F.col("_lo")) / F.col("_width")), F.lit(0))).drop("_lo", "_width")


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """df with `name`: the newest non-null value of the key up to the row, or before it.

    Where df has `_slice`, a key's slices are swept apart; one row for each key and slice says what the slice leaves, and only these rows are
    swept over all slices.  Keys must not be null; rows of equal order have no order among themselves."""
    by = [F.col(c).asc_nulls_last() for c in order]
    rows = df.withColumn("_v", value)
    if "_slice" not in df.columns:
        own = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return rows.withColumn(name, F.last("_v", ignorenulls=True).over(own)).drop("_v")
    newest = F.when(F.col("_v").isNotNull(), F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order]))
    slices = rows.groupBy(*keys, "_slice").agg(F.max_by("_v", newest).alias("_left"))
    older = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_carry", F.last("_left", ignorenulls=True).over(older)).drop("_left")
    own = Window.partitionBy(*keys, "_slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    met = rows.join(carried, [*keys, "_slice"])
    return met.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(own), "_carry")).drop("_v", "_carry")


def stretches(df: DataFrame, keys: list[str], at: str, tie: str, gap_us: int, name: str) -> DataFrame:
    """df (with `_slice`) with `name`: the time (micros) at which the row's stretch began; a silence of more than gap_us in the key
    ends one.  Rows without a time belong to the key's last stretch (null where the key has no other)."""
    seen = fill_forward(df, keys, [at, tie], F.col(at), "_seen", before=True)
    begins = F.when(F.col(at).isNotNull() & (F.col("_seen").isNull() | (F.col(at) - F.col("_seen") > gap_us)), F.col(at))
    return fill_forward(seen, keys, [at, tie], begins, name).drop("_seen")
