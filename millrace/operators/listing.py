"""Lists of entries and transactions with their filters, ordered members, and merged reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.fields import local_day, outcome


def query_rows(df: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None, at: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows by equality, by case-blind text and by a range of time; filters that are None do not apply."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    for c, v in (like or {}).items():
        if v is not None:
            df = df.filter(F.contains(F.lower(c), F.lit(v.lower())))
    if since is not None:
        df = df.filter(F.col(at) >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.filter(F.col(at) < F.lit(until).cast("timestamp"))
    return df


def query_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, **filters: object) -> DataFrame:
    """A page of query_rows with the number of all rows that match (one row beside the page, from an aggregate of its own)."""
    hits = query_rows(df, **filters)
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def with_owner(entries: DataFrame, assigned: DataFrame, entry: str, owner: str) -> DataFrame:
    """entries with the transaction that owns them, or null."""
    return entries.join(assigned.select(entry, owner), entry, "left")


def namespaced(bag: Column, prefix: str) -> Column:
    """The fields of a bag under a prefix; empty values are left out."""
    some = F.map_filter(bag, lambda _, v: F.nullif(F.trim(v), F.lit("")).isNotNull())
    return F.transform_keys(some, lambda k, _: F.concat(F.lit(f"{prefix}."), k))


def normalise(rows: DataFrame, reasons: dict[str, Column], key: str) -> tuple[DataFrame, DataFrame]:
    """(facts: rows without a fault; quarantine: key and the first reason of every other row).  Nothing stops the rest."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(reasons.items()):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    both = rows.withColumn("_reason", reason)
    return both.filter("_reason IS NULL").drop("_reason"), both.filter("_reason IS NOT NULL").select(key, F.col("_reason").alias("reason"))


def cap_length(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """df with each named text cut to its width, and n_cut: how many of the row's texts were longer."""
    cut = sum((F.coalesce((F.length(c) > n).cast("int"), F.lit(0)) for c, n in limits.items()), F.lit(0))
    return df.withColumn("n_cut", cut).withColumns({c: F.substring(c, 1, n) for c, n in limits.items()})


def find(values: DataFrame, number: str, name: str, text: str, limit: int) -> DataFrame:
    """Entities whose number starts with a text or whose name holds it, by number."""
    low = text.lower()
    hit = F.startswith(F.lower(F.col(number).cast("string")), F.lit(low)) | F.coalesce(F.contains(F.lower(name), F.lit(low)), F.lit(False))
    return values.filter(hit).orderBy(number).limit(limit)


def day_scope(df: DataFrame, at: str, day: str, tz: str, pad_h: int = 26) -> DataFrame:
    """Rows of a local day: a padded range of instants, which prunes partitions and reaches the scan, and the exact local date."""
    d = F.lit(day).cast("date")
    lo = d.cast("timestamp") - F.make_dt_interval(hours=F.lit(pad_h))
    hi = F.date_add(d, 1).cast("timestamp") + F.make_dt_interval(hours=F.lit(pad_h))
    return df.filter((F.col(at) >= lo) & (F.col(at) < hi) & (local_day(F.col(at), tz) == d))


def release_stats(settled: DataFrame, by: list[Column], expected: str = "expected", picked: str = "picked") -> DataFrame:
    """Outcomes of releases by picker, delivery, customer or any other group: rows of each outcome, units short, fill rate."""
    e, p = F.col(expected), F.col(picked)
    kind = outcome(e, p)
    short = F.greatest(e - p, F.lit(0)).cast("double")
    g = settled.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(kind == k).alias(n) for k, n in (("exact", "exact"), ("over", "over"), ("zeroPick", "zero_picks"), ("partial", "partial"))],
        F.sum(short).alias("units_short"), F.sum(e.cast("double")).alias("_e"),
    )
    return g.withColumn("fill_rate", F.when(F.col("_e") > 0, F.round(1 - F.col("units_short") / F.col("_e"), 6))).drop("_e")


def zero_feed(settled: DataFrame, order: list[Column], limit: int, expected: str = "expected", picked: str = "picked") -> DataFrame:
    """The newest releases of which nothing was picked (a feed: the limit is its length)."""
    return settled.filter(outcome(F.col(expected), F.col(picked)) == "zeroPick").orderBy(*order).limit(limit)


def usage(turns: DataFrame, person: str, day: Column) -> DataFrame:
    """Questions and people who ask, by day."""
    return turns.groupBy(day.alias("day")).agg(F.count("*").alias("questions"), F.count_distinct(person).alias("people"))


def top_askers(turns: DataFrame, person: str, limit: int) -> DataFrame:
    """Who asks most."""
    return turns.groupBy(person).agg(F.count("*").alias("questions")).orderBy(F.desc("questions"), person).limit(limit)


def entry_seq(entries: DataFrame, owner: str, at: Column, line: str) -> DataFrame:
    """entries with seq: their order inside their owner, rows without a time last."""
    w = Window.partitionBy(owner).orderBy(at.asc_nulls_last(), line)
    return entries.withColumn("seq", F.row_number().over(w))


def with_entries(txns: DataFrame, assigned: DataFrame, entries: DataFrame, txn: str, entry: str, show: str) -> DataFrame:
    """txns with the ordered values of their entries (a transaction's entries are few)."""
    own = assigned.join(entries.select(entry, show), entry).groupBy(txn).agg(F.array_sort(F.collect_list(F.struct("seq", show))).alias("_e"))
    return txns.join(own, txn, "left").withColumn("entries", F.coalesce(F.transform("_e", lambda x: x[show]), F.array().cast("array<string>"))).drop("_e")


def merge_hours(df: DataFrame, at: str, parts: dict[str, Column]) -> DataFrame:
    """One row per hour with each part's count: one aggregate in place of a join of several reads."""
    return df.groupBy(F.date_format(at, "yyyy-MM-dd HH").alias("hour")).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in parts.items()])


def response_groups(entries: DataFrame, owner: str, kind: str, ok: Column, order: Column, value: str) -> DataFrame:
    """Calls of an owner by kind: calls, errors, the last value."""
    return entries.groupBy(owner, kind).agg(F.count("*").alias("calls"), F.count(F.when(~ok, 1)).alias("errors"), F.max_by(value, order).alias("last_value"))


def forecast_vs_actual(predictions: DataFrame, daily: DataFrame) -> DataFrame:
    """Actual beside p10, p50, p90 per subject and day, with the error of days that are over."""
    j = predictions.join(daily, ["subject", "day"], "full")
    return j.select("subject", "day", "p10", "p50", "p90", F.col("y").alias("actual"), (F.col("y") - F.col("p50")).alias("error"), F.coalesce(F.col("y").between(F.col("p10"), F.col("p90")).cast("int"), F.lit(0)).alias("inside"))


def backfill_days(rows: DataFrame, profiles: DataFrame, by: str, day: str) -> DataFrame:
    """Each past row with the newest profile known on its day; profiles are few a key, so the join grows with the rows."""
    p = profiles.select(F.col(by).alias("_k"), F.col("day").alias("_d"), F.col("value").alias("_v"))
    ends = p.withColumn("_to", F.lead("_d").over(Window.partitionBy("_k").orderBy("_d")))
    on = (F.col(by) == F.col("_k")) & (F.col(day) >= F.col("_d")) & (F.col("_to").isNull() | (F.col(day) < F.col("_to")))
    return rows.join(ends, on, "left").drop("_k", "_d", "_to").withColumnRenamed("_v", "known")


def empty_places(facts: DataFrame, place: str, item: str, order: Column, is_empty: Column, least: int = 3, high: int = 6) -> DataFrame:
    """Places at which at least `least` different items came up empty, with a severity."""
    g = facts.filter(is_empty).groupBy(place).agg(F.count_distinct(item).alias("items"), F.max_by(item, order).alias("last_item"))
    return g.filter(F.col("items") >= least).withColumn("severity", F.when(F.col("items") >= high, "high").otherwise("medium"))


def count_gaps(counts: DataFrame, keys: list[str], order: Column, counted: str, balance: str, units: float = 2, share: float = 0.1) -> DataFrame:
    """The latest count of each item and place that is off by both thresholds."""
    top = counts.groupBy(*keys).agg(F.max_by(F.struct(counted, balance), order).alias("r"))
    gap = F.col(f"r.{counted}") - F.col(f"r.{balance}")
    part = F.when(F.col(f"r.{balance}") != 0, F.abs(gap) / F.abs(f"r.{balance}")).otherwise(1.0)
    return top.select(*keys, gap.cast("double").alias("gap"), part.alias("_p")).filter((F.abs("gap") >= units) & (F.col("_p") >= share)).drop("_p")
