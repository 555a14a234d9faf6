"""Lookups: values harvested from observations, with the periods in which they held, and joins as of an instant."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.operators.fold import merged
from millrace.operators.sweep import fill_forward, hot_slices, micros

EPOCH = "1970-01-01 00:00:00"


def build_validity(seen: DataFrame, key: str, value: str, at: str, rule: str = "latest_wins") -> DataFrame:
    """key, value, valid_from, valid_to, conflicts from observations.

    latest_wins opens a period at each change (the first from 1970 on, the last without an end); first_wins keeps the
    first value for good; all_values lists every value.  Of observations of one instant the least value stands, and the others
    count as conflicts.  Null keys and values are no observations.  Periods begin and end at instants (microseconds).
    """
    epoch, no_end = F.lit(EPOCH).cast("timestamp"), F.lit(None).cast("timestamp")
    some = seen.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.col(at).alias("at"))
    if rule == "all_values":
        return some.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("value")).select(
            "key", "value", epoch.alias("valid_from"), no_end.alias("valid_to"), F.lit(0).cast("bigint").alias("conflicts"))
    once = some.groupBy("key", "at").agg(F.min("value").alias("value"), (F.count_distinct("value") - 1).alias("extra"))
    if rule == "first_wins":
        got = once.groupBy("key").agg(F.min_by("value", "at").alias("value"), F.sum("extra").alias("conflicts"))
        return got.select("key", "value", epoch.alias("valid_from"), no_end.alias("valid_to"), "conflicts")
    w = Window.partitionBy("key").orderBy("at")
    runs = once.withColumn("change", (F.lag("value").over(w).isNull() | (F.lag("value").over(w) != F.col("value"))).cast("int"))
    runs = runs.withColumn("run", F.sum("change").over(w))
    periods = runs.groupBy("key", "run").agg(F.min("value").alias("value"), F.min("at").alias("from"), F.sum("extra").alias("conflicts"))
    p = Window.partitionBy("key").orderBy("run")
    start = F.when(F.col("run") == 1, epoch).otherwise(F.col("from").cast("timestamp"))
    return periods.select("key", "value", start.alias("valid_from"), F.lead("from").over(p).cast("timestamp").alias("valid_to"), "conflicts")


_NEVER = 1 << 62


def _disjoint(periods: Iterator[tuple]) -> Iterator[tuple]:
    """(key, value, lo, hi) in the order of key, lo and value as disjoint periods, of which the one that starts last stands."""
    now, at = None, 0
    held: list[tuple[int, str]] = []  # open periods (end, value); a later one ends before those under it

    def upto(end: int) -> Iterator[tuple]:
        nonlocal at
        while held and at < end:
            stop, value = held[-1]
            if (cut := min(stop, end)) > at:
                yield now, value, at, cut
                at = cut
            if stop <= end:
                held.pop()

    for key, value, lo, hi in periods:
        if key != now:
            yield from upto(_NEVER)
            now = key
            held.clear()
        yield from upto(lo)
        at = lo
        if hi > lo:
            while held and held[-1][0] <= hi:
                held.pop()
            held.append((hi, value))
    yield from upto(_NEVER)


def pieces(periods: DataFrame) -> DataFrame:
    """Periods (key, value, valid_from, valid_to) of which those of one key may overlap, as disjoint ones: at every instant the period
    that started last stands, and of those of one start the greater value.

    One pass over each key's periods in the order of their start; held are only open periods that no later one outlasts.  A
    period that ends before it starts is none."""
    never = F.coalesce(micros(F.col("valid_to")), F.lit(_NEVER))
    rows = periods.select("key", F.col("value").cast("string").alias("value"), micros(F.col("valid_from")).alias("lo"), never.alias("hi")).filter("key IS NOT NULL AND lo IS NOT NULL")
    types = [to_arrow_type(f.dataType) for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _disjoint(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        while some := list(islice(got, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=["key", "value", "lo", "hi"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "lo", F.col("value").asc_nulls_first(), "hi")
    got = dealt.mapInArrow(run, rows.schema)
    return got.select("key", "value", F.timestamp_micros("lo").alias("valid_from"), F.when(F.col("hi") < _NEVER, F.timestamp_micros("hi")).alias("valid_to"))


def as_of(df: DataFrame, periods: DataFrame, key: str, at: Column, name: str) -> DataFrame:
    """df with the value that held for its key at its instant: the newest period that covers it, null where none does.

    Periods of one key may overlap: the one that starts last wins, and of those of one start the greater value.  Instants are
    compared in microseconds; a period holds from valid_from on and ends before valid_to (null: never).  valid_from and
    valid_to may be instants or text."""
    return as_of_disjoint(df, pieces(periods), key, at, name)


def as_of_disjoint(df: DataFrame, periods: DataFrame, key: str, at: Column, name: str, most: int = 1_000_000) -> DataFrame:
    """The same where periods of a key are known not to overlap.

    Periods and rows are swept together in the order of key and microsecond: a row takes the newest period that began, if
    that has not ended.  A key of more than `most` rows is swept in slices of time (`sweep.hot_slices`), so a key of half of
    all rows is dealt out.  Rows without a key or an instant have no value."""
    cols = df.columns
    own = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("_row"), F.col(key).alias("_k"), micros(at).alias("_t"), F.lit(1).alias("_kind"))
    kind, kinds = dict(own.dtypes)["_k"], dict(periods.dtypes)["key"]
    as_key = (lambda c: c) if kind == kinds else (lambda c: c.cast("string"))
    own = own.withColumn("_k", as_key(F.col("_k")))
    period = F.struct(micros(F.col("valid_to")).alias("hi"), F.col("value").alias("value"))
    v = periods.select(as_key(F.col("key")).alias("_k"), micros(F.col("valid_from")).alias("_t"), F.lit(0).alias("_kind"), period.alias("_period")).filter("_k IS NOT NULL AND _t IS NOT NULL")
    known = own.filter("_k IS NOT NULL AND _t IS NOT NULL")
    both = hot_slices(known.withColumn("_period", F.lit(None).cast(v.schema["_period"].dataType)).unionByName(v, allowMissingColumns=True), ["_k"], "_t", most)
    swept = fill_forward(both, ["_k"], ["_t", "_kind"], F.col("_period"), "_held").filter("_kind = 1")
    value = F.when(F.col("_held.hi").isNull() | (F.col("_t") < F.col("_held.hi")), F.col("_held.value"))
    found = swept.select("_row", value.alias("_value")).unionByName(own.filter("_k IS NULL OR _t IS NULL").select("_row", F.lit(None).cast(v.schema["_period"].dataType["value"].dataType).alias("_value")))
    return found.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(cols)], F.col("_value").alias(name))


def group_by_lookup(cells: DataFrame, lookup: DataFrame, dim: str, key: str, attribute: str) -> DataFrame:
    """Cells by a looked-up value: aggregated by key first, translated, then merged on roles (unknown keys stand as null)."""
    first = merged(cells, ["bucket", dim])
    names = lookup.select(F.col(key).cast("string").alias(dim), F.col(attribute).alias("group"))
    return merged(first.join(names, dim, "left"), ["bucket", "group"])


def nearby(keys: DataFrame, events: DataFrame, match: list[str], window_s: int, how: str = "count", of: str | None = None, strict: str | None = None) -> DataFrame:
    """For each key row (key_id, first_at, last_at, match fields): events with equal fields in [first - window, last].

    Both sides meet in buckets of the window's length, so the range join hashes; how is count, distinct, last or has.
    """
    sec = lambda c: F.unix_micros(c.cast("timestamp"))
    w = window_s * 1_000_000
    k = keys.select("key_id", *match, sec(F.col("first_at")).alias("_lo"), sec(F.col("last_at")).alias("_hi"))
    k = k.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_lo") - w) / w), F.floor(F.col("_hi") / w))))
    e = events.withColumn("_at", sec(F.col("at"))).withColumn("_b", F.floor(F.col("_at") / w))
    hit = k.join(e, [*match, "_b"]).filter(F.col("_at").between(F.col("_lo") - w, F.col("_hi")))
    if strict:
        hit = hit.filter(strict)
    agg = {"count": F.count("*"), "has": F.lit(1), "distinct": F.count_distinct(of or "at"), "last": F.max_by(of or "at", F.struct("_at", of or "at"))}[how]
    got = hit.groupBy("key_id").agg(agg.alias("nearby"))
    out = keys.join(got, "key_id", "left")
    return out if how == "last" else out.withColumn("nearby", F.coalesce("nearby", F.lit(0)))


def suggest_sources(facts: DataFrame, bag: str, known: DataFrame, share: float = 0.9) -> DataFrame:
    """Fields of which at least share of the values are known keys."""
    kv = facts.select(F.explode(bag).alias("field", "value")).filter("value IS NOT NULL")
    per = kv.groupBy("field", "value").agg(F.count("*").alias("n"))
    hit = per.join(known.select(F.col(known.columns[0]).cast("string").alias("value"), F.lit(1).alias("hit")).distinct(), "value", "left")
    out = hit.groupBy("field").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("known"))
    return out.withColumn("suggested", (F.col("known") >= F.col("n") * share).cast("int"))
