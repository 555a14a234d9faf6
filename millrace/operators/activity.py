"""Activity and release statistics: who did what when, shapes of days, periods compared, registries of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.fields import local_day, local_time


def field_profile(facts: DataFrame, bag: str) -> DataFrame:
    """Per (method, field) and per field alone: rows and distinct values, by grouping sets over one scan."""
    kv = facts.select("method", F.explode(bag).alias("field", "value"))
    kv = kv.filter("value IS NOT NULL")
    both = kv.groupingSets([[F.col("method"), F.col("field")], [F.col("field")]], "method", "field")
    return both.agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct"), F.grouping("method").cast("int").alias("over_methods"))


def worth_grouping(n: Column, distinct: Column, least: int = 20, share: float = 0.5) -> Column:
    """yes, no (one value, or nearly as many as rows) or unknown (too few rows)."""
    return F.when(n < least, "unknown").when((distinct <= 1) | (distinct > n * share), "no").otherwise("yes")


def overview(txns: DataFrame, dims: list[str], at: str) -> DataFrame:
    """Rows and span by each dimension, in one pass of grouping sets: dimension, value, n, first, last."""
    sets = [[F.col(c)] for c in dims]
    g = txns.select(*[F.col(c).cast("string").alias(c) for c in dims], F.col(at).alias("at")).groupingSets(sets, *dims)
    out = g.agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), *[F.grouping(c).alias(f"_{c}") for c in dims])
    name = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in dims])
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c)) for c in dims])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(name.alias("dimension"), value.alias("value"), "n", stamp("first"), stamp("last"))


def aggregate(txns: DataFrame, by: list[str], sums: list[str], errors: Column, sort: str, limit: int) -> DataFrame:
    """An ad-hoc aggregate: rows, errors and sums by up to three groups, with the number of groups and of rows."""
    if len(by) > 3 or len(sums) > 4:
        raise ValueError("at most three groups and four sums")
    g = txns.groupBy(*by).agg(F.count("*").alias("n"), F.count(F.when(errors, 1)).alias("errors"), *[F.sum(c).cast("double").alias(f"sum_{c}") for c in sums])
    total = g.agg(F.count("*").alias("groups_total"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"))
    top = g.orderBy(F.desc(sort), *[F.asc_nulls_last(c) for c in by]).limit(limit)
    return top.join(F.broadcast(total))  # one row


def activity(txns: DataFrame, grain: str, at: str, user: str, device: str, errors: Column, tz: str = "UTC") -> DataFrame:
    """Users, devices, calls, errors, first and last time by local hour, day or week."""
    t = local_time(F.col(at), tz)
    g = txns.groupBy(F.date_format(F.date_trunc(grain, t), "yyyy-MM-dd HH:mm").alias("bucket"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return g.agg(
        F.count_distinct(user).alias("users"), F.count_distinct(device).alias("devices"), F.count("*").alias("calls"), F.count(F.when(errors, 1)).alias("errors"), stamp(F.min(at)).alias("first"), stamp(F.max(at)).alias("last")
    )


def spine(spark, start: str, end: str) -> DataFrame:
    """Every day from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def day_hour_matrix(txns: DataFrame, at: str, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """A row per day, a column per hour, zeros filled, every day present."""
    t = local_time(F.col(at), tz)
    seen = txns.select(F.to_date(t).alias("day"), F.hour(t).alias("hour")).filter(F.col("day").between(F.lit(start), F.lit(end)))
    wide = seen.groupBy("day").pivot("hour", list(range(24))).count()
    out = spine(txns.sparkSession, start, end).join(wide, "day", "left")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.coalesce(F.col(str(h)), F.lit(0)).alias(f"h{h:02d}") for h in range(24)])


def user_day_grid(txns: DataFrame, user: str, at: str, login: Column, top: int = 62, tz: str = "UTC") -> DataFrame:
    """Logins and other rows by user and day, for the busiest users, with the user's total."""
    g = txns.groupBy(F.col(user).alias("user"), F.date_format(local_day(F.col(at), tz), "yyyy-MM-dd").alias("day"))
    g = g.agg(F.count(F.when(login, 1)).alias("logins"), F.count(F.when(~login, 1)).alias("rows"))
    total = g.groupBy("user").agg(F.sum(F.col("logins") + F.col("rows")).alias("total")).orderBy(F.desc("total"), "user").limit(top)
    return g.join(total, "user")


def nearest_rank(values: Column, q: float) -> Column:
    """The nearest-rank percentile of an array of numbers."""
    v = F.sort_array(values)
    return F.get(v, F.greatest(F.ceil(F.size(v) * F.lit(q)) - 1, F.lit(0)).cast("int"))


def duration_bands(df: DataFrame, seconds: Column, edges: list[int]) -> DataFrame:
    """Rows by bands of a duration: `<e1`, `e1-e2`, ..., `>=en`."""
    label = F.when(seconds < edges[0], f"<{edges[0]}")
    for a, b in zip(edges, edges[1:]):
        label = label.when(seconds < b, f"{a}-{b}")
    return df.groupBy(label.otherwise(f">={edges[-1]}").alias("band")).agg(F.count("*").alias("n"))


def buckets_back(df: DataFrame, at: str, end: str, count: int, width_s: int, kind: str, person: str) -> DataFrame:
    """count buckets of width_s seconds that end at a time, by kind, with distinct people; empty ones are there with zeros."""
    first = F.unix_timestamp(F.lit(end).cast("timestamp")) - count * width_s
    t = F.unix_timestamp(F.col(at).cast("timestamp"))
    got = df.withColumn("bucket", F.floor((t - first) / width_s)).filter(F.col("bucket").between(0, count - 1))
    kinds = df.select(kind).distinct()
    slots = kinds.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    n = got.groupBy(kind, "bucket").agg(F.count("*").alias("n"), F.count_distinct(person).alias("people"))
    return slots.join(n, [kind, "bucket"], "left").select(kind, "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("people", F.lit(0)).alias("people"))


def baseline_at(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """What is usual at this time of day: whole hours before now and the passed part of this hour, per day."""
    n = F.lit(now).cast("timestamp")
    hour, part = F.hour(n), F.minute(n) / 60.0
    t = F.col(at).cast("timestamp")
    past = df.filter((t >= F.date_trunc("day", n) - F.make_dt_interval(F.lit(days))) & (t < F.date_trunc("day", n)))
    weight = F.when(F.hour(t) < hour, F.lit(1.0)).when(F.hour(t) == hour, part).otherwise(0.0)
    return past.agg(F.round(F.sum(weight) / days, 6).alias("usual"))


def period_compare(df: DataFrame, at: str, value: Column, by: list[str], start: str, now: str) -> DataFrame:
    """This period so far against the same stretch right before it, in one pass: now, before, delta."""
    a, b = F.lit(start).cast("timestamp"), F.lit(now).cast("timestamp")
    t = F.col(at).cast("timestamp")
    width = b - a
    got = df.filter((t >= a - width) & (t < b)).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(t >= a, value)), F.lit(0)).cast("double").alias("now"), F.coalesce(F.sum(F.when(t < a, value)), F.lit(0)).cast("double").alias("before")
    )
    return got.withColumn("delta", F.when(F.col("before") != 0, F.round((F.col("now") - F.col("before")) / F.col("before"), 6)))


def what_changed(compared: DataFrame, steps: float) -> DataFrame:
    """Groups whose change passes a threshold, the largest first."""
    return compared.filter(F.abs("delta") >= steps).withColumn("direction", F.when(F.col("delta") > 0, "up").otherwise("down"))


def observe(stored: DataFrame, facts: DataFrame, bag: str, at: str) -> DataFrame:
    """A registry of fields with what new facts show: first and last seen and counts; decisions stay."""
    seen = facts.select("method", F.explode(F.map_keys(bag)).alias("field"), F.col(at).alias("at"))
    seen = seen.groupBy("method", "field").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("seen_count"))
    both = stored.unionByName(seen.withColumn("decision", F.lit(None).cast("string")))
    return both.groupBy("method", "field").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"), F.max("decision").alias("decision"))


def apply_capture(facts: DataFrame, bag: str, off: DataFrame, approved: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts of methods that are not switched off, approved fields only; names that are not approved, with counts)."""
    kept = facts.join(off.select("method"), "method", "left_anti")
    rest = kept.select("method", F.explode(F.map_keys(bag)).alias("field")).filter(~F.col("field").isin(approved))
    own = kept.withColumn(bag, F.map_filter(bag, lambda k, _: k.isin(approved)))
    return own, rest.groupBy("method", "field").agg(F.count("*").alias("n"))


def freshness(facts: DataFrame, at: str, sealed: Column, now: str) -> DataFrame:
    """Lag behind now in seconds, the share that is not sealed, and whether the data are stale."""
    n = F.unix_timestamp(F.lit(now).cast("timestamp"))
    got = facts.agg(F.max(at).alias("last"), F.round(F.avg(F.when(sealed, 0.0).otherwise(1.0)), 6).alias("open_share"))
    lag = n - F.unix_timestamp("last")
    return got.select(lag.alias("lag_s"), "open_share", (lag > 3600).cast("int").alias("stale"))


def shape_of_day(df: DataFrame, at: str, kind: str, person: str, kinds: list[str]) -> DataFrame:
    """24 hours: lines by each named kind and in all, distinct people, and whether the hour is the first peak."""
    h = df.groupBy(F.hour(at).alias("hour")).agg(F.count_distinct(person).alias("people"), F.count("*").alias("n"), *[F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds])
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    full = hours.join(h, "hour", "left").na.fill(0)
    top = full.agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak"))
    return full.join(F.broadcast(top), F.col("hour") == F.col("peak"), "left").withColumn("is_peak", F.col("peak").isNotNull().cast("int")).drop("peak")


def pick_activity(facts: DataFrame, place: str, item: str, picked: Column, at: str) -> DataFrame:
    """Per place: picks, zero picks, items that came up empty, last time."""
    return facts.groupBy(place).agg(
        F.count(F.when(picked > 0, 1)).alias("picks"), F.count(F.when(picked == 0, 1)).alias("zero_picks"), F.count_distinct(F.when(picked == 0, F.col(item))).alias("items_empty"), F.max(at).alias("last")
    )


def by_zone(places: DataFrame, zones: DataFrame, place: str, zone: str) -> DataFrame:
    """Place activity summed to zones."""
    j = places.join(zones, place, "left")
    return j.groupBy(zone).agg(F.sum("picks").alias("picks"), F.sum("zero_picks").alias("zero_picks"), F.count("*").alias("places"))


def newest_sample(facts: DataFrame, name: str, bag: str, prefixes: list[str], order: Column) -> DataFrame:
    """The newest fact of each name, its fields split by prefix."""
    top = facts.groupBy(name).agg(F.max_by(F.struct("row_id", bag), order).alias("r"))
    cols = [F.size(F.map_filter(F.col(f"r.{bag}"), _prefix(p))).alias(f"n_{p}") for p in prefixes]
    return top.select(name, F.col("r.row_id").alias("row_id"), *cols)


def _prefix(p: str):
    return lambda k, _: F.startswith(k, F.lit(f"{p}."))
