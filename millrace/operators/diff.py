"""Stored against recomputed: range diffs, upserts, versions, audits, islands and ranges of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    return on


def range_diff(stored: DataFrame, source: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """keys and action (insert, update, unchanged, reverse) of both sides of one range, null-safe in the keys."""
    old, new = stored.select(*keys, digest).withColumn("_o", F.lit(1)).alias("old"), source.select(*keys, digest).withColumn("_n", F.lit(1)).alias("new")
    both = old.join(new, _same(stored, source, keys), "full")
    action = (
        F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "reverse").when(F.col(f"old.{digest}").eqNullSafe(F.col(f"new.{digest}")), "unchanged").otherwise("update")
    )
    return both.select(*[F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys], action.alias("action"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the newest version; of equal versions the new row wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def append_new(new: DataFrame, stored: DataFrame, keys: list[str], at: str) -> tuple[DataFrame, DataFrame]:
    """(rows not stored yet, each once; the range of time that they touch)."""
    fresh = new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")
    return fresh, fresh.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).filter("n > 0")


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in an order; the whole row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ledger_as_of(ledger: DataFrame, keys: list[str], pinned: Column, recorded: str = "recorded_at", revision: str = "revision", reason: str = "reason") -> DataFrame:
    """The version of each key known at a pin; reversed keys are out, but only after the newest is chosen."""
    known = ledger.filter(F.col(recorded) <= pinned)
    return newest(known, keys, [F.desc(recorded), F.desc(revision)]).filter(F.col(reason) != "reversed")


def missing_children(parents: DataFrame, children: DataFrame, explained: DataFrame, key: str) -> DataFrame:
    """Parents without a child and without a recorded reason."""
    return parents.join(children.select(key), key, "left_anti").join(explained.select(key), key, "left_anti")


def unowned(entries: DataFrame, assigned: DataFrame, key: str, at: str, cutoff: Column, by: str) -> DataFrame:
    """How many entries past the cut-off nobody owns, by group."""
    return entries.filter(F.col(at) < cutoff).join(assigned.select(key), key, "left_anti").groupBy(by).agg(F.count("*").alias("n"))


def compare_cells(stored: DataFrame, again: DataFrame, keys: list[str], value: str, eps: float = 1e-6) -> DataFrame:
    """keys and verdict (missing, orphaned, differs) of cells that do not agree."""
    old, new = stored.select(*keys, F.col(value).cast("double").alias("v")).withColumn("_o", F.lit(1)).alias("old"), again.select(*keys, F.col(value).cast("double").alias("v")).withColumn("_n", F.lit(1)).alias("new")
    both = old.join(new, _same(stored, again, keys), "full")
    apart = F.abs(F.coalesce(F.col("old.v"), F.lit(0.0)) - F.coalesce(F.col("new.v"), F.lit(0.0))) > eps
    verdict = F.when(F.col("_o").isNull(), "missing").when(F.col("_n").isNull(), "orphaned").when(apart, "differs")
    return both.select(*[F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys], verdict.alias("verdict")).filter("verdict IS NOT NULL")


def children_due(parents: DataFrame, children: DataFrame, key: str, version: int) -> DataFrame:
    """Parents that promise children (`promised`) but have none, or only some of an old version."""
    have = children.groupBy(key).agg(F.min("version").alias("have"))
    return parents.filter("promised > 0").join(have, key, "left").filter(F.col("have").isNull() | (F.col("have") < version)).select(key, F.coalesce("have", F.lit(-1)).alias("have"))


def key_difference(a: DataFrame, b: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """Keys of one side only, with the side; a key with a null is never on both sides.

    Both sides meet once, in `tasks` parts (`session.tasks_for`) where they are given: keys are nearly as many as rows, so that
    none is gained by putting them together before."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    both = both.repartition(tasks, *keys) if tasks else both
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    seen = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    alone = F.array(F.when((F.col("_a") == 1) & ~(whole & (F.col("_b") == 1)), "vanished"), F.when((F.col("_b") == 1) & ~(whole & (F.col("_a") == 1)), "new"))
    return seen.select(*keys, F.explode(F.array_compact(alone)).alias("side"))


def inherit_ids(new: DataFrame, old: DataFrame, member: str = "member") -> DataFrame:
    """(new_id, old_id): each new group bids for the old id that most of its members had; the strongest bid gets it.

    Ties go to the smaller id on either side.
    """
    votes = new.join(old, member).groupBy("new_id", "old_id").agg(F.count("*").alias("votes"))
    bid = newest(votes, ["new_id"], [F.desc("votes"), F.asc("old_id")])
    return newest(bid, ["old_id"], [F.desc("votes"), F.asc("new_id")]).select("new_id", "old_id", "votes")


def islands(df: DataFrame, by: list[str], at: str, row: str, gap_s: float) -> DataFrame:
    """df with `island`: a gap of more than gap_s seconds starts the next one."""
    w = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_last(), row)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    cut = F.coalesce((t - F.lag(t).over(w) > int(gap_s * 1_000_000)).cast("int"), F.lit(0))
    return df.withColumn("_c", cut).withColumn("island", F.sum("_c").over(w)).drop("_c")


def coalesce_ranges(ranges: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Ranges (lo, hi as whole numbers) that overlap or stand within the gap, as one."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("_new", F.coalesce((F.col("lo") > reach + gap).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def coalesce_even_ranges(ranges: DataFrame, gap: int, length: int) -> DataFrame:
    """coalesce_ranges over all ranges of one length: first inside buckets of a day at least, then the first and the
    last of each bucket, as only these reach over a border; so no task meets more than a bucket or two rows for each."""
    bucket = max(86_400, length + gap)
    inner = coalesce_ranges(ranges.select("lo", "hi", F.floor(F.col("lo") / bucket).alias("_b")), ["_b"], gap)
    w = Window.partitionBy("_b")
    edge = F.col("lo").eqNullSafe(F.min("lo").over(w)) | F.col("hi").eqNullSafe(F.max("hi").over(w))
    marked = inner.withColumn("_edge", edge)
    edges = coalesce_ranges(marked.filter("_edge").select("lo", "hi", F.lit(1).alias("_b")), ["_b"], gap)
    return marked.filter("NOT _edge").select("lo", "hi").union(edges.select("lo", "hi"))


def split_ranges(ranges: DataFrame, most: int) -> DataFrame:
    """Ranges cut into pieces of at most `most`; a range of one point stays."""
    first = F.explode(F.sequence(F.col("lo"), F.greatest(F.col("lo"), F.col("hi") - 1), F.lit(most).cast("bigint")))
    return ranges.withColumn("_lo", first).select(*[c for c in ranges.columns if c not in ("lo", "hi")], F.col("_lo").alias("lo"), F.least(F.col("_lo") + most, F.col("hi")).alias("hi"))


def inherit_stream(entries: DataFrame, by: list[str], order: list[Column], key: str, closes: str) -> DataFrame:
    """Rows without a key take their thread's current one; a row that closes the stream ends that."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.expr(closes), F.lit("\x00closed")).otherwise(F.col(key))
    open_ = F.last(mark, ignorenulls=True).over(w)
    return entries.withColumn("stream", F.coalesce(F.col(key), F.when(open_ != "\x00closed", open_)))


def round_robin(df: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """Rows of all groups in turn, up to a limit."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).orderBy("_r", by).limit(limit).withColumnRenamed("_r", "turn")


def burst_cap(events: DataFrame, by: str, at: str, row: str, window_s: int, cap: int, title: str) -> tuple[DataFrame, DataFrame]:
    """(events within the cap of their rule and window; one summary of the rest with its three leading titles)."""
    slot = F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / window_s)
    rows = events.withColumn("slot", slot)
    w = Window.partitionBy(by, "slot").orderBy(at, row)
    rows = rows.withColumn("_r", F.row_number().over(w))
    rest = rows.filter(F.col("_r") > cap).groupBy(by, "slot", title).agg(F.count("*").alias("n"))
    t = Window.partitionBy(by, "slot").orderBy(F.desc("n"), title)
    ranked = rest.withColumn("_t", F.row_number().over(t))
    names = F.array_sort(F.collect_list(F.when(F.col("_t") <= 3, F.struct("_t", F.col(title).alias("name")))))
    summary = ranked.groupBy(by, "slot").agg(F.sum("n").alias("held"), F.array_join(F.transform(names, lambda x: x["name"]), ",").alias("leading"))
    return rows.filter(F.col("_r") <= cap).drop("_r", "slot"), summary


def over_quota(events: DataFrame, user: str, at: str, row: str, per_user: int, tenant: str | None = None, per_tenant: int | None = None) -> DataFrame:
    """Rows beyond a user's quota of their hour, or beyond their tenant's, with the limit that they pass first."""
    hour = F.date_trunc("hour", at)
    rows = events.withColumn("nth", F.row_number().over(Window.partitionBy(user, hour).orderBy(at, row)))
    limit = F.when(F.col("nth") > per_user, "user")
    if tenant:
        rows = rows.withColumn("nth_of_tenant", F.row_number().over(Window.partitionBy(tenant, hour).orderBy(at, row)))
        limit = limit.when(F.col("nth_of_tenant") > per_tenant, "tenant")
    return rows.withColumn("limit", limit).filter(F.col("limit").isNotNull())


def keyset_page(df: DataFrame, down: str, up: str, after: tuple | None, limit: int) -> DataFrame:
    """The page after (down, up) in the order down descending, up ascending, with one row more to show that it goes on."""
    if after is not None:
        df = df.filter((F.col(down) < F.lit(after[0])) | ((F.col(down) == F.lit(after[0])) & (F.col(up) > F.lit(after[1]))))
    return df.orderBy(F.desc(down), F.asc(up)).limit(limit + 1)


def prune_unseen(registry: DataFrame, facts: DataFrame, bag: str, since: Column, at: str, named: list[str]) -> DataFrame:
    """(method, field, verdict): fields on no fact since a time go, unless a person reviewed them or a metric names them."""
    seen = facts.filter(F.col(at) >= since).select("method", F.explode(F.map_keys(bag)).alias("field")).distinct().withColumn("_s", F.lit(1))
    verdict = (
        F.when(F.col("_s") == 1, "seen").when(F.col("reviewed"), "kept: reviewed").when(F.col("field").isin(named), "kept: in a metric").otherwise("pruned")
    )
    return registry.join(seen, ["method", "field"], "left").select("method", "field", verdict.alias("verdict"))
