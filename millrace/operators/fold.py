"""Metrics as data: definitions compiled to one aggregate, cells of mergeable roles, grain cascade, dirty buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import roles
from millrace.functions.fields import dimension, identity, local_day, local_time, number_of, number_or_null

SLOTS = 6


@dataclass(frozen=True)
class Measure:
    """A value (field, or field - minus) under a filter, with its aggregation."""

    name: str
    agg: str
    field: str | None = None
    minus: str | None = None
    where: str | None = None


@dataclass(frozen=True)
class Metric:
    """Measures by dimensions over a fact table with a time and a row id."""

    name: str
    measures: tuple[Measure, ...]
    dims: tuple[str, ...] = ()
    at: str = "event_time"
    row: str = "row_id"
    levels: tuple[str, ...] = ()

    def validate(self) -> list[str]:
        """Every problem of the definition."""
        bad = [f"{m.name}: unknown aggregation {m.agg}" for m in self.measures if m.agg not in roles.NEEDS]
        bad += [f"{m.name}: {m.agg} needs a field" for m in self.measures if m.agg != "count" and not m.field]
        bad += [f"{m.name}: a level is not summed" for m in self.measures if m.agg == "sum" and m.field in self.levels]
        bad += [f"{m.name}: minus without a field" for m in self.measures if m.minus and not m.field]
        if len(self.dims) > SLOTS:
            bad.append(f"more than {SLOTS} dimensions")
        if len({m.name for m in self.measures}) < len(self.measures):
            bad.append("two measures of one name")
        return bad


def _bucket(grain: str, at: str, tz: str) -> Column:
    if grain == "hourly":
        return F.date_format(F.col(at), "yyyy-MM-dd HH:00:00")
    day = local_day(F.col(at), tz)
    return F.date_format(day if grain == "daily" else F.trunc(day, "month"), "yyyy-MM-dd")


def rollup(facts: DataFrame, metric: Metric, grain: str = "daily", tz: str = "UTC", tasks: int | None = None) -> DataFrame:
    """bucket, dim1..dim6, measure and the measure's roles: one aggregate over one scan, then a row per measure.

    Where cells are nearly as many as rows, nothing is gained by folding each part of the table first: with `tasks`
    (`session.tasks_for`) the rows of a group are dealt out by their dimensions and folded where they lie."""
    if bad := metric.validate():
        raise ValueError("; ".join(bad))
    dims = [dimension(F.col(d)).alias(f"dim{i + 1}") for i, d in enumerate(metric.dims)]
    # Every value is worked out once, before the aggregate: a number, or for `distinct` its one spelling.
    base = facts.select(_bucket(grain, metric.at, tz).alias("bucket"), *dims, F.col(metric.at).alias("_at"), F.col(metric.row).alias("_row"), *_values(metric, dict(facts.dtypes)))
    base = base.repartition(tasks, *[f"dim{i + 1}" for i in range(len(dims))]) if tasks and dims else base
    banded = [k for k, m in enumerate(metric.measures) if "histogram" in roles.NEEDS[m.agg]]
    base = base.withColumns({f"_b{k}": roles.band(F.col(f"_v{k}")) for k in banded}) if banded else base
    parts = {}
    for k, m in enumerate(metric.measures):
        v, needs = F.col(f"_v{k}"), roles.NEEDS[m.agg]
        key, in_band = v if m.agg == "distinct" else None, F.col(f"_b{k}") if k in banded else None
        parts[k] = roles.partial(v, F.col("_at"), F.col("_row"), needs, key, in_band)
    keys = ["bucket", *[f"dim{i + 1}" for i in range(len(dims))]]
    wide = base.groupBy(*keys).agg(*[c.alias(f"{r}_{k}") for k, p in parts.items() for r, c in p.items()])
    types = dict(wide.dtypes)
    shape = {r: next((types[f"{r}_{k}"] for k, p in parts.items() if r in p), None) for r in roles.ROLES}
    used = [r for r in roles.ROLES if shape[r]]
    cells = [
        F.struct(F.lit(m.name).alias("measure"), *[(F.col(f"{r}_{k}") if r in parts[k] else F.lit(None)).cast(shape[r]).alias(r) for r in used]) for k, m in enumerate(metric.measures)
    ]
    pad = [F.lit(None).cast("string").alias(f"dim{i + 1}") for i in range(len(dims), SLOTS)]
    long = wide.select(*keys, *pad, F.inline(F.array(*cells)))
    # A cell without rows goes; a sum of 0 over real rows stays.
    return long.filter("count_value > 0")


def _values(metric: Metric, types: dict[str, str]) -> list[Column]:
    """Each measure's value under its filter."""
    out = []
    for k, m in enumerate(metric.measures):
        if m.agg == "distinct":
            value = identity(F.col(m.field))
        elif m.field is None:
            value = F.lit(1)
        else:
            value = number_of(types, m.field, roles.MONEY)
            value = value - number_of(types, m.minus, roles.MONEY) if m.minus else value
        on = F.coalesce(F.expr(m.where), F.lit(False)) if m.where else None
        out.append((value if on is None else F.when(on, value)).alias(f"_v{k}"))
    return out


def merged(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells merged on their roles to fewer keys."""
    used = [r for r in roles.ROLES if r in cells.columns]
    return cells.groupBy(*by, "measure").agg(*[c.alias(r) for r, c in roles.merge(used).items()])


def cascade(cells: DataFrame, grain: str, tz: str = "UTC") -> DataFrame:
    """Local days from hours, months from days.

    An hour of a zone whose midnight is not on an hour belongs to two days: such days must be folded from the facts, and
    asking for them here fails when the plan runs."""
    if grain == "daily":
        at = F.col("bucket").cast("timestamp")
        off = F.unix_timestamp(local_time(at, tz)) - F.unix_timestamp(at)
        day = F.date_format(local_day(at, tz), "yyyy-MM-dd")
        bucket = F.when(off % 3600 == 0, day).otherwise(F.raise_error(F.lit(f"days of {tz} do not start on an hour: fold the facts")).cast("string"))
    else:
        bucket = F.concat(F.substring("bucket", 1, 7), F.lit("-01"))
    return merged(cells.withColumn("bucket", bucket), ["bucket", *[f"dim{i + 1}" for i in range(SLOTS)]])


def finished(cells: DataFrame) -> DataFrame:
    """Roles to answers; what a measure did not keep is null."""
    has = set(cells.columns)
    n, total = F.col("count_value"), F.col("sum_value")
    out = [n.alias("n")]
    if "sum_value" in has:
        out += [total.cast("double").alias("sum"), roles.average(total.cast("double"), n).alias("avg")]
    if "sum_sq" in has:
        out.append(roles.variance(total, n, F.col("sum_sq")).alias("var"))
    out += [F.col(r).cast("double").alias(r[:3]) for r in ("min_value", "max_value") if r in has]
    if "histogram" in has:
        out += [roles.percentile_of(F.col("histogram"), q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95)]
    if "sketch" in has:
        out.append(roles.distinct_of(F.col("sketch")).alias("distinct"))
    if "latest" in has:
        out += [F.col("latest.value").cast("double").alias("latest"), F.date_format("latest.at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest_at")]
    return cells.select("bucket", *[c for c in cells.columns if c.startswith("dim")], "measure", *out)


def dirty_buckets(diff: DataFrame, at_old: str, at_new: str, grain: str, tz: str = "UTC") -> DataFrame:
    """The buckets that either side of a change touches."""
    both = diff.select(F.explode(F.array(at_old, at_new)).alias("at")).filter("at IS NOT NULL")
    return both.select(_bucket(grain, "at", tz).alias("bucket")).distinct()


def refold(stored: DataFrame, facts: DataFrame, metric: Metric, dirty: DataFrame, grain: str = "daily", tz: str = "UTC") -> DataFrame:
    """The stored cells with the dirty buckets recomputed from the facts; groups that vanished go too."""
    touched = facts.withColumn("bucket", _bucket(grain, metric.at, tz)).join(dirty, "bucket", "left_semi").drop("bucket")
    return replace_buckets(stored, rollup(touched, metric, grain, tz), dirty)


def concerned(changes: DataFrame, metrics: list[Metric]) -> dict[str, bool]:
    """Whether a change can alter a metric's cells: some changed row (old or new side, with the facts' columns) passes the filter of
    one of its measures.  One pass over the changed rows for all metrics."""
    passes = lambda m: F.coalesce(F.expr(m.where), F.lit(False)) if m.where else F.lit(True)
    some = {m.name: F.coalesce(F.bool_or(F.greatest(*[passes(x).cast("int") for x in m.measures], F.lit(0)) > 0), F.lit(False)) for m in metrics}
    row = changes.agg(*[c.alias(f"m{i}") for i, c in enumerate(some.values())]).first()
    return {name: bool(row[i]) for i, name in enumerate(some)}


def refold_concerned(stored: dict[str, DataFrame], facts: DataFrame, changes: DataFrame, metrics: list[Metric], grain: str = "daily", tz: str = "UTC") -> tuple[dict[str, DataFrame], list[str]]:
    """Each metric's stored cells after a change, and the names of the metrics that the change cannot concern: these are not folded.
    changes has every changed row's old and new side; facts are those after the change."""
    on = concerned(changes, metrics)
    out = {}
    for m in metrics:
        if not on[m.name]:
            out[m.name] = stored[m.name]
            continue
        dirty = changes.filter(F.col(m.at).isNotNull()).select(_bucket(grain, m.at, tz).alias("bucket")).distinct()
        out[m.name] = refold(stored[m.name], facts, m, dirty, grain, tz)
    return out, [m.name for m in metrics if not on[m.name]]


def replace_buckets(stored: DataFrame, new: DataFrame, buckets: DataFrame, key: str = "bucket") -> DataFrame:
    """All rows of the given buckets out, the recomputed rows in."""
    return stored.join(buckets.select(key).distinct(), key, "left_anti").unionByName(new)


def breakdown(cells: DataFrame, dim: str, top: int, measure: str, level: bool = False) -> DataFrame:
    """The leading groups of one dimension; a level ranks by its mean, not by its sum."""
    got = merged(cells.filter(F.col("measure") == measure), [dim])
    total = F.col("sum_value").cast("double")
    rank = F.abs(total / F.col("count_value")) if level else F.abs(total)
    return got.select(dim, total.alias("sum"), F.col("count_value").alias("n"), rank.alias("rank")).orderBy(F.desc("rank"), F.asc_nulls_last(dim)).limit(top)


def totals(cells: DataFrame) -> DataFrame:
    """One row per measure over a window, merged on roles."""
    return merged(cells, [])


def preview(facts: DataFrame, metric: Metric) -> DataFrame:
    """How a metric would fare: matching rows, and per measure how many values are there and how many are numbers; per
    dimension how many rows name a group."""
    one = []
    for k, m in enumerate(metric.measures):
        on = F.coalesce(F.expr(m.where), F.lit(False)) if m.where else F.lit(True)
        some = F.lit(True) if m.field is None else F.col(m.field).isNotNull()
        num = F.lit(True) if m.field is None else number_or_null(F.col(m.field)).isNotNull()
        one.append(F.struct(F.lit(m.name).alias("measure"), F.count(F.when(on, 1)).alias("matches"), F.count(F.when(on & some, 1)).alias("present"), F.count(F.when(on & num, 1)).alias("numeric")))
    for d in metric.dims:
        named = F.count(dimension(F.col(d)))
        one.append(F.struct(F.lit(f"dim:{d}").alias("measure"), F.count("*").alias("matches"), named.alias("present"), named.alias("numeric")))
    return facts.agg(F.array(*one).alias("m")).select(F.inline("m"))


def combos_per_hour(facts: DataFrame, dims: list[str], at: str) -> DataFrame:
    """How many groups an hour makes: the most, the mean and the 95th percentile."""
    n = facts.groupBy(F.date_trunc("hour", at).alias("h")).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(d).cast("string"), F.lit("\x00")) for d in dims])).alias("n"))
    return n.agg(F.max("n").alias("most"), F.avg("n").alias("mean"), F.percentile("n", 0.95).alias("p95"))
