"""The role algebra: a cell keeps only parts that can be merged, and answers are made from the parts when read."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

BANDS = 20
SKETCH_BITS = 12
MONEY = "decimal(20,6)"

ROLES = ("sum_value", "count_value", "sum_sq", "min_value", "max_value", "histogram", "sketch", "latest")
#: The roles that each aggregation needs.
NEEDS = {
    "count": ("count_value",), "sum": ("sum_value", "count_value"), "avg": ("sum_value", "count_value"), "min": ("min_value", "count_value"), "max": ("max_value", "count_value"),
    "stats": ("sum_value", "count_value", "sum_sq", "min_value", "max_value"), "percentile": ("histogram", "count_value"), "distinct": ("sketch", "count_value"), "latest": ("latest", "count_value"),
}


def band(v: Column) -> Column:
    """The power-of-two band of a value: bit length of its floor, from 0 to BANDS - 1."""
    d, out = v.cast("double"), F.when(v.isNull(), F.lit(None).cast("int"))
    for b in range(BANDS - 1):
        out = out.when(d < float(2**b), b)
    return out.otherwise(BANDS - 1)


def partial(value: Column, at: Column, row: Column, needs: tuple[str, ...], key: Column | None = None, in_band: Column | None = None) -> dict[str, Column]:
    """Aggregates of the wanted roles over value; null values add nothing, not even to the count.

    in_band is the value's band where the caller has worked it out already."""
    v = value.cast(MONEY) if key is None else None
    some = (key if key is not None else value).isNotNull()
    out: dict[str, Column] = {}
    if "sum_value" in needs:
        out["sum_value"] = F.coalesce(F.sum(v), F.lit(0)).cast("decimal(38,6)")
    if "count_value" in needs:
        out["count_value"] = F.count(F.when(some, 1))
    if "sum_sq" in needs:
        out["sum_sq"] = F.try_sum((v * v).cast("decimal(38,6)"))
    if "min_value" in needs:
        out["min_value"] = F.min(v)
    if "max_value" in needs:
        out["max_value"] = F.max(v)
    if "histogram" in needs:
        out["histogram"] = F.array(*[F.count(F.when((band(v) if in_band is None else in_band) == b, 1)) for b in range(BANDS)])
    if "sketch" in needs:
        out["sketch"] = F.hll_sketch_agg(key if key is not None else value.cast("string"), SKETCH_BITS)
    if "latest" in needs:
        out["latest"] = F.max(F.when(some, F.struct(at.alias("at"), row.alias("row"), v.alias("value"))))
    return out


def merge(roles: list[str]) -> dict[str, Column]:
    """Aggregates that merge stored roles."""
    how = {
        "sum_value": F.sum("sum_value"), "count_value": F.sum("count_value"), "sum_sq": F.try_sum("sum_sq"), "min_value": F.min("min_value"), "max_value": F.max("max_value"), "latest": F.max("latest"),
        "histogram": F.when(F.count("histogram") > 0, F.array(*[F.sum(F.get("histogram", F.lit(b))) for b in range(BANDS)])),
    }
    if "sketch" in roles:
        how["sketch"] = F.hll_union_agg("sketch")
    return {r: how[r] for r in roles}


def zero_rate(zeros: Column, n: Column) -> Column:
    """The share of rows that are zero; null without rows."""
    return F.when(n > 0, F.coalesce(zeros, F.lit(0)) / n)


def average(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n)


def variance(total: Column, n: Column, squares: Column) -> Column:
    """Population variance from the stored parts, never below zero."""
    t, q = total.cast("double"), squares.cast("double")
    return F.when(n > 0, F.greatest(q / n - (t / n) * (t / n), F.lit(0.0)))


def percentile_of(hist: Column, q: float) -> Column:
    """The q-quantile of a histogram: the band in which it falls, linear within the band."""
    total = F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, x: a + x)
    want = total.cast("double") * q
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(0).alias("i"), F.lit(None).cast("double").alias("out"))

    def step(s: Column, n: Column) -> Column:
        i, count = s["i"], n.cast("double")
        low = F.when(i == 0, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), i - 1))
        high = F.pow(F.lit(2.0), i)
        here = s["out"].isNull() & (count > 0) & (s["seen"] + count >= want)
        return F.struct((s["seen"] + count).alias("seen"), (i + 1).alias("i"), F.when(here, low + (high - low) * (want - s["seen"]) / count).otherwise(s["out"]).alias("out"))

    return F.when(total > 0, F.aggregate(hist, start, step, lambda s: s["out"]))



def distinct_of(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)
