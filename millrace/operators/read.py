"""The metric reader: which grain to read, and where settled cells end and live facts begin."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.fold import Metric, merged, rollup

# The budgets of a read.
MAX_BUCKETS = 60
MAX_ROWS = 100_000
GRAINS = (("hourly", timedelta(hours=1)), ("daily", timedelta(days=1)), ("monthly", timedelta(days=30)))


def choose_grain(start: datetime, end: datetime, groups: int = 1) -> str:
    """The finest grain within the budgets of buckets and rows, else the coarsest."""
    for name, width in GRAINS:
        n = max(1, -((start - end) // width))
        if n <= MAX_BUCKETS and n * groups <= MAX_ROWS:
            return name
    return GRAINS[-1][0]


@dataclass(frozen=True)
class ReadPlan:
    """Whole settled buckets in [settled_from, settled_to), live facts in the windows beside them."""

    grain: str
    settled_from: datetime | None
    settled_to: datetime | None
    live: tuple[tuple[datetime, datetime], ...]


def _floor(t: datetime, grain: str) -> datetime:
    t = t.replace(minute=0, second=0, microsecond=0)
    if grain != "hourly":
        t = t.replace(hour=0)
    return t.replace(day=1) if grain == "monthly" else t


def _next(t: datetime, grain: str) -> datetime:
    return t + timedelta(hours=1) if grain == "hourly" else t + timedelta(days=1) if grain == "daily" else (t.replace(day=28) + timedelta(days=4)).replace(day=1)


def plan_read(start: datetime, end: datetime, settled_until: datetime, grain: str) -> ReadPlan:
    """One boundary, no overlap and no gap: cells where whole buckets are settled, facts for the ragged rest."""
    lo = _floor(start, grain)
    lo = lo if lo == start else _next(lo, grain)
    hi = min(_floor(end, grain), _floor(settled_until, grain))
    if hi <= lo:
        return ReadPlan(grain, None, None, ((start, end),) if start < end else ())
    return ReadPlan(grain, lo, hi, tuple(w for w in ((start, lo), (hi, end)) if w[0] < w[1]))


def _text(t: datetime, grain: str) -> str:
    return t.strftime("%Y-%m-%d %H:00:00") if grain == "hourly" else t.strftime("%Y-%m-%d")


def two_tier(cells: DataFrame, facts: DataFrame, metric: Metric, plan: ReadPlan) -> DataFrame:
    """Settled cells and live facts in one set of cells, merged on roles."""
    parts = []
    if plan.settled_from is not None:
        parts.append(cells.filter((F.col("bucket") >= _text(plan.settled_from, plan.grain)) & (F.col("bucket") < _text(plan.settled_to, plan.grain))))
    if plan.live:
        at, when = F.col(metric.at), F.lit(False)
        for a, b in plan.live:
            when = when | ((at >= F.lit(a)) & (at < F.lit(b)))
        parts.append(rollup(facts.filter(when), metric, plan.grain))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return merged(out, ["bucket", *[f"dim{i + 1}" for i in range(6)]])


