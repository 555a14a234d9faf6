"""Settlement: many calls of one key become one row, by rules that are data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.fields import NUMBER, TIME, number_of, number_or_null, seconds_between
from millrace.operators.lookup import as_of

RULES = ("first", "last", "first_text", "last_text", "sum", "count", "min", "max", "distinct_count", "difference", "flag", "lookup")
READS_SETTLED = ("difference", "flag", "lookup")
OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


@dataclass(frozen=True)
class Value:
    """One settled value: a rule over a field under a filter, or an expression over earlier values.

    `lookup` takes what the lookup named by `field` held for the key, carried field or value named by `left` when the
    key was first seen."""

    name: str
    rule: str
    field: str | None = None
    where: str | None = None
    left: str | None = None
    right: str | None = None
    op: str | None = None
    right_value: float | None = None


@dataclass(frozen=True)
class Settlement:
    name: str
    key: tuple[str, ...]
    values: tuple[Value, ...]
    at: str = "event_time"
    row: str = "row_id"
    carry: tuple[str, ...] = field(default=())

    def validate(self) -> list[str]:
        bad, seen = [], {"first_at", "last_at", "calls", *self.key, *self.carry}
        for v in self.values:
            if v.rule not in RULES:
                bad.append(f"{v.name}: unknown rule {v.rule}")
            if v.rule in READS_SETTLED:
                bad += [f"{v.name}: {x} comes later or is missing" for x in (v.left, v.right) if x and x not in seen]
            elif v.rule != "count" and not v.field:
                bad.append(f"{v.name}: {v.rule} needs a field")
            if v.rule == "lookup" and not (v.field and v.left):
                bad.append(f"{v.name}: a lookup needs its name and a key")
            if v.rule == "flag" and v.op not in OPS:
                bad.append(f"{v.name}: unknown comparison {v.op}")
            seen.add(v.name)
        if not self.key:
            bad.append("no key")
        return bad


def settle(rows: DataFrame, s: Settlement, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per key: key, calls, first_at, last_at, carried fields (first non-empty by time) and every value.

    Rows of a null key are left out.  A sum or count over no rows is 0; first, last, min and max over none are null.
    Order inside a key is (time, nulls last, row id), so ties are settled the same way each time.
    """
    if bad := s.validate():
        raise ValueError("; ".join(bad))
    types = dict(rows.dtypes)
    order = F.struct(F.col(s.at).isNull(), F.col(s.at), F.col(s.row))
    newest = F.struct(~F.col(s.at).isNull(), F.col(s.at), F.col(s.row))
    aggs = [F.count("*").alias("calls"), F.min(s.at).alias("first_at"), F.max(s.at).alias("last_at")]
    aggs += [F.min_by(c, F.when(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).isNotNull(), order)).alias(c) for c in s.carry]
    for v in (v for v in s.values if v.rule not in READS_SETTLED):
        on = F.coalesce(F.expr(v.where), F.lit(False)) if v.where else F.lit(True)
        raw = F.col(v.field) if v.field else F.lit(1)
        num = number_of(types, v.field, "decimal(20,6)") if v.field else raw
        text = F.nullif(F.trim(raw.cast("string")), F.lit(""))
        one = {
            "first": F.min_by(num, F.when(on & num.isNotNull(), order)),
            "last": F.max_by(num, F.when(on & num.isNotNull(), newest)),
            "first_text": F.min_by(text, F.when(on & text.isNotNull(), order)),
            "last_text": F.max_by(text, F.when(on & text.isNotNull(), newest)),
            "sum": F.coalesce(F.sum(F.when(on, num)), F.lit(0).cast("decimal(30,6)")),
            "count": F.count(F.when(on, 1)),
            "min": F.min(F.when(on, num)),
            "max": F.max(F.when(on, num)),
            "distinct_count": F.count_distinct(F.when(on, text)),
        }[v.rule]
        aggs.append(one.alias(v.name))
    key = F.lit(True)
    for k in s.key:
        key = key & F.col(k).isNotNull()
    out = rows.filter(key).groupBy(*s.key).agg(*aggs)
    for v in (v for v in s.values if v.rule in READS_SETTLED):
        if v.rule == "lookup":
            out = as_of(out, lookups[v.field], v.left, F.col("first_at"), v.name)
        elif v.rule == "difference":
            times = v.left in ("first_at", "last_at")
            out = out.withColumn(v.name, seconds_between(F.col(v.left), F.col(v.right)) if times else F.col(v.left) - F.col(v.right))
        else:
            right = F.col(v.right) if v.right else F.lit(v.right_value)
            out = out.withColumn(v.name, F.coalesce(OPS[v.op](F.col(v.left), right), F.lit(False)).cast("int"))
    return out


def dealt(rows: DataFrame, s: Settlement, tasks: int) -> DataFrame:
    """Rows dealt out by the settlement's key, which are then settled where they lie: `tasks` (`session.tasks_for`) bounds what one task
    sorts, which otherwise grows with the parts that the table is read in."""
    return rows.repartition(tasks, *s.key)


def resettle(stored: DataFrame, rows: DataFrame, batch: DataFrame, s: Settlement) -> DataFrame:
    """Stored rows with those of the batch's keys settled again from all their calls."""
    touched = batch.select(*s.key).distinct()
    again = settle(rows.join(touched, list(s.key), "left_semi"), s)
    return stored.join(touched, list(s.key), "left_anti").unionByName(again)


_CONDITION = re.compile(r"^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*(<=|>=|!=|<|>|=)\s*(.*?)\s*$")


def condition(text: str) -> Column:
    """`field op value` as a Column: numbers compare as numbers, times as times, the rest as text; what is not
    of the value's kind does not match."""
    m = _CONDITION.match(text)
    if not m:
        raise ValueError(f"not a condition: {text}")
    c, op, value = F.col(m[1]), OPS[m[2]], m[3].strip("'\"")
    if re.match(NUMBER, value):
        return F.coalesce(op(number_or_null(c), F.lit(value).cast("decimal(30,6)")), F.lit(False))
    if re.match(TIME, value):
        return F.coalesce(op(c.try_cast("timestamp"), F.lit(value).cast("timestamp")), F.lit(False))
    return F.coalesce(op(c.cast("string"), F.lit(value)), F.lit(False))


def where(df: DataFrame, conditions: list[str]) -> DataFrame:
    for c in conditions:
        df = df.filter(condition(c))
    return df


def contradictions(conditions: list[str]) -> list[str]:
    """Equalities of one field with different values: nothing can match them."""
    seen: dict[str, str] = {}
    bad = []
    for c in conditions:
        m = _CONDITION.match(c)
        if m and m[2] == "=" and seen.setdefault(m[1], m[3]) != m[3]:
            bad.append(f"{m[1]} cannot be both {seen[m[1]]} and {m[3]}")
    return bad


def stat(kind: str, c: str) -> Column:
    """median, p90, p95, p99 (continuous), mean, min, max or distinct of a settled value."""
    at = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    if kind in at:
        return F.percentile(F.col(c).cast("double"), at[kind])
    return {"mean": F.avg(F.col(c).cast("double")), "min": F.min(c).cast("double"), "max": F.max(c).cast("double"), "distinct": F.count_distinct(c)}[kind]


def read_grouped(settled: DataFrame, by: list[Column], sums: list[str], stats: list[tuple[str, str]] = (), conditions: list[str] = ()) -> DataFrame:
    """Rows, calls, the sum of each value and the asked statistics by group."""
    aggs = [F.count("*").alias("n"), F.sum("calls").alias("calls"), *[F.sum(c).cast("double").alias(f"sum_{c}") for c in sums], *[stat(k, c).alias(f"{k}_{c}") for k, c in stats]]
    return where(settled, list(conditions)).groupBy(*by).agg(*aggs)


def with_overall(settled: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """The groups and one overall row over all rows (is_overall = 1), in one pass."""
    aggs = [F.count("*").alias("n"), F.sum("calls").alias("calls"), *[F.sum(c).cast("double").alias(f"sum_{c}") for c in sums]]
    return settled.rollup(by).agg(*aggs, F.grouping(by).cast("int").alias("is_overall"))


def extremes(grouped: DataFrame, by: str, value: str) -> DataFrame:
    """The named lowest and highest group."""
    return grouped.agg(
        F.min(F.struct(value, by))[by].alias("lowest"), F.min(value).alias("lowest_value"), F.max(F.struct(value, by))[by].alias("highest"), F.max(value).alias("highest_value")
    )


def list_settled(settled: DataFrame, search: str, columns: list[str], sort: str, limit: int, offset: int = 0) -> DataFrame:
    """Rows whose columns hold the text, sorted as numbers where they are numbers, nulls last."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(search.lower())), F.lit(False))
    order = [F.desc_nulls_last(number_or_null(F.col(sort))), F.desc_nulls_last(F.col(sort).cast("string")), *[F.col(c) for c in columns]]
    return settled.filter(hit).orderBy(*order).offset(offset).limit(limit)


def explain_key(rows: DataFrame, s: Settlement, key: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """The calls of one key in order, and the row that they settle to."""
    own = rows
    for k, v in key.items():
        own = own.filter(F.col(k) == F.lit(v))
    return own.orderBy(F.asc_nulls_last(s.at), s.row), settle(own, s)
