"""The delivery board: states from four inputs, tiers, their replay over time, outcomes, route rhythm, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.diff import newest


def delivery_states(routes: DataFrame, picks: DataFrame, expected: DataFrame, packages: DataFrame) -> DataFrame:
    """One row per delivery of the route universe: counts default to 0, what is expected stays null when unknown."""
    p = picks.groupBy("delivery").agg(F.count("*").alias("picked"), F.max("at").alias("last_pick"))
    e = expected.groupBy("delivery").agg(F.sum("expected").alias("expected"))
    k = packages.groupBy("delivery").agg(F.count("*").alias("packages"), F.count_if("loaded").alias("loaded"))
    out = routes.join(p, "delivery", "left").join(e, "delivery", "left").join(k, "delivery", "left")
    return out.select("delivery", "route", "departure_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("picked", "packages", "loaded")], "expected", "last_pick")


# The tiers from least to worst, and the outcomes that count as late.
RANK = ("none", "watch", "at_risk", "left_behind")
LATE = ("loaded_late", "never_loaded", "picked_late")
TICK_S = 60


def picking_open(expected: Column, confirmed: Column) -> Column:
    """Lines are still to pick; with an unknown number of lines only a delivery without any confirmation is open."""
    return F.when(expected.isNull(), confirmed == 0).otherwise(confirmed < expected)


def loading_open(loads: Column, created: Column, loaded: Column) -> Column:
    """Packages are still to load; a route without a loading step is never open."""
    return loads & ((loaded == 0) | (loaded < created))


def tier(s: dict[str, Column], now: Column, warn_s: int = 7_200, gone_s: int = 1_800) -> Column:
    """none, watch, at_risk or left_behind of a delivery at an instant, on its route's clock.

    s has the columns expected, confirmed, created, loaded, loads (the route has a loading step), usual (when the van is
    usually ready) and dock_last (the dock's last scan that day).  Nothing open is none.  The van is gone when its usual time
    is past by gone_s and the dock has been quiet for as long, or has no scan; what is open then is left behind.  Up to
    warn_s before the usual time all is well; from then on open loading is at risk and open picking is to watch.
    """
    at, usual, quiet = F.unix_timestamp(now), F.unix_timestamp(s["usual"]), F.unix_timestamp(now) - F.unix_timestamp(s["dock_last"])
    picking, loading = picking_open(s["expected"], s["confirmed"]), loading_open(s["loads"], s["created"], s["loaded"])
    gone = (at >= usual + gone_s) & (~s["loads"] | s["dock_last"].isNull() | (quiet >= gone_s))
    return F.when(~(picking | loading), "none").when(gone, "left_behind").when(at < usual - warn_s, "none").when(loading, "at_risk").otherwise("watch")


def as_seen(s: dict[str, Column], at: Column) -> dict[str, Column]:
    """The delivery as the board saw it at an instant, from its final clocks: nothing confirmed before the last pick (last_pick),
    nothing loaded before the last load (last_load), the dock busy up to its last scan."""
    before = lambda clock, n: F.when(s[clock].isNull() | (at >= s[clock]), n).otherwise(0)
    return s | {"confirmed": before("last_pick", s["confirmed"]), "loaded": before("last_load", s["loaded"]), "dock_last": F.when(s["dock_last"].isNotNull(), F.least(s["dock_last"], at))}


BOARD = ("expected", "confirmed", "created", "loaded", "loads", "usual", "dock_last", "last_pick", "last_load")


def replay(board: DataFrame, close: Column, warn_s: int = 7_200, gone_s: int = 1_800, keep: tuple[str, ...] = ()) -> DataFrame:
    """The tiers of a delivery over the few instants at which they can change, up to its close: first flag, worst tier, final
    tier, history; and the columns to keep.

    These are a tick after the warning window opens, after the usual time, after the van counts as gone (from the usual time
    or from the dock's last scan), the ends of picking and loading, and the close."""
    sec = lambda n: F.make_dt_interval(secs=F.lit(float(n)))
    usual, dock = F.col("usual"), F.col("dock_last")
    every = F.array(usual - sec(warn_s - TICK_S), usual + sec(TICK_S), usual + sec(gone_s + TICK_S), dock + sec(gone_s + TICK_S), F.col("last_pick"), F.col("last_load"), close)
    instants = F.array_sort(F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t <= close))))
    state = {c: F.col(c) for c in BOARD}
    seen = F.transform(instants, lambda t: F.struct(t.alias("at"), tier(as_seen(state, t), t, warn_s, gone_s).alias("tier")))
    rows = board.select("delivery", *keep, F.explode(F.array(seen)).alias("seen")).filter(F.size("seen") > 0)
    # The instants are few and never leave their row.
    before = lambda i: F.when(i == 0, "none").otherwise(F.get("seen", i - 1)["tier"])
    rows = rows.withColumn("changes", F.filter("seen", lambda x, i: x["tier"] != before(i)))
    rank = lambda x: F.array_position(F.array(*map(F.lit, RANK)), x["tier"])
    worst = F.array_max(F.transform("changes", lambda x: F.struct(rank(x).alias("rank"), x["tier"].alias("tier"))))["tier"]
    flagged = F.get(F.filter("changes", lambda x: x["tier"] != "none"), F.lit(0))["at"]
    return rows.select(
        "delivery", *keep, F.date_format(flagged, "yyyy-MM-dd HH:mm:ss").alias("first_flag"), F.coalesce(worst, F.lit("none")).alias("worst"),
        F.element_at("seen", -1)["tier"].alias("final"), F.array_join(F.transform("changes", lambda x: x["tier"]), ">").alias("history"),
    )


def rhythms(closed: DataFrame, asked: DataFrame, window_days: int = 28, coverage: float = 0.9, least_days: int = 3) -> DataFrame:
    """route, day, days, usual of each asked (route, day): the minute of the day up to which a route's last scan came on the
    covered share of the days that closed in the window ending that day (null: fewer than least_days).

    closed has route, day and minute.  Rows are first brought down to one a route and day, so the window holds calendar days."""
    per = closed.groupBy("route", "day").agg(F.max("minute").alias("minute")).withColumn("asked", F.lit(False))
    both = per.unionByName(asked.select("route", "day", F.lit(None).cast(dict(per.dtypes)["minute"]).alias("minute"), F.lit(True).alias("asked")).distinct())
    w = Window.partitionBy("route").orderBy(F.unix_date("day")).rangeBetween(1 - window_days, 0)
    days, covered = F.count("minute").over(w), F.percentile("minute", coverage).over(w)
    seen = both.select("route", "day", "asked", days.alias("days"), covered.alias("covered")).filter("asked")
    return seen.select("route", "day", "days", F.when(F.col("days") >= least_days, F.col("covered")).alias("usual"))


def known_before(days: DataFrame, profiles: DataFrame) -> DataFrame:
    """days (route, day) with the profile of the newest earlier day (null: none); of two profiles of one day the greater counts."""
    names = [c for c in profiles.columns if c not in ("route", "day")]
    shape = F.struct("day", *names)
    told = profiles.groupBy("route", "day").agg(F.max(shape).alias("known")).withColumn("ask", F.lit(0))
    asks = days.select("route", "day").distinct().withColumn("known", F.lit(None).cast(told.schema["known"].dataType)).withColumn("ask", F.lit(1))
    # A profile of the same day stands behind the question, and so is not seen by it.
    w = Window.partitionBy("route").orderBy("day", F.desc("ask")).rowsBetween(Window.unboundedPreceding, 0)
    got = told.unionByName(asks).withColumn("known", F.last("known", ignorenulls=True).over(w)).filter("ask = 1")
    return got.select("route", "day", F.col("known.day").alias("known_day"), *[F.col(f"known.{c}").alias(c) for c in names])


def replay_days(board: DataFrame, profiles: DataFrame, now: Column, grace_s: int, live: DataFrame | None = None, spare_s: int = 10_800) -> DataFrame:
    """Old days judged again, all at once, each by the profiles that were known before it: delivery, day, known_day, the replay's
    columns, outcome and category.

    board has delivery, route, day, departure_at and BOARD but for usual; profiles route, day, usual (minute of the day).  A
    delivery closes grace_s after its departure.  A day with a delivery that is not closed by now is left out, and so is a
    delivery that live (delivery, day) has already.  Without a profile, or with an empty one, a van is usually ready spare_s before
    its departure.  A delivery without a route or day has no day to be judged on and is left out."""
    rows = board.filter("route IS NOT NULL AND day IS NOT NULL").withColumn("close", F.col("departure_at") + F.make_dt_interval(secs=F.lit(float(grace_s))))
    over = rows.groupBy("day").agg(F.max("close").alias("_c")).filter(F.col("_c") <= now).select("day")
    rows = rows.join(over, "day", "left_semi")
    rows = rows if live is None else rows.join(live, ["delivery", "day"], "left_anti")
    ready = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("known_usual") * 60)
    rows = rows.join(known_before(rows, profiles.select("route", "day", F.col("usual").alias("known_usual"))), ["route", "day"])
    rows = rows.withColumn("usual", F.coalesce(ready, F.col("departure_at") - F.make_dt_interval(secs=F.lit(float(spare_s)))))
    s = {c: F.col(c) for c in (*BOARD, "departure_at")}
    rows = rows.withColumn("outcome", outcome_of(s)).withColumn("category", category_of(F.col("outcome"), s))
    kept = ("day", "known_day", "outcome", "category")
    return replay(rows, F.col("close"), keep=kept)


def outcome_of(s: dict[str, Column]) -> Column:
    """How a delivery ended against its departure: never_loaded, loaded_late or loaded_in_time; on a route without a loading
    step picked_late or picked_in_time."""
    late = lambda clock: F.coalesce(s[clock] > s["departure_at"], F.lit(False))
    open_ = picking_open(s["expected"], s["confirmed"])
    picked = F.when(open_ | s["last_pick"].isNull() | late("last_pick"), "picked_late").otherwise("picked_in_time")
    loaded = F.when(loading_open(s["loads"], s["created"], s["loaded"]), "never_loaded").when(late("last_load"), "loaded_late").otherwise("loaded_in_time")
    return F.when(s["loads"], loaded).otherwise(picked)


def category_of(outcome: Column, s: dict[str, Column], held_s: int = 0) -> Column:
    """One word for an outcome (null: the delivery is open): missed, held, fine, unknown or open.

    held is what went late, or `held_s` or more past the van's usual time."""
    last = F.when(s["loads"], s["last_load"]).otherwise(s["last_pick"])
    past = F.unix_micros(last) - F.unix_micros(s["usual"])
    slow = F.coalesce((past >= held_s * 1_000_000) if held_s else (past > 0), F.lit(False))
    return (
        F.when(outcome.isNull(), "open").when(outcome == "unknown", "unknown").when(outcome == "never_loaded", "missed")
        .when((outcome == "picked_late") & picking_open(s["expected"], s["confirmed"]), "missed").when(outcome.isin("picked_late", "loaded_late"), "held").when(slow, "held").otherwise("fine")
    )


def route_profile(closed: DataFrame, coverage: float = 0.9, least_days: int = 3) -> DataFrame:
    """A route's rhythm: minute of the day of its last scan, over days: coverage quantile, median, latest, and mode."""
    per = closed.groupBy("route", F.to_date("at").alias("day")).agg(F.max(F.hour("at") * 60 + F.minute("at")).alias("m"))
    got = per.groupBy("route").agg(
        F.count("*").alias("days"), F.percentile("m", coverage).alias("covered"), F.percentile("m", 0.5).alias("median"), F.max("m").alias("latest"), F.mode("m", True).alias("usual")
    )
    return got.filter(F.col("days") >= least_days)


def latest_profile(profiles: DataFrame, as_of: Column) -> DataFrame:
    """The newest profile of each route on or before a day; routes whose profiles are all later have none."""
    return newest(profiles.filter(F.col("day") <= as_of), ["route"], [F.desc("day")])


def flag_accuracy(rows: DataFrame) -> DataFrame:
    """Flags per route and worst tier: how many, and how many of them were missed or held."""
    hit = F.col("outcome").isin("missed", "held")
    return rows.groupBy("route", "worst").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.bool_and(hit).cast("int").alias("all_hit"))


def vans(rows: DataFrame, day: Column) -> DataFrame:
    """The vans of each route and day: deliveries, how many are missed, held and fine, first and last load, and whether all
    went on in time."""
    word = F.col("category")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy("route", day.alias("day")).agg(
        F.count("*").alias("deliveries"), *[F.count_if(word == c).alias(c) for c in ("missed", "held", "fine")], stamp(F.min("last_load")).alias("first_load"), stamp(F.max("last_load")).alias("last_load"), F.bool_and(word == "fine").cast("int").alias("all_fine")
    )


def apply_board(stored: DataFrame, judged: DataFrame, now: Column) -> DataFrame:
    """The board after a check, by delivery: rows judged now take their tier, a closed row that is judged again opens again
    (reopened counts it), a row that is judged no more keeps its tier; history gains a change only."""
    s = stored.select("delivery", F.col("tier").alias("_t"), F.col("state").alias("_s"), F.col("reopened").alias("_r"), F.col("history").alias("_h"))
    j = s.join(judged.select("delivery", F.col("tier").alias("_new")), "delivery", "full")
    tier_ = F.coalesce("_new", "_t")
    again = (F.col("_s") == "closed") & F.col("_new").isNotNull()
    history = F.coalesce("_h", F.array().cast("array<struct<at:timestamp,tier:string>>"))
    grown = F.when(F.col("_t").eqNullSafe(tier_), history).otherwise(F.concat(history, F.array(F.struct(now.alias("at"), tier_.alias("tier")))))
    return j.select("delivery", tier_.alias("tier"), F.when(F.col("_new").isNotNull() | F.col("_s").isNull(), "open").otherwise(F.col("_s")).alias("state"), (F.coalesce("_r", F.lit(0)) + F.coalesce(again, F.lit(False)).cast("int")).alias("reopened"), grown.alias("history"))


def close_due(board: DataFrame, now: Column, sweep_s: int = 86_400) -> DataFrame:
    """The board after a check: rows past their departure close; those that nobody closed for a day are unknown."""
    late = F.unix_timestamp(now) - F.unix_timestamp("departure_at")
    state = F.when(F.col("done_at").isNotNull() & (late >= 0), "closed").when(late >= sweep_s, "unknown").when(late >= 0, "due").otherwise("open")
    return board.withColumn("state", state)


def reconcile_findings(stored: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Findings after a run, by key: opened, refreshed, reopened, resolved or unchanged; a snooze that ran out wakes."""
    s = stored.select(F.col("key").alias("s_key"), F.col("state").alias("s_state"), F.col("snoozed_until"))
    f = found.select(F.col("key").alias("f_key"))
    j = s.join(f, F.col("s_key") == F.col("f_key"), "full")
    state = (
        F.when(F.col("s_key").isNull(), "opened")
        .when(F.col("f_key").isNull(), F.when(F.col("s_state") == "resolved", "unchanged").otherwise("resolved"))
        .when(F.col("s_state") == "resolved", "reopened")
        .when((F.col("s_state") == "snoozed") & (F.col("snoozed_until") > now), "unchanged")
        .when(F.col("s_state") == "snoozed", "woken")
        .otherwise("refreshed")
    )
    return j.select(F.coalesce("f_key", "s_key").alias("key"), state.alias("action"))


def chronic(facts: DataFrame, by: list[str], day: Column, short: Column, least_days: int = 3, within: int = 7) -> DataFrame:
    """Groups that came up short on at least least_days different days of some `within` days in a row: the most such days,
    and all short rows.

    A day that is short counts itself and the days behind it, so only one row per group and day is ordered."""
    days = facts.filter(short).groupBy(*by, day.alias("_day")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.datediff("_day", F.lit("1970-01-01").cast("date"))).rangeBetween(0, within - 1)
    g = days.withColumn("_days", F.count("*").over(w)).groupBy(*by).agg(F.max("_days").alias("days"), F.sum("_n").alias("n"))
    return g.filter(F.col("days") >= least_days).withColumn("severity", F.when(F.col("days") >= 2 * least_days, "high").otherwise("medium"))


def precision(rows: DataFrame, day: Column, today: Column, back: int = 14) -> DataFrame:
    """How often a flagged delivery of the last `back` closed days ended missed or held: flagged, late, precision (null: none)."""
    some = rows.filter(F.col("worst").isin("watch", "at_risk", "left_behind") & (day >= F.date_sub(today, back)) & (day < today))
    got = some.agg(F.count("*").alias("flagged"), F.count_if(F.col("category").isin("missed", "held")).alias("late"))
    return got.withColumn("precision", F.when(F.col("flagged") > 0, F.round(F.col("late") / F.col("flagged"), 3)))


def delivery_findings(board: DataFrame, judged: DataFrame, day: Column, today: Column) -> DataFrame:
    """A finding per flagged delivery: key, severity, lines that stay behind, and the flags' precision of late."""
    severity = F.when(F.col("tier") == "left_behind", "high").when(F.col("tier") == "at_risk", "medium").when(F.col("tier") == "watch", "low")
    behind = F.greatest(F.coalesce(F.col("expected") - F.col("confirmed"), F.lit(0)), F.lit(0))
    rows = board.filter("tier <> 'none'").select(F.concat_ws(":", F.lit("delivery"), "delivery").alias("key"), severity.alias("severity"), behind.alias("behind"))
    return rows.join(F.broadcast(precision(judged, day, today).select("precision")))  # one row


def story(txns: DataFrame, key: str, at: str, kind: str, bad: Column, outcome: Column) -> DataFrame:
    """A key's days: rows, first, last, kinds, issues, and rows by outcome as text."""
    stamp = lambda c: F.date_format(c, "HH:mm:ss")
    per = txns.groupBy(key, F.date_format(at, "yyyy-MM-dd").alias("day"), outcome.alias("_o")).agg(
        F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.collect_set(kind).alias("k"), F.count_if(bad).alias("issues")
    )
    named = F.transform(F.array_sort(F.collect_list(F.struct("_o", "n"))), lambda x: F.concat_ws("=", x["_o"], x["n"].cast("string")))
    return per.groupBy(key, "day").agg(
        F.sum("n").alias("n"), stamp(F.min("lo")).alias("first"), stamp(F.max("hi")).alias("last"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))), ",").alias("kinds"),
        F.sum("issues").alias("issues"), F.array_join(named, ",").alias("outcomes"),
    )


def site_report(deliveries: DataFrame, by: str, needs: float) -> DataFrame:
    """A report row per site: deliveries, done share, and whether it meets the need."""
    g = deliveries.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("done_at").isNotNull()).alias("done"))
    share = F.col("done") / F.col("n")
    return g.select(by, "n", "done", F.round(share, 6).alias("share"), F.when(share >= needs, "ready").otherwise("attention").alias("verdict"))


def health_check(releases: DataFrame, day: Column, target: float) -> DataFrame:
    """A day's picking: releases, fill rate, how many stayed short, and the verdict against a target fill rate."""
    g = releases.groupBy(day.alias("day")).agg(F.count("*").alias("releases"), F.sum(F.greatest(F.col("expected") - F.col("picked"), F.lit(0))).cast("double").alias("short"), F.sum("expected").cast("double").alias("wanted"), F.count_if(F.col("picked") < F.col("expected")).alias("short_releases"))
    rate = F.when(F.col("wanted") > 0, 1 - F.col("short") / F.col("wanted"))
    return g.select("day", "releases", "short_releases", F.round(rate, 6).alias("fill_rate"), F.when(rate.isNull(), "no data").when(rate >= target, "good").otherwise("below target").alias("verdict"))


def dispatch_readiness(board: DataFrame, by: str) -> DataFrame:
    """A route's open deliveries by tier, and whether it can leave: blocked (left behind), late, watch or ready."""
    count = lambda t: F.count_if(F.col("tier") == t)
    g = board.groupBy(by).agg(F.count("*").alias("deliveries"), *[count(t).alias(t) for t in RANK[1:]])
    return g.withColumn("verdict", F.when(F.col("left_behind") > 0, "blocked").when(F.col("at_risk") > 0, "late").when(F.col("watch") > 0, "watch").otherwise("ready"))


def outstanding(releases: DataFrame, long_s: float) -> DataFrame:
    """Exceptions by kind: releases without a pick, short ones, and those that ran longer than long_s."""
    span = F.col("span_s")
    kinds = F.array(F.when(F.col("picked") == 0, F.lit("zero_pick")), F.when((F.col("picked") > 0) & (F.col("picked") < F.col("expected")), F.lit("short")), F.when(span > long_s, F.lit("long_running")))
    rows = releases.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"), F.greatest(F.col("expected") - F.col("picked"), F.lit(0)).cast("double").alias("u"), span.alias("s"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("u").alias("units_short"), F.max("s").alias("longest_s"))


def assess(readings: DataFrame, watch: str, at: str, level: str, raise_at: float, clear_at: float, settle: int) -> DataFrame:
    """Watches over their checks in batch: up at once, down only after `settle` checks below the lower level.

    status is `alert` from a reading at or above raise_at on, until `settle` readings in a row are below clear_at.
    """
    w = Window.partitionBy(watch).orderBy(at)
    r = readings.withColumn("_up", (F.col(level) >= raise_at).cast("int"))
    low = F.sum((F.col(level) < clear_at).cast("int")).over(w.rowsBetween(-(settle - 1), 0))
    r = r.withColumn("_down", (low == settle).cast("int"))
    mark = F.when(F.col("_up") == 1, "alert").when(F.col("_down") == 1, "ok")
    r = r.withColumn("status", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("ok")))
    return r.drop("_up", "_down")
