"""Queries of diffs, versions, audits, ranges and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fields import fingerprint
from millrace.operators import diff
from millrace.plans.base import calls, facts, orders
from millrace.plans.registry import query
from millrace.session import table

STAMP = "yyyy-MM-dd HH:mm:ss"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as they were stored, and as the source has them now: every 7th changed, every 11th gone, every 13th new."""
    now = orders(spark, d)
    old = now.filter("o_orderkey % 13 <> 0").withColumn("total", F.when(F.col("o_orderkey") % 7 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return old, now.filter("o_orderkey % 11 <> 0")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", fingerprint(total=(F.col("total"), "number"), status=(F.col("o_orderstatus"), "text"), at=(F.col("at"), "time")))


_ACTION = """CASE WHEN o_orderkey % 13 = 0 THEN 'insert' WHEN o_orderkey % 11 = 0 THEN 'reverse' WHEN o_orderkey % 7 = 0 THEN 'update' ELSE 'unchanged' END"""


@query("range_diff", f"SELECT o_orderkey, {_ACTION} AS action FROM orders WHERE NOT (o_orderkey % 13 = 0 AND o_orderkey % 11 = 0)")
def range_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _versions(spark, d)
    return diff.range_diff(_hashed(old), _hashed(new), ["o_orderkey"], "digest")


@query("key_difference", "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'new' ELSE 'vanished' END AS side FROM orders WHERE (o_orderkey % 13 = 0) <> (o_orderkey % 11 = 0)")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    return diff.key_difference(*_versions(spark, d), ["o_orderkey"])


@query(
    "upsert_newest",
    "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY 1",
)
def upsert_newest(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("version", F.struct("at", "o_orderkey"))
    stored = diff.newest(o.filter("o_orderkey % 2 = 0"), ["o_custkey"], [F.desc("version")])
    new = diff.newest(o.filter("o_orderkey % 2 = 1"), ["o_custkey"], [F.desc("version")])
    return diff.upsert(stored, new, ["o_custkey"], "version").select("o_custkey", "o_orderkey", F.date_format("at", "yyyy-MM-dd").alias("day"))


@query("append_new", "SELECT count(DISTINCT md5(text)) - count(DISTINCT md5(text)) FILTER (doc_id % 3 = 0) AS n FROM documents")
def append_new(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    fresh, _ = diff.append_new(docs, docs.filter("doc_id % 3 = 0").select("digest").distinct(), ["digest"], "doc_id")
    return fresh.agg(F.count("*").alias("n"))


@query(
    "ledger_as_of",
    """WITH l AS (SELECT o_custkey AS id, o_orderkey AS revision, o_orderdate AS recorded, CASE WHEN o_orderstatus = 'P' THEN 'reversed' ELSE 'change' END AS reason FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded DESC, revision DESC) AS n FROM l) SELECT id, revision FROM r WHERE n = 1 AND reason <> 'reversed'""",
)
def ledger_as_of(spark: SparkSession, d: str) -> DataFrame:
    led = orders(spark, d).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("revision"), F.col("at").alias("recorded_at"), F.when(F.col("o_orderstatus") == "P", "reversed").otherwise("change").alias("reason"))
    return diff.ledger_as_of(led, ["id"], F.lit("1998-06-30 00:00:00").cast("timestamp")).select("id", "revision")


@query("missing_children", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)")
def missing_children(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_orderkey", "o_orderstatus")
    kids = calls(spark, d).filter("quantity > 10").select(F.col("order_key").alias("o_orderkey"))
    return diff.missing_children(o, kids, o.filter("o_orderstatus = 'P'"), "o_orderkey").select("o_orderkey")


@query("unowned_entries", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) GROUP BY 1")
def unowned_entries(spark: SparkSession, d: str) -> DataFrame:
    own = calls(spark, d).filter("quantity > 25").select(F.col("order_key").alias("o_orderkey"))
    return diff.unowned(orders(spark, d), own, "o_orderkey", "at", F.lit("2000-01-01").cast("timestamp"), "o_orderpriority")


@query(
    "compare_cells",
    """WITH a AS (SELECT l_partkey AS part, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1), b AS (SELECT l_partkey AS part, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT coalesce(a.part, b.part) AS part, CASE WHEN a.part IS NULL THEN 'missing' WHEN b.part IS NULL THEN 'orphaned' ELSE 'differs' END AS verdict FROM a FULL JOIN b ON a.part = b.part WHERE a.v IS DISTINCT FROM b.v""",
)
def compare_cells(spark: SparkSession, d: str) -> DataFrame:
    total = lambda where: calls(spark, d).filter(where).groupBy(F.col("l_partkey").alias("part")).agg(F.sum("quantity").alias("v"))
    return diff.compare_cells(total("row_id <> 3"), total("row_id > 1"), ["part"], "v")


@query(
    "children_due",
    """WITH c AS (SELECT l_orderkey AS k, min(l_linenumber) AS have FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
SELECT o_orderkey, coalesce(have, -1) AS have FROM orders LEFT JOIN c ON k = o_orderkey WHERE o_totalprice > 1000 AND (have IS NULL OR have < 3)""",
)
def children_due(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).select("o_orderkey", (F.col("total") > 1000).cast("int").alias("promised"))
    kids = calls(spark, d).filter("row_id > 1").select(F.col("order_key").alias("o_orderkey"), F.col("row_id").alias("version"))
    return diff.children_due(o, kids, "o_orderkey", 3)


@query(
    "inherit_ids",
    """WITH v AS (SELECT o_custkey % 19 AS new_id, o_orderkey % 37 AS old_id, count(*) AS votes FROM orders GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY votes DESC, old_id) AS r FROM v),
w AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY votes DESC, new_id) AS q FROM b WHERE r = 1) SELECT new_id, old_id, votes FROM w WHERE q = 1""",
)
def inherit_ids(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumnRenamed("o_orderkey", "member")
    return diff.inherit_ids(o.select("member", (F.col("o_custkey") % 19).alias("new_id")), o.select("member", (F.col("member") % 37).alias("old_id")))


@query(
    "idle_islands",
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g) SELECT user_id, island::BIGINT AS island, count(*) AS n FROM i GROUP BY 1, 2""",
)
def idle_islands(spark: SparkSession, d: str) -> DataFrame:
    got = diff.islands(facts(spark, d), ["user_id"], "event_time", "row_id", 6 * 3600)
    return got.groupBy("user_id", "island").agg(F.count("*").alias("n"))


_RANGES = "r AS (SELECT user_id, epoch(date_trunc('hour', ts))::BIGINT AS lo, epoch(date_trunc('hour', ts))::BIGINT + 5400 AS hi FROM events)"


@query(
    "coalesced_ranges",
    f"""WITH {_RANGES}, c AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1800 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo, hi) AS run FROM c) SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, run""",
)
def coalesced_ranges(spark: SparkSession, d: str) -> DataFrame:
    return diff.coalesce_ranges(_ranges(spark, d), ["user_id"], 1800)


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    lo = F.unix_timestamp(F.date_trunc("hour", "event_time"))
    return facts(spark, d).select("user_id", lo.alias("lo"), (lo + 5400).alias("hi"))


@query("split_ranges", f"WITH {_RANGES}, u AS (SELECT user_id, hi, unnest(range(lo, greatest(lo, hi - 1) + 1, 3600)) AS lo FROM r) SELECT user_id, lo, least(lo + 3600, hi) AS hi FROM u")
def split_ranges(spark: SparkSession, d: str) -> DataFrame:
    return diff.split_ranges(_ranges(spark, d), 3600)


@query(
    "inherit_stream",
    """WITH k AS (SELECT *, CASE WHEN event_type = 'click' THEN event_id::VARCHAR END AS key FROM events),
o AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN '!' ELSE key END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM k)
SELECT event_id, coalesce(key, CASE WHEN open <> '!' THEN open END) AS stream FROM o""",
)
def inherit_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).withColumn("key", F.when(F.col("method") == "click", F.col("row_id").cast("string")))
    got = diff.inherit_stream(rows, ["user_id"], [F.col("event_time"), F.col("row_id")], "key", "method = 'error'")
    return got.select(F.col("row_id").alias("event_id"), "stream")


@query(
    "round_robin",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS turn FROM orders) SELECT * FROM r ORDER BY turn, o_orderpriority LIMIT 33""",
)
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return diff.round_robin(orders(spark, d), "o_orderpriority", [F.col("at"), F.col("o_orderkey")], 33).select("o_orderkey", "o_orderpriority", "turn")


_BURST = """r AS (SELECT event_id, event_type, user_id, epoch(ts)::BIGINT // 86400 AS slot, row_number() OVER (PARTITION BY event_type, floor(epoch(ts) / 86400) ORDER BY ts, event_id) AS n FROM events)"""


@query("burst_admitted", f"WITH {_BURST.replace('epoch(ts)::BIGINT // 86400', 'floor(epoch(ts) / 86400)::BIGINT')} SELECT event_id FROM r WHERE n <= 4")
def burst_admitted(spark: SparkSession, d: str) -> DataFrame:
    return diff.burst_cap(facts(spark, d), "method", "event_time", "row_id", 86400, 4, "user_id")[0].select(F.col("row_id").alias("event_id"))


@query(
    "burst_summary",
    f"""WITH {_BURST.replace('epoch(ts)::BIGINT // 86400', 'floor(epoch(ts) / 86400)::BIGINT')}, t AS (SELECT event_type, slot, user_id, count(*) AS n FROM r WHERE n > 4 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, slot ORDER BY n DESC, user_id) AS i FROM t)
SELECT event_type AS method, slot, sum(n)::BIGINT AS held, string_agg(user_id::VARCHAR, ',' ORDER BY i) FILTER (i <= 3) AS leading FROM k GROUP BY 1, 2""",
)
def burst_summary(spark: SparkSession, d: str) -> DataFrame:
    return diff.burst_cap(facts(spark, d), "method", "event_time", "row_id", 86400, 4, "user_id")[1]


@query("over_quota", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS nth FROM events) SELECT event_id, nth FROM r WHERE nth > 2")
def over_quota(spark: SparkSession, d: str) -> DataFrame:
    return diff.over_quota(facts(spark, d), "method", "event_time", "row_id", 2).select(F.col("row_id").alias("event_id"), "nth")


@query(
    "keyset_page",
    """WITH v AS (SELECT o_custkey AS subject, count(*) AS volume FROM orders GROUP BY 1), f AS (SELECT * FROM v ORDER BY volume DESC, subject LIMIT 1 OFFSET 9)
SELECT v.subject, v.volume FROM v, f WHERE v.volume < f.volume OR (v.volume = f.volume AND v.subject > f.subject) ORDER BY v.volume DESC, v.subject LIMIT 11""",
)
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    v = orders(spark, d).groupBy(F.col("o_custkey").alias("subject")).agg(F.count("*").alias("volume"))
    last = diff.keyset_page(v, "volume", "subject", None, 9).collect()[9]
    return diff.keyset_page(v, "volume", "subject", (last["volume"], last["subject"]), 10)


@query("top_k_worst", "SELECT o_orderkey, o_totalprice AS total FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_worst(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).orderBy("o_orderpriority", F.desc("total"), "o_orderkey").limit(25).select("o_orderkey", F.col("total").cast("double").alias("total"))


@query(
    "prune_unseen",
    """WITH reg AS (SELECT DISTINCT event_type AS method, 'k' || (event_id % 40) AS field, (event_id % 40) % 5 = 0 AS reviewed FROM events),
seen AS (SELECT DISTINCT event_type AS method, 'k' || (event_id % 40) AS field FROM events WHERE ts >= TIMESTAMP '2024-01-28')
SELECT method, field, CASE WHEN seen.field IS NOT NULL THEN 'seen' WHEN reviewed THEN 'kept: reviewed' WHEN reg.field IN ('k1', 'k2') THEN 'kept: in a metric' ELSE 'pruned' END AS verdict FROM reg LEFT JOIN seen USING (method, field)""",
)
def prune_unseen(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d).withColumn("field", F.concat(F.lit("k"), F.col("row_id") % 40)).withColumn("bag", F.create_map("field", F.lit("1")))
    reg = f.select("method", "field", ((F.col("row_id") % 40) % 5 == 0).alias("reviewed")).distinct()
    return diff.prune_unseen(reg, f, "bag", F.lit("2024-01-28").cast("timestamp"), "event_time", ["k1", "k2"])


@query(
    "latest_rows",
    "SELECT user_id, event_type AS method, arg_max(event_id, (ts, event_id)) AS row_id, arg_max(value, (ts, event_id)) AS quantity FROM events GROUP BY 1, 2",
)
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    top = facts(spark, d).groupBy("user_id", "method").agg(F.max_by(F.struct("row_id", "quantity"), F.struct("event_time", "row_id")).alias("r"))
    return top.select("user_id", "method", "r.row_id", F.col("r.quantity").cast("double").alias("quantity"))


@query(
    "company_scope",
    "SELECT event_id FROM events e WHERE event_type = 'purchase' OR (event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100))",
)
def company_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a company: tagged (purchases), or untagged (views) and made by one of its workers."""
    f = facts(spark, d)
    workers = f.filter("method = 'purchase' AND quantity > 100").select("user_id").distinct().withColumn("_w", F.lit(1))
    got = f.join(workers, "user_id", "left").filter("method = 'purchase' OR (method = 'view' AND _w = 1)")
    return got.select(F.col("row_id").alias("event_id"))
