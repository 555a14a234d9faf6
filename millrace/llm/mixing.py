"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, held to `max_epochs` times its own size; what is held back goes
to the other sources by weight until none is above.  A source is read whole as often as its target allows (complete
epochs); the rest of the target is drawn without replacement: each document gets the exponential key
-ln(u) / quality weight, documents are taken in the order of their keys, and the running sum of their sizes stops at the
budget.  The document that crosses the budget is taken if that ends nearer to it.

No source meets in one task.  Keys are put into `bins` ordered bins; sums per source and bin say in which bin a budget
runs out, every document of an earlier bin is taken, and only the one bin that crosses is sorted.  u comes from a
digest of doc_id and seed, so reruns agree.

Null text has size 0; null and empty sources are sources of their own, null last.  Documents of size 0 are never
worth a place and take 0.  Equal rows have equal keys: they stand next to each other, ordered by doc_id and then by
size.  Documents without a doc_id are drawn by a digest of their text.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD_SEP, row_hash, text_col, written

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Bins of keys: sums of one source fit one task, and the one that crosses holds few of its documents.
BINS = 1 << 16
SEED = "mix-1"
#: Documents of this many words or more have full length weight.
FULL_WORDS = 200
#: The share of u that one of the 2^52 values of the digest stands for.
_STEP = 4503599627370496


def word_count(text: Column) -> Column:
    bare = F.regexp_replace(text, f"^{WORD_SEP}|{WORD_SEP}$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WORD_SEP, -1))).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """From 0.2 to 1: few words and many marks count against a document."""
    marks = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    long = F.least(size, F.lit(FULL_WORDS)) / F.lit(float(FULL_WORDS))
    clean = F.lit(1.0) - F.least(marks, size) / F.greatest(size, F.lit(1)).cast("double")
    return F.lit(0.2) + F.lit(0.8) * long * clean


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with `target`; one row per source is all that meets here.

    Raising one level for all, a source stops at its cap first when cap / weight is smallest.  So sources are ordered
    by that ratio, and a source is capped when the level that would use up the words left, after capping all before
    it, is at or above its own ratio.
    """
    every = Window.partitionBy(F.lit(1))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(named) - 1) % len(WEIGHTS)) + 1)
    s = sizes.withColumn("w", weight.cast("bigint")).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_from", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    )
    # cap / w <= (total - cap_before) / w_from, without division
    s = s.withColumn("capped", F.col("cap") * F.col("w_from") <= (F.col("total") - F.col("cap_before")) * F.col("w"))
    s = s.withColumn("free", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every))
    s = s.withColumn("w_free", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every))
    shared = F.col("w").cast("double") * F.col("free") / F.col("w_free")
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def _key(doc_id: Column, text: Column, weight: Column) -> Column:
    """The exponential key of a document; one without an id is drawn by its text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.md5(F.encode(text, "utf-8"))), F.lit(f"|{SEED}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(_STEP))
    return -F.log(u) / weight


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return _mixed(docs)


def _mixed(docs: DataFrame, *more: str) -> DataFrame:
    """The same with further columns of docs, by which ties are broken."""
    base = docs.select("doc_id", "source", text_col().alias("text"), *more).withColumn("size", word_count(F.col("text")))
    base = base.withColumn("key", _key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text"), F.col("size"))))
    # The bin grows with the key.
    bin_ = F.floor(F.lit(float(BINS)) * F.col("key") / (F.col("key") + F.lit(1.0))).cast("int")
    # Written once, so that the texts are read once.
    return _taken(written(base.select("doc_id", "source", "size", "key", bin_.alias("bin"), *more), "mix"), *more)


def _taken(rows: DataFrame, *more: str) -> DataFrame:
    by_bin = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    targets = source_targets(by_bin.groupBy("source").agg(F.sum("n").alias("source_size")))
    size = F.col("source_size")
    plan = targets.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("bigint"))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * size)
    # One row per source and bin: at most BINS rows of a source meet.
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = by_bin.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    bins = bins.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bins = bins.select(
        F.col("source").alias("b_source"),
        F.col("bin").alias("b_bin"),
        "source_size",
        "target",
        "epochs",
        (F.col("budget") - F.col("before")).alias("left"),
        (F.col("before") + F.col("n") <= F.col("budget")).alias("whole"),
        ((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("n") > F.col("budget"))).alias("crosses"),
    )
    # A hot source is spread over its bins, so the join deals it out evenly.
    joined = rows.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")))
    run = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = joined.filter("crosses").withColumn("sum", F.sum("size").over(run))
    over = F.col("sum") - F.col("left")
    drawn = (over <= 0) | ((over < F.col("size")) & (over < F.col("size") - over))
    crossing = crossing.withColumn("more", F.when(drawn, 1).otherwise(0)).drop("sum")
    rest = joined.filter(~F.col("crosses")).withColumn("more", F.when(F.col("whole"), 1).otherwise(0))
    return crossing.unionByName(rest).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"), *more)


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each row as often as it is taken.

    Rows are told apart by all their columns, so rows of one doc_id and rows without one are each drawn for themselves.
    Rows that are equal in every column are as good as one another: together they are taken as often as their sum."""
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    column = {c: F.col(f"c{i}") for i, c in enumerate(cols)}
    told = [row_hash(own).alias("_row"), F.md5(F.concat_ws("|", column["source"].cast("string"), text_col(f"c{cols.index('text')}"))).alias("_digest")]
    rows = own.select("*", *told)
    drawn = _mixed(rows.select(column["doc_id"].alias("doc_id"), column["source"].alias("source"), column["text"].alias("text"), "_row", "_digest"), "_row", "_digest")
    times = drawn.filter("taken > 0").groupBy("_row", "_digest").agg(F.sum(F.col("taken") / F.col("size")).cast("bigint").alias("_times"))
    hit = rows.dropDuplicates(["_row", "_digest"]).join(times, ["_row", "_digest"])
    out = hit.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '')) AS size FROM documents),
k AS (SELECT doc_id, source, size,
  -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(t)) || '|{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(_STEP)})
  / (0.2::DOUBLE + 0.8::DOUBLE * (least(size, {FULL_WORDS}) / {float(FULL_WORDS)}::DOUBLE)
  * (1.0::DOUBLE - least(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')), size) / greatest(size, 1)::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM k GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
  coalesce(sum(3 * source_size) OVER a, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER a, 0) AS w_from FROM s
  WINDOW a AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * w_from <= (total - cap_before) * w AS capped FROM o),
f AS (SELECT *, total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS free, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS w_free FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w::DOUBLE * free::DOUBLE / w_free::DOUBLE END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS budget,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN run <= budget
  OR (run - budget < size AND run - budget < size - (run - budget)) THEN 1 ELSE 0 END) AS taken FROM r
"""
