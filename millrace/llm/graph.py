"""Hot keys dealt out, and components of a graph, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

SALTS = 16


def part_of(by: Column) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def parts(by: Column) -> Column:
    """The parts that a key's rows lie in, as bits; an aggregate."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), part_of(by))).alias("_parts")


def each_part(few: DataFrame) -> DataFrame:
    """few (with `_parts`), each row once for every part that its key has rows in, as `_salt`."""
    has = lambda i: F.col("_parts").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0
    return few.withColumn("_salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), has))).drop("_parts")


def salted(many: DataFrame, few: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """many joined with few (one row per key, with `_parts`): a key stands in each part that it has rows in, SALTS at most,
    so a hot key is dealt out and a rare one is hardly repeated."""
    return many.withColumn("_salt", part_of(by)).join(each_part(few), [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(doc, comp): the smallest doc reachable over edges (a > b), for every doc in an edge that is not the smallest itself."""
    now, seen = written(edges.filter("a <> b").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("a").alias("doc"), F.col("b").alias("comp"))
        seen = state
        # Large star: all larger neighbours of u go to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), parts(F.col("b"))).withColumn("m", F.least("a", "m"))
        large = salted(both, least, "a", F.col("b")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"), parts(F.col("b")))
        small = salted(large, least, "a", F.col("b"))
        now = small.select(F.inline(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a > b").distinct()
        now = written(now, "edges")
