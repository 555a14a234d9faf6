"""The given tables as the domain's frames: events as facts, line items as calls, orders as deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import table


def facts(spark: SparkSession, d: str) -> DataFrame:
    """events as facts."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("event_time"), "user_id", F.col("event_type").alias("method"), F.col("value").cast("decimal(20,6)").alias("quantity"), "props"
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as calls of a release (its order)."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("row_id"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(20,6)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(20,6)").alias("price"), F.col("l_discount").cast("decimal(20,6)").alias("discount"), "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("event_time"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus").alias("line_id"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(20,6)").alias("total"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderpriority"
    )
