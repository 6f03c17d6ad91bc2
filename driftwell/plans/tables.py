"""The driver's tables in the roles of the domain: which rows are commits, findings, paths, branches and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dealing import dealt_by
from ..operators.diffs import consecutive_sides, finding_changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of versions: a user's active day is a version, an event type of that day an ident."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("ident"))
    return events.distinct()


def user_day_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, ident, side): idents that a user's active day lost or won against the one before."""
    sides = consecutive_sides(user_days(spark, sf_dir), ["user_id"], "day")
    return finding_changes(sides, ["user_id", "day"], ["ident"])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the brand of their part: an order is a commit, a brand a rule, brand and flag a template line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(parts, "l_partkey")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of branches: an order is a commit, a supplier a branch, a line item a file, return flag R a finding left.

    Flag A counts as absent; so a supplier's part of an order has a gap, is fixed, or wasn't applicable.
    """
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "absent").when(F.col("l_quantity") <= 2, "scan_failed").otherwise("ok")
    left = F.when(F.col("l_returnflag") == "R", F.array(F.concat(F.lit("R-"), "l_linestatus"))).otherwise(F.array().cast("array<string>"))
    return lines.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), status.alias("file_status"), left.alias("idents_present"))


def shipping_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags of back-ports: from an order's date to the shipping of its line items."""
    from ..functions.columns import days_between

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    lines, orders = dealt_by("l_orderkey", lines, orders)
    return lines.join(orders, "l_orderkey").select("l_orderkey", "l_suppkey", days_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("lag_days"))
