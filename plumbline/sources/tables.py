"""Point sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(id, x, y): quantity and price; the id joins the columns that together are unique. ``where`` is over the table."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    ident = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), cents)
    return table(spark, sf_dir, "lineitem").filter(where).select(ident.alias("id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


LINEITEM_SQL = "li AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, l_quantity AS x, l_extendedprice AS y FROM lineitem)"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


PART_SQL = "pt AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): total price and day number."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.datediff("o_orderdate", F.lit("1970-01-01")).cast("double").alias("y"))


ORDERS_SQL = "od AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y FROM orders)"


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y): quantity and discount, with many equal points."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))


DUPLICATES_SQL = "du AS (SELECT l_quantity AS x, l_discount AS y FROM lineitem)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, day, x, y): day from the first of 2024, user and value."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.datediff("ts", F.lit("2024-01-01")).alias("day"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))


EVENTS_SQL = "ev AS (SELECT event_id AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, CAST(user_id AS DOUBLE) AS x, value AS y FROM events)"
