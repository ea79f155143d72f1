"""Panels from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.readers import read_table


def supplier_year(spark: SparkSession, sf_dir: str, sizes: bool = False) -> DataFrame:
    """id, time, y, x1, z1, w1: revenue, quantity, discount and tax of each supplier and year; sizes: also x2, the parts' mean size.

    Only x2 needs the parts; they meet the sums of supplier, year and part, not the single lines.
    """
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").alias("time"), "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    y, x1, z1, w1 = F.log(F.sum("l_extendedprice")).alias("y"), F.log(F.sum("l_quantity")).alias("x1"), F.avg("l_discount").alias("z1"), F.avg("l_tax").alias("w1")
    panel = lines.groupBy("id", "time").agg(y, x1, z1, w1)
    if not sizes:
        return panel
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    sold = lines.groupBy("id", "time", "l_partkey").agg(F.count("*").alias("n")).join(parts, "l_partkey")
    means = sold.groupBy("id", "time").agg(F.log(F.sum(F.col("n") * F.col("p_size")) / F.sum("n")).alias("x2"))
    return panel.join(means, ["id", "time"]).select("id", "time", "y", "x1", "x2", "z1", "w1")


def customer_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, time, y, x1 of each customer and year with orders: logs of their value and number; unbalanced."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("time")).agg(F.log(F.sum("o_totalprice")).alias("y"), F.log(F.count("*")).alias("x1"))


#: The panels in SQL, as the start of a WITH clause.
SUPPLIER_YEAR_SQL = """sy AS (
  SELECT l_suppkey AS id, year(l_shipdate)::INTEGER AS time, ln(sum(l_extendedprice)) AS y, ln(sum(l_quantity)) AS x1, ln(avg(p_size)) AS x2,
    avg(l_discount) AS z1, avg(l_tax) AS w1
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
CUSTOMER_YEAR_SQL = """cy AS (
  SELECT o_custkey AS id, year(o_orderdate)::INTEGER AS time, ln(sum(o_totalprice)) AS y, ln(count(*)) AS x1 FROM orders GROUP BY ALL)"""
