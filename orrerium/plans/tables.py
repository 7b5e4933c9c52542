"""The driver's tables in the roles of a catalogue, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as hosts, their orders as members ordered by price; the balance stands for the star."""
    orders = table(spark, sf_dir, "orders")
    star = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") / 5000.0).alias("st_mass"))
    method = F.when(F.col("o_orderpriority").startswith("1"), "Transit").when(F.col("o_orderpriority").startswith("2"), "Transit").when(F.col("o_orderpriority").startswith("3"), "Radial Velocity").otherwise(F.col("o_orderpriority"))
    rows = orders.join(star, "o_custkey", "left")
    return rows.select(
        F.col("o_custkey").cast("string").alias("hostname"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("pl_name"),
        F.col("o_totalprice").alias("pl_orbper"),
        F.lit(None).cast("double").alias("pl_orbsmax"),
        "st_mass",
        F.col("st_mass").alias("st_rad"),
        method.alias("discoverymethod"),
        F.year("o_orderdate").cast("long").alias("disc_year"),
        (F.col("o_totalprice") / 1000.0).alias("pl_bmasse"),
        (F.col("o_orderkey") % 13 + 1).cast("double").alias("pl_rade"),
    )


CATALOG = """cat AS (SELECT CAST(o_custkey AS VARCHAR) AS hostname, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS pl_name, o_totalprice AS pl_orbper,
  c_acctbal / 5000.0 AS st_mass, c_acctbal / 5000.0 AS st_rad,
  CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'Transit' WHEN o_orderpriority LIKE '3%' THEN 'Radial Velocity' ELSE o_orderpriority END AS discoverymethod,
  CAST(year(o_orderdate) AS BIGINT) AS disc_year, o_totalprice / 1000.0 AS pl_bmasse, CAST(o_orderkey % 13 + 1 AS DOUBLE) AS pl_rade
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""
