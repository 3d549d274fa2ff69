"""Reading of the driver's tables, and the listing view that many queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.operators.lookup import dimension

QUERIES: dict = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as listings: price, surface, unit price, nation as region, order date as publication."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = o.join(c.join(dimension(n), c.c_nationkey == n.n_nationkey), o.o_custkey == c.c_custkey)  # so that line items are shuffled once, by order
    df = li.join(o, li.l_orderkey == o.o_orderkey)
    return df.select("l_orderkey", "l_linenumber", "l_returnflag", "c_mktsegment", F.col("n_name").alias("nation"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("surface"), F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"), F.col("o_orderdate").alias("published"))


#: The same view in SQL.
LISTINGS = """listings AS (SELECT l_orderkey, l_linenumber, l_returnflag, c_mktsegment, n_name AS nation, l_extendedprice AS price, l_quantity AS surface,
 l_extendedprice / nullif(l_quantity, 0) AS unit_price, o_orderdate AS published
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
