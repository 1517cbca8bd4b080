"""The plain relational surface over the star schema: joins, set operations, grouping sets, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days_in_both(s, d):
    """Days with orders and with line items shipped."""
    o = read(s, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"))
    return o.intersect(read(s, d, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day")))


def days_only_orders(s, d):
    o = read(s, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"))
    return o.exceptAll(read(s, d, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day"))).distinct()


def union_counts(s, d):
    kinds = [read(s, d, n).select(F.lit(n).alias("kind"), F.col(c).alias("nation")) for n, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return kinds[0].unionByName(kinds[1]).groupBy("kind", "nation").count().withColumnRenamed("count", "n")


def outer_columns(s, d):
    """Customers and suppliers by nation side by side, nations of either."""
    c = read(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    u = read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(u, "nation", "full")


def revenue_cube(s, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = read(s, d, "orders").select("o_orderstatus", "o_orderpriority", cents.alias("cents"))
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def top_customers(s, d):
    """The three largest customers of each nation by ordered cents; the order table joins its customers once aggregated."""
    spent = read(s, d, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    c = read(s, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey")).join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.col("cents").desc(), "c_custkey")
    return c.select("n_name", "c_custkey", "cents", F.row_number().over(w).alias("place")).where("place <= 3")


def idle_customers(s, d):
    return read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


QUERIES = {
    "set_intersect_days": (days_in_both, "SELECT CAST(o_orderdate::DATE AS VARCHAR) AS day FROM orders INTERSECT SELECT CAST(l_shipdate::DATE AS VARCHAR) FROM lineitem"),
    "set_except_days": (days_only_orders, "SELECT DISTINCT CAST(o_orderdate::DATE AS VARCHAR) AS day FROM (SELECT o_orderdate::DATE AS o_orderdate FROM orders EXCEPT ALL SELECT l_shipdate::DATE FROM lineitem)"),
    "set_union_counts": (union_counts, "SELECT kind, nation, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY 1, 2"),
    "set_outer_columns": (
        outer_columns,
        "SELECT nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) USING (nation)",
    ),
    "set_cube": (
        revenue_cube,
        "SELECT o_orderstatus, o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    ),
    "top_customers": (
        top_customers,
        """WITH c AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1)
SELECT n_name, c_custkey, cents, CAST(row_number() OVER (PARTITION BY n_name ORDER BY cents DESC, c_custkey) AS INTEGER) AS place FROM customer JOIN c ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey QUALIFY place <= 3""",
    ),
    "anti_idle_customers": (idle_customers, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
}
