"""The driver tables seen as code lists, variables, pairs and registries, in Spark and in SQL.

Each view has a function over (spark, sf_dir) and SQL of the same name in ``SQL``.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_codes(spark, sf):
    """Orders as lists; suppliers of their lines as codes."""
    return read(spark, sf, "lineitem").join(read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").cast("string").alias("value"), F.lower("s_name").alias("label")
    )


def flag_codes(spark, sf):
    """Orders as lists; return flag and line status of their lines as codes."""
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), F.lower("l_returnflag").alias("value"), F.lower("l_linestatus").alias("label")
    )


def orders(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("list_id")).distinct().withColumn("ord", F.col("list_id"))


def customer_codes(spark, sf):
    """Customers as lists; priority and status of their orders as codes."""
    return read(spark, sf, "orders").select(
        F.col("o_custkey").alias("list_id"), F.lower(F.concat(F.substring("o_orderpriority", 1, 1), "o_orderstatus")).alias("value"), F.lower("o_orderpriority").alias("label")
    ).distinct()


def customers(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("list_id"), F.col("c_custkey").alias("ord"), F.substring("c_mktsegment", 1, 2).alias("name"), F.col("c_name").alias("label"))


def order_variables(spark, sf):
    """Part brands of an order's lines as the variables that use it."""
    return read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("id"), F.col("l_linenumber").alias("ord"), F.col("p_brand").alias("name"), F.col("l_orderkey").alias("cl_id")
    )


def part_codes(spark, sf):
    """Brand and type as lists, parts as codes and categories; escape labels and references planted by size."""
    size = F.col("p_size") % 10
    return read(spark, sf, "part").select(
        F.concat_ws("|", "p_brand", "p_type").alias("list_id"),
        F.col("p_partkey").alias("pos"),
        F.when(size == 1, "_z").otherwise(F.col("p_size").cast("string")).alias("value"),
        F.when(size == 1, "sans objet").when(size == 2, "non concerné par ceci").when((size == 3) & (F.col("p_partkey") % 7 == 0), "voir dictionnaire").otherwise(F.lower("p_name")).alias("label"),
        F.col("p_partkey").alias("cat_id"),
    )


def part_lists(spark, sf):
    return part_codes(spark, sf).groupBy("list_id").agg(F.min("pos").alias("ord"))


def user_versions(spark, sf):
    """Events as versions of users: text of ``k``, missing for purchases."""
    return read(spark, sf, "events").select(
        F.col("user_id").alias("list_id"),
        F.col("event_id").alias("ord"),
        F.when(F.col("event_type") != "purchase", F.get_json_object("props", "$.k")).alias("version"),
        F.col("event_type").alias("name"),
    )


SQL = {
    "order_codes": "SELECT l_orderkey AS list_id, l_linenumber AS pos, CAST(l_suppkey AS VARCHAR) AS value, lower(s_name) AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "flag_codes": "SELECT l_orderkey AS list_id, l_linenumber AS pos, lower(l_returnflag) AS value, lower(l_linestatus) AS label FROM lineitem",
    "orders_": "SELECT DISTINCT l_orderkey AS list_id, l_orderkey AS ord FROM lineitem",
    "customer_codes": "SELECT DISTINCT o_custkey AS list_id, lower(substr(o_orderpriority, 1, 1) || o_orderstatus) AS value, lower(o_orderpriority) AS label FROM orders",
    "customers": "SELECT c_custkey AS list_id, c_custkey AS ord, substr(c_mktsegment, 1, 2) AS name, c_name AS label FROM customer",
    "order_variables": "SELECT p_partkey AS id, l_linenumber AS ord, p_brand AS name, l_orderkey AS cl_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "part_codes": """SELECT p_brand || '|' || p_type AS list_id, p_partkey AS pos,
        CASE WHEN p_size % 10 = 1 THEN '_z' ELSE CAST(p_size AS VARCHAR) END AS value,
        CASE WHEN p_size % 10 = 1 THEN 'sans objet' WHEN p_size % 10 = 2 THEN 'non concerné par ceci'
          WHEN p_size % 10 = 3 AND p_partkey % 7 = 0 THEN 'voir dictionnaire' ELSE lower(p_name) END AS label, p_partkey AS cat_id FROM part""",
    "user_versions": """SELECT user_id AS list_id, event_id AS ord,
        CASE WHEN event_type <> 'purchase' THEN json_extract_string(props, '$.k') END AS version, event_type AS name FROM events""",
}


def sql(*views: str, then: str) -> str:
    """``then`` behind the named views as common table expressions."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " + then
