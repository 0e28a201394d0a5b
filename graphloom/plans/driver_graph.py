"""The property graph that the star-schema tables are projected to, in Spark and in SQL.

regions, nations, customers, suppliers, parts and orders are nodes; foreign keys are edges: defines (region to nation
to customer and supplier), calls (customer to order to part to supplier), tests (urgent order to part), and
data_flow from the user of an error event to the user of the next one in its day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.joins import dealt


class Tables:
    """Lazily read tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._rows: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, name: str) -> int:
        """Rows of a table, which its files' footers tell."""
        if name not in self._rows:
            self._rows[name] = getattr(self, name).count()
        return self._rows[name]


def _id(label: str, key: str):
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def _node(df: DataFrame, label: str, key: str, name, qualified, path, repo, start=None, lines=None) -> DataFrame:
    start = F.lit(0) if start is None else start
    end = F.lit(0) if lines is None else start + lines
    return df.select(_id(label, key).alias("node_id"), F.lit(label).alias("label"), name.alias("name"), qualified.alias("qualified"), path.alias("file_path"), repo.alias("repo_slug"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def nodes(t: Tables) -> DataFrame:
    r, n = t.region, t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    place = n.select("n_nationkey", "n_name", "r_name")
    c = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t.supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    dot, slash = (lambda *x: F.concat_ws(".", *x)), (lambda *x: F.concat_ws("/", *x))
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    return reduce(DataFrame.unionByName, [
        _node(r, "region", "r_regionkey", F.col("r_name"), F.col("r_name"), F.col("r_name"), F.col("r_name")),
        _node(n, "nation", "n_nationkey", F.col("n_name"), dot("r_name", "n_name"), slash("r_name", "n_name"), F.col("r_name")),
        _node(c, "customer", "c_custkey", F.col("c_name"), dot("r_name", "n_name", "c_name"), slash("r_name", "n_name"), F.col("r_name"), F.col("c_custkey") % 500 + 1, F.col("c_custkey") % 37),
        _node(s, "supplier", "s_suppkey", F.col("s_name"), dot("r_name", "n_name", "s_name"), slash("r_name", "n_name"), F.col("r_name"), F.col("s_suppkey") % 500 + 1, F.col("s_suppkey") % 37),
        _node(t.part, "part", "p_partkey", F.col("p_name"), dot(F.lit("parts"), brand, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))), slash(F.lit("parts"), brand), F.lit("parts"), F.col("p_partkey") % 500 + 1, F.col("p_size")),
        _node(t.orders, "orders", "o_orderkey", F.concat(F.lit("O"), F.col("o_orderkey").cast("string")), dot(F.lit("orders"), "o_orderstatus", F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))), slash(F.lit("orders"), "o_orderstatus"), F.lit("orders")),
    ])


def _edge(df: DataFrame, label: str, a: str, ka: str, b: str, kb: str, distinct_of: int | None = None) -> DataFrame:
    """Edges between the keys of ``df``; each once where ``distinct_of`` says how many rows it has at most."""
    keys = df.select(ka, kb)
    if distinct_of is not None:  # repeats go while the keys are numbers
        keys = dealt(keys, distinct_of, ka, kb).distinct()
    out = keys.select(F.lit(label).alias("label"), _id(a, ka).alias("from_id"), _id(b, kb).alias("to_id"))
    return out.withColumn("call_site", F.concat("from_id", F.lit(":"), F.lit("1")))


def calls(t: Tables) -> DataFrame:
    li = t.lineitem
    return reduce(DataFrame.unionByName, [
        _edge(t.orders, "calls", "customer", "o_custkey", "orders", "o_orderkey"), _edge(li, "calls", "orders", "l_orderkey", "part", "l_partkey", t.rows("lineitem")), _edge(li, "calls", "part", "l_partkey", "supplier", "l_suppkey", t.rows("lineitem")),
    ])


def defines(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        _edge(t.nation, "defines", "region", "n_regionkey", "nation", "n_nationkey"), _edge(t.customer, "defines", "nation", "c_nationkey", "customer", "c_custkey"), _edge(t.supplier, "defines", "nation", "s_nationkey", "supplier", "s_suppkey"),
    ])


def tests(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return _edge(t.lineitem.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi"), "tests", "orders", "l_orderkey", "part", "l_partkey", t.rows("lineitem"))


def flows(t: Tables) -> DataFrame:
    """data_flow edges with props; an event's day bounds the window."""
    e = t.events.where("event_type = 'error'")
    w = W.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    nxt = e.select("event_id", "ts", "user_id", "value", F.lead("user_id").over(w).alias("to_user")).where("to_user is not null")
    kind = F.when(F.col("value") > 120, "overwrite")
    props = F.map_filter(F.create_map(F.lit("field_path"), F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")), F.lit("arg_expr"), F.lit("value"), F.lit("mutation_type"), kind), lambda k, v: v.isNotNull())
    return nxt.select(F.lit("data_flow").alias("label"), _id("user", "user_id").alias("from_id"), F.concat(F.lit("user:"), F.col("to_user").cast("string")).alias("to_id"), F.lit(None).cast("string").alias("call_site"), props.alias("props"))


#: the same graph for the SQL side
SQL = """
place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'region:' || r_regionkey AS node_id, 'region' AS label, r_name AS name, r_name AS qualified, r_name AS file_path, r_name AS repo_slug, 0 AS start_line, 0 AS end_line FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, r_name || '.' || n_name, r_name || '/' || n_name, r_name, 0, 0 FROM place
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, r_name || '.' || n_name || '.' || c_name, r_name || '/' || n_name, r_name, CAST(c_custkey % 500 + 1 AS INTEGER), CAST(c_custkey % 500 + 1 + c_custkey % 37 AS INTEGER) FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, r_name || '.' || n_name || '.' || s_name, r_name || '/' || n_name, r_name, CAST(s_suppkey % 500 + 1 AS INTEGER), CAST(s_suppkey % 500 + 1 + s_suppkey % 37 AS INTEGER) FROM supplier JOIN place ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'parts.' || replace(p_brand, '#', '') || '.P' || p_partkey, 'parts/' || replace(p_brand, '#', ''), 'parts', CAST(p_partkey % 500 + 1 AS INTEGER), CAST(p_partkey % 500 + 1 + p_size AS INTEGER) FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'orders', 'O' || o_orderkey, 'orders.' || o_orderstatus || '.O' || o_orderkey, 'orders/' || o_orderstatus, 'orders', 0, 0 FROM orders
),
calls AS (
  SELECT 'customer:' || o_custkey AS from_id, 'orders:' || o_orderkey AS to_id FROM orders
  UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem
),
defines AS (
  SELECT 'region:' || n_regionkey AS from_id, 'nation:' || n_nationkey AS to_id FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
),
tests AS (SELECT DISTINCT 'orders:' || l_orderkey AS from_id, 'part:' || l_partkey AS to_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')),
flows AS (
  SELECT 'user:' || user_id AS from_id, 'user:' || to_user AS to_id, 'f' || event_id % 5 AS field_path, CASE WHEN value > 120 THEN 'overwrite' END AS mutation_type
  FROM (SELECT *, lead(user_id) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) AS to_user FROM events WHERE event_type = 'error') WHERE to_user IS NOT NULL
)"""
