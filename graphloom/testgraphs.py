"""Graphs over the relational test tables, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph

OTHER = 1_000_000_000  #: offset of the second kind of nodes in graphs of two kinds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, sparse: bool = False, directed: bool = True) -> Graph:
    """Nations; an edge from each supplier nation to each customer nation with the number of line items.

    ``sparse``: only edges of more than average weight.
    """
    t = lambda n: table(spark, sf_dir, n)
    nodes = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = nodes.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("regionkey"), F.col("r_name").alias("region"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    items = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("weight"))
    edges = pairs.select((F.col("src") * 1000 + F.col("dst")).alias("id"), "src", "dst", "weight")
    if sparse:
        edges = edges.crossJoin(F.broadcast(edges.agg(F.avg("weight").alias("mean")))).where("weight > mean").drop("mean")  # one row
    return Graph(nodes, edges, directed)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers and parts, an undirected edge for each line item."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + OTHER).alias("id"), F.lit("part").alias("kind"))
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + OTHER).alias("dst"), F.col("l_quantity").alias("quantity"))
    return Graph(suppliers.unionByName(parts), items, False)


def cust_order(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and their orders, undirected."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") + OTHER).alias("dst"))
    return Graph(customers.unionByName(orders.select((F.col("o_orderkey") + OTHER).alias("id"))), edges, False)


def convo(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations, each with an edge to the next one."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role").dropDuplicates(["id"])
    following = turns.select((F.col("id") - 1).alias("id"), F.col("id").alias("dst"))
    return Graph(turns, turns.select("id").join(following, "id").select("id", F.col("id").alias("src"), "dst"), True)


def vectors(spark: SparkSession, sf_dir: str) -> Graph:
    """Embeddings as nodes without edges."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return Graph(nodes, Graph.empty(spark).edges, True)


TRADE = """n as (select n_nationkey::bigint as id, n_name as name, n_regionkey as regionkey, r_name as region from nation join region on n_regionkey = r_regionkey),
te as (select s_nationkey::bigint as src, c_nationkey::bigint as dst, count(*)::bigint as weight from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2),
e as (select src * 1000 + dst as id, src, dst, weight from te),
p as (select * from e where weight > (select avg(weight) from e)),
adj as (select src as node, dst as nbr, id as edge, weight as w from p union all select dst, src, id, weight from p)"""

SUPPLY = f"""sn as (select s_suppkey::bigint as id, 'supplier' as kind from supplier union all select p_partkey + {OTHER}, 'part' from part),
se as (select l_orderkey * 10 + l_linenumber as id, l_suppkey::bigint as src, l_partkey + {OTHER} as dst, l_quantity as quantity from lineitem),
sadj as (select src as node, dst as nbr, id as edge, quantity as w from se union all select dst, src, id, quantity from se)"""

CONVO = """cn as (select distinct conv_id * 1000 + turn as id from conversations),
ce as (select a.id, a.id as src, b.id as dst from cn a join cn b on b.id = a.id + 1)"""
