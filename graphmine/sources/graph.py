"""The graph model: ``adj(src, src_label, edge_label, dst, dst_label, dir)``, each edge seen from both its ends.

``dir`` is 0 for undirected edges; a directed edge is 1 (out) at its source and -1 (in) at its target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDGE = ["src", "src_label", "edge_label", "dst", "dst_label"]
TYPE = ["src_label", "edge_label", "dst_label", "dir"]


def edges(df: DataFrame, allow_self_loops: bool = False) -> DataFrame:
    """Distinct edges with the model's types; rows with a null are no edges; self-loops are dropped unless asked for."""
    some = df.select(F.col("src").cast("long"), F.col("src_label").cast("int"), F.col("edge_label").cast("int"), F.col("dst").cast("long"), F.col("dst_label").cast("int")).dropna()
    return (some if allow_self_loops else some.where("src <> dst")).distinct()


def adjacency(df: DataFrame, directed: bool = False, allow_self_loops: bool = False, listed_once: bool = False) -> DataFrame:
    """Both views of every edge.  Undirected edges that are listed in both directions are one edge.

    ``listed_once`` says that ``df`` comes from ``trade_edges`` or a like source: distinct edges of the model's types, no self-loops, none in both directions.
    """
    one = df if listed_once else edges(df, allow_self_loops)
    back = one.select(F.col("dst").alias("src"), F.col("dst_label").alias("src_label"), "edge_label", F.col("src").alias("dst"), F.col("src_label").alias("dst_label"))
    if directed:
        return one.withColumn("dir", F.lit(1).cast("byte")).unionByName(back.withColumn("dir", F.lit(-1).cast("byte")))
    both = one.unionByName(back)
    return (both if listed_once else both.distinct()).withColumn("dir", F.lit(0).cast("byte"))


def parse_adjacency(lines: DataFrame) -> DataFrame:
    """Edges from lines ``src, src_label, {dst, dst_label, edge_label}`` (tab-separated, column ``value``).

    Lines of fewer than three fields (isolated vertices) hold no edge; a field that is no integer is an error.
    """
    parts = F.split("value", "\t")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 3)
    many = rows.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("int").alias("src_label"), "p", F.explode(F.sequence(F.lit(2), F.size("p") - 1, F.lit(3))).alias("k"))
    at = lambda n: F.try_element_at("p", (F.col("k") + n + 1).cast("int"))
    return many.select("src", "src_label", at(2).cast("int").alias("edge_label"), at(0).cast("long").alias("dst"), at(1).cast("int").alias("dst_label"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return parse_adjacency(spark.read.text(path))


def format_adjacency(df: DataFrame) -> DataFrame:
    """Lines of the adjacency text, one for each source vertex and label."""
    triple = F.concat_ws("\t", F.col("dst").cast("string"), F.col("dst_label").cast("string"), F.col("edge_label").cast("string"))
    return df.groupBy("src", "src_label").agg(F.array_sort(F.collect_list(triple)).alias("t")).select(F.concat_ws("\t", F.col("src").cast("string"), F.col("src_label").cast("string"), F.array_join("t", "\t")).alias("value"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EDGE)


def incident_lists(adj: DataFrame) -> DataFrame:
    """Per vertex its incident edges as a sorted list of structs."""
    return adj.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "src_label", "edge_label", "dst_label", "dir"))).alias("incident"))


def label_ids(df: DataFrame, column: str, first: int) -> DataFrame:
    """Dictionary ``value, label`` of a column's distinct values in order, from ``first`` on.

    A value's rank is the number of values in the slices (first two characters) before its own and its place there.
    """
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct().withColumn("slice", F.substring("value", 1, 2))
    counts = values.groupBy("slice").agg(F.count("*").alias("n"))
    before = counts.select("slice", (F.sum("n").over(W.orderBy("slice")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("slice").orderBy("value"))
    return values.withColumn("place", place).join(before, "slice").select("value", (F.col("before") + F.col("place") + F.lit(first - 1)).cast("int").alias("label"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(df: DataFrame, value: str, first: int, id_expr: str, prefix: str) -> DataFrame:
    ids = label_ids(df, value, first)
    return df.join(ids, df[value] == ids["value"]).select(*[c for c in df.columns], F.expr(id_expr).alias(f"{prefix}"), F.col("label").alias(f"{prefix}_label"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and parts: 1 customer-order, 2 order-part, 3 customer-part."""
    customer = _labelled(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 101, "3 * c_custkey", "c")
    orders = _labelled(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus", 201, "3 * o_orderkey + 1", "o")
    part = _labelled(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", 301, "3 * p_partkey + 2", "p")
    # dealt by one key, rows are made distinct on it without another shuffle
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    placed = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    bought = lines.join(placed, lines["l_orderkey"] == placed["o_orderkey"]).select("l_partkey", "c", "c_label", "o", "o_label").repartition("l_partkey").join(part, F.col("l_partkey") == part["p_partkey"])
    own = ["l_partkey", "p", "p_label"]
    pick = lambda df, s, e, d: df.select(F.col(s).alias("src"), F.col(s + "_label").alias("src_label"), F.lit(e).alias("edge_label"), F.col(d).alias("dst"), F.col(d + "_label").alias("dst_label"))
    kinds = [pick(placed.select("c", "c_label", "o", "o_label").distinct(), "c", 1, "o"), pick(bought.select(*own, "o", "o_label").distinct(), "o", 2, "p"), pick(bought.select(*own, "c", "c_label").distinct(), "c", 3, "p")]
    return reduce(DataFrame.unionByName, [k.select(F.col("src").cast("long"), "src_label", "edge_label", F.col("dst").cast("long"), "dst_label").dropna() for k in kinds])


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each event to its user's next one (edge label 1)."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    named = _labelled(events, "event_type", 1, "event_id", "v")
    nxt = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = named.select("v", "v_label", F.lead("v").over(nxt).alias("dst"), F.lead("v_label").over(nxt).alias("dst_label"))
    return edges(rows.select(F.col("v").alias("src"), F.col("v_label").alias("src_label"), F.lit(1).alias("edge_label"), "dst", "dst_label"))


def flag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts with one edge for each return flag; some pairs have several."""
    orders = _labelled(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 201, "3 * o_orderkey + 1", "o")
    part = _labelled(_table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", 301, "3 * p_partkey + 2", "p")
    lines = _labelled(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), "l_returnflag", 1, "l_orderkey", "f")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
    return edges(rows.select(F.col("o").alias("src"), F.col("o_label").alias("src_label"), F.col("f_label").alias("edge_label"), F.col("p").alias("dst"), F.col("p_label").alias("dst_label")))
