"""Exports: pattern listings and the text formats of other miners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_lines(patterns: DataFrame) -> DataFrame:
    """The listing's line of each pattern (``edges`` array of structs, ``support``), built by column functions."""
    one = lambda e: F.format_string("Edge (%d, %d, %d, %d, %d, %d)  %s ", e["i"], e["j"], e["il"], e["el"], e["jl"], e["d"], F.when(e["i"] < e["j"], "F").otherwise("B"))
    return patterns.select(F.format_string("FrequentGraph (DFSCode (%s), freq %d)", F.array_join(F.transform("edges", one), ","), F.col("support")).alias("value"))


def write_patterns(patterns: DataFrame, path: str, form: str = "parquet") -> None:
    if form == "text":
        pattern_lines(patterns).write.mode("overwrite").text(path)
    else:
        patterns.write.mode("overwrite").format(form).save(path)


def vertices(adj: DataFrame) -> DataFrame:
    """``id, label`` of all vertices; a vertex with several labels has its least one."""
    return adj.groupBy(F.col("src").alias("id")).agg(F.min("src_label").alias("label"))


def dense_ids(adj: DataFrame) -> DataFrame:
    """``id, dense``: ids in order from 0, by counts of fixed id ranges, so that no window spans all vertices."""
    from pyspark.sql import Window as W

    ids = adj.select(F.col("src").alias("id")).distinct().withColumn("slice", F.floor(F.col("id") / 65536))
    counts = ids.groupBy("slice").agg(F.count("*").alias("n"))
    before = counts.select("slice", (F.sum("n").over(W.orderBy("slice")) - F.col("n")).alias("before"))
    return ids.join(before, "slice").select("id", (F.col("before") + F.row_number().over(W.partitionBy("slice").orderBy("id")) - 1).alias("dense"))


def neighbour_lines(adj: DataFrame) -> DataFrame:
    """``dense`` and ``value``: id, label and sorted neighbours by dense ids, one line for each vertex."""
    dense = dense_ids(adj)
    a = dense.select(F.col("id").alias("src"), F.col("dense").alias("a"))
    b = dense.select(F.col("id").alias("dst"), F.col("dense").alias("b"))
    near = adj.select("src", "dst").distinct().join(a, "src").join(b, "dst").groupBy("src", "a").agg(F.array_sort(F.collect_list("b")).alias("near"))
    rows = near.join(vertices(adj), near["src"] == F.col("id"))
    return rows.select(F.col("a").alias("dense"), F.concat_ws(" ", F.col("a").cast("string"), F.col("label").cast("string"), F.array_join(F.transform("near", lambda x: x.cast("string")), " ")).alias("value"))


def vertex_lines(adj: DataFrame) -> DataFrame:
    return vertices(adj).select("id", F.format_string("v %d %d", "id", "label").alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("e %d %d 1", "dst", "src").alias("value"))


def write_lines(lines: DataFrame, path: str, order: str | None = None) -> None:
    (lines.orderBy(order) if order else lines).select("value").write.mode("overwrite").text(path)
