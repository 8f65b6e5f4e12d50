"""Importers of other systems' graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_pairs(pairs: DataFrame, groups: int, std_dev: float | None = None, seed: int = 0) -> DataFrame:
    """Edges from (src, dst) pairs without labels: one edge for each unordered pair, edge label 0.

    A vertex's label is 1 to ``groups``: by a function of its id, or half-Gaussian with ``std_dev`` (in groups) and ``seed``,
    where the id's hash gives the draw, so that a vertex has one label on any cluster.
    """

    def label(v: F.Column) -> F.Column:
        if std_dev is None:
            return (F.pmod(v * 7 + 3, F.lit(groups)) + 1).cast("int")
        unit = lambda k: (F.pmod(F.xxhash64(v, F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 1) / float(1 << 40)
        draw = F.abs(F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2)) * std_dev)
        return (F.least(F.floor(draw), F.lit(groups - 1)) + 1).cast("int")

    one = pairs.where("src is not null and dst is not null").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).distinct()
    return one.select("src", label(F.col("src")).alias("src_label"), F.lit(0).alias("edge_label"), "dst", label(F.col("dst")).alias("dst_label"))


def read_edge_csv(spark, path: str, groups: int, std_dev: float | None = None) -> DataFrame:
    return edge_pairs(spark.read.schema("src long, dst long").csv(path), groups, std_dev)


def profile_records(lines: DataFrame) -> DataFrame:
    """``uid, label`` of blank-separated profile records (column ``value`` is one record): first and third line, ``#`` lines left out."""
    kept = F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & (F.length(F.trim(x)) > 0))
    return lines.select(kept.alias("k")).where(F.size("k") >= 3).select(F.trim(F.col("k")[0]).cast("long").alias("uid"), F.trim(F.col("k")[2]).cast("int").alias("label"))


def profile_network(positions: DataFrame, profiles: DataFrame, network: DataFrame) -> DataFrame:
    """Edges of a follower network: ``positions(vertex, uid)``, ``profiles(uid, label)``, ``network(v, nbr, kind)``.

    A pair is kept if it is one-sided (kind 0) or seen from its lesser end, and if both ends have a label; edge label 0.
    """
    label = positions.join(profiles, "uid").select("vertex", "label")
    kept = network.where("kind = 0 or v < nbr")
    a = label.select(F.col("vertex").alias("v"), F.col("label").alias("src_label"))
    b = label.select(F.col("vertex").alias("nbr"), F.col("label").alias("dst_label"))
    return kept.join(a, "v").join(b, "nbr").select(F.col("v").alias("src"), "src_label", F.lit(0).alias("edge_label"), F.col("nbr").alias("dst"), "dst_label").distinct()


def parse_network(lines: DataFrame) -> DataFrame:
    """``v, nbr, kind`` from lines ``v n {nbr kind}`` (column ``value``); a head line of two fields has no pairs."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 4)
    many = rows.select(F.col("p")[0].cast("long").alias("v"), "p", F.explode(F.sequence(F.lit(3), F.size("p") - 1, F.lit(2))).alias("k"))
    return many.select("v", F.element_at("p", F.col("k")).cast("long").alias("nbr"), F.element_at("p", F.col("k") + 1).cast("int").alias("kind"))
