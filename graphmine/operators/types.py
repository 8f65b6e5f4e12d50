"""Operators on edge types: the combinations of labels and direction that edges have."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmine.functions.pattern import EdgeType
from graphmine.operators import store
from graphmine.sources.graph import TYPE

#: Most frequent edge types that a search takes to the driver; labels are categories, so there are few.
MOST_TYPES = 1_000_000


def edge_type_support(adj: DataFrame) -> DataFrame:
    """``support`` of every edge type: the lesser of its numbers of distinct sources and targets."""
    return adj.groupBy(*TYPE).agg(F.least(F.count_distinct("src"), F.count_distinct("dst")).cast("long").alias("support"))


def edge_type_supports(adj: DataFrame, rows: int) -> dict[EdgeType, int]:
    """``edge_type_support`` on the driver, from one view of the edges: the targets of a type are the sources of its reverse.

    ``adj`` has ``rows`` rows and is read slice by slice.
    """
    found: Counter = Counter()
    with store.tidy(adj.sparkSession):
        for part in store.slices("src", rows):
            each = adj.where(part).select("src", *TYPE).distinct()
            counted = each.groupBy(*TYPE).agg(F.count("*")).limit(MOST_TYPES + 1).collect()
            found.update({EdgeType(*r[:4]): r[4] for r in counted})
            if len(found) > MOST_TYPES:
                raise ValueError(f"more than {MOST_TYPES} edge types")
    return {t: min(n, found[EdgeType(t.dst_label, t.edge_label, t.src_label, -t.d)]) for t, n in sorted(found.items())}


def frequent_edge_types(adj: DataFrame, min_support: int) -> DataFrame:
    return edge_type_support(adj).where(F.col("support") >= min_support)


def frequent_adjacency(adj: DataFrame, types: DataFrame) -> DataFrame:
    """The edges of the given types.  The table of types is small; Spark broadcasts it by its measured size."""
    return adj.join(types.select(*TYPE), TYPE, "left_semi").select(*adj.columns)


def canonical_seeds(types: DataFrame) -> DataFrame:
    """The types in the orientation that starts a canonical code."""
    return types.where((F.col("dir") == 1) | ((F.col("dir") == 0) & (F.col("src_label") <= F.col("dst_label"))))


def edges_of_type(adj: DataFrame, t: EdgeType) -> DataFrame:
    return adj.where((F.col("src_label") == t.src_label) & (F.col("edge_label") == t.edge_label) & (F.col("dst_label") == t.dst_label) & (F.col("dir") == t.d))


def sources_with_edge(adj: DataFrame, t: EdgeType) -> DataFrame:
    """Vertices that an edge of the type starts from."""
    return edges_of_type(adj, t).select(F.col("src").alias("vid")).distinct()


def extension_candidates(values: DataFrame, adj: DataFrame, min_support: int) -> DataFrame:
    """Edge types that at least ``min_support`` of the vertices in ``values`` (column ``vid``) start."""
    near = adj.join(values.select(F.col("vid").alias("src")).distinct(), "src", "left_semi")
    return near.groupBy(*TYPE).agg(F.count_distinct("src").cast("long").alias("sources")).where(F.col("sources") >= min_support)


def type_sources_intersection(adj: DataFrame, one: EdgeType, two: EdgeType) -> DataFrame:
    return sources_with_edge(adj, one).intersect(sources_with_edge(adj, two))


def type_sources_union(adj: DataFrame, one: EdgeType, two: EdgeType) -> DataFrame:
    return sources_with_edge(adj, one).union(sources_with_edge(adj, two)).distinct()


def type_sources_difference(adj: DataFrame, one: EdgeType, two: EdgeType) -> DataFrame:
    return sources_with_edge(adj, one).subtract(sources_with_edge(adj, two))


def collect_types(types: DataFrame) -> dict[EdgeType, int]:
    """Frequent types with their supports, on the driver."""
    rows = types.select(*TYPE, "support").limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} frequent edge types; raise min_support")
    return {EdgeType(*r[:4]): r[4] for r in sorted(rows)}
