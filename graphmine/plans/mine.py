"""Level-wise search for all frequent patterns.

A level's candidates are the canonical rightmost extensions of the frequent codes before it; candidates with one
skeleton are counted by one job.  The last level is counted without being materialised, and a discovery whose label is
new to its pattern without being enumerated; where the last level is the second, all its discoveries are.  The edges and the levels between
are written to the checkpoint folder where the session has one and cached otherwise.
"""

from __future__ import annotations

import logging
from collections import Counter, defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmine.functions.pattern import Code, EdgeType, extensions, orbits, seeds, text, vertex_labels
from graphmine.operators import match, store
from graphmine.operators.types import edge_type_supports, frequent_adjacency

log = logging.getLogger(__name__)
TYPE_ROW = "src_label int, edge_label int, dst_label int, dir byte"
PATTERN = "n_edges int, n_vertices int, code string, support long, edges array<struct<i:int,j:int,il:int,el:int,jl:int,d:int>>"


def one_label_each(adj: DataFrame, rows: int) -> bool:
    with store.tidy(adj.sparkSession):
        parts = (adj.where(part).groupBy("src").agg(F.min("src_label").alias("a"), F.max("src_label").alias("b")).where("a <> b") for part in store.slices("src", rows))
        return all(part.isEmpty() for part in parts)


def _one_view(adj: DataFrame) -> DataFrame:
    return adj.where("dir = 1 or dir = 0 and src <= dst")


def _both_views(one: DataFrame) -> DataFrame:
    back = one.where("dir <> 0 or src <> dst").select(F.col("dst").alias("src"), F.col("dst_label").alias("src_label"), "edge_label", F.col("src").alias("dst"), F.col("src_label").alias("dst_label"), (-F.col("dir")).cast("byte").alias("dir"))
    return one.unionByName(back)


def _wedge_types(child: Code) -> tuple[EdgeType, EdgeType]:
    """Types of the two edges of a wedge as its centre sees them."""
    one, two = child if child[1].i == 0 else (child[0].reversed(), child[1])
    return EdgeType(one.il, one.el, one.jl, one.d), EdgeType(two.il, two.el, two.jl, two.d)


def _wedges(edges: DataFrame, rows: int, level: dict[Code, int], types: dict[EdgeType, int], min_support: int) -> dict[Code, int] | None:
    """Frequent codes of two edges, if all are wedges and their types fit ``match.wedge_supports``."""
    pairs = {child: _wedge_types(child) for code in level for child in extensions(code, types) if child[1].forward}
    cycles = any(not child[1].forward for code in level for child in extensions(code, types))
    at = Counter(t.src_label for t in {t for pair in pairs.values() for t in pair})
    if cycles or max(at.values(), default=0) > match.MOST_BITS or not one_label_each(edges, rows):
        return None
    found = match.wedge_supports(edges, rows, pairs.values()) if pairs else {}
    return {child: found[pair] for child, pair in pairs.items() if found[pair] >= min_support}


def _skeleton(code: Code) -> tuple:
    return tuple((e.i, e.j, e.d) for e in code)


def one_edge_codes(types: dict[EdgeType, int]) -> dict[Code, int]:
    """Canonical one-edge codes with their supports."""
    return {c: types[EdgeType(c[0].il, c[0].el, c[0].jl, c[0].d)] for c in seeds(types)}


def mine_codes(adj: DataFrame, min_support: int, max_edges: int = 100, progress: Callable[[int, int], None] | None = None, one_view: bool = False) -> dict[Code, int]:
    """Every connected pattern of at most ``max_edges`` edges whose support is ``min_support`` or more.  With ``one_view``, ``adj`` has one view of every edge."""
    if min_support <= 0:
        raise ValueError("min_support must be positive")
    if max_edges < 1:
        raise ValueError("max_edges must be positive")
    spark = adj.sparkSession
    one = store.keep(adj if one_view else _one_view(adj))
    try:
        return _search(spark, one, min_support, max_edges, progress)
    finally:
        store.release(one)


def _search(spark: SparkSession, one: DataFrame, min_support: int, max_edges: int, progress: Callable[[int, int], None] | None) -> dict[Code, int]:
    """``mine_codes`` over one view of every edge."""
    rows = 2 * one.count()
    types = {t: n for t, n in edge_type_supports(_both_views(one), rows).items() if n >= min_support}
    found = one_edge_codes(types)
    if max_edges == 1 or not found:
        return found
    edges = frequent_adjacency(_both_views(one), spark.createDataFrame(list(types), TYPE_ROW))
    level = {c: s for c, s in found.items()}
    if max_edges == 2:
        after = _wedges(edges, rows, level, types, min_support)
        if after is not None:
            found |= after
            log.info("%d edges: %d frequent patterns, %d so far", 2, len(after), len(found))
            if progress:
                progress(2, len(found))
            return found
    edges = edges.persist()
    plain = one_label_each(edges, rows)
    tables: dict[tuple, tuple[DataFrame, dict[Code, int], DataFrame]] = {}
    for d in sorted({c[0].d for c in level}):
        some = {c: k for k, c in enumerate(c for c in seeds(types) if c in level and c[0].d == d)}
        emb = store.keep(match.seed_embeddings(edges, d, match.step_table(spark, [(0, k, c[0]) for c, k in some.items()])))
        tables[((0, 1, d),)] = (emb, some, emb)
    for size in range(2, max_edges + 1):
        last = size == max_edges
        after: dict[Code, int] = {}
        grown: dict[tuple, tuple[DataFrame, dict[Code, int], DataFrame]] = {}
        for skeleton, (emb, ids, _) in tables.items():
            children: dict[tuple[int, int, int], list[Code]] = defaultdict(list)
            for code in ids:
                for child in extensions(code, types):
                    children[child[-1].i, child[-1].j, child[-1].d].append(child)
            for (i, j, d), codes in sorted(children.items()):
                names = {c: k for k, c in enumerate(codes)}
                counted: dict[int, int] = {}
                free = [c for c in codes if plain and last and c[-1].forward and c[-1].jl not in vertex_labels(c[:-1])]
                bound = [c for c in codes if c not in set(free)]
                if free:
                    steps = match.step_table(spark, [(ids[c[:-1]], names[c], c[-1]) for c in free])
                    counted |= dict(match.grown_supports(emb, edges, i, d, steps).where(F.col("support") >= min_support).collect())
                if bound:
                    steps = match.step_table(spark, [(ids[c[:-1]], names[c], c[-1]) for c in bound])
                    more = match.grow(emb, edges, i, j, d, steps)
                    if not last:
                        more = store.keep(more)
                    counted |= dict(match.supports(more).where(F.col("support") >= min_support).collect())
                good = {c: names[c] for c in codes if names[c] in counted}
                after |= {c: counted[k] for c, k in good.items()}
                if not last and good:
                    kept = spark.createDataFrame([(k,) for k in good.values()], "pid int")
                    grown[(*skeleton, (i, j, d))] = (more.join(F.broadcast(kept) if len(good) <= match.MOST_STEPS else kept, "pid", "left_semi"), good, more)
                elif not last:
                    store.release(more)
        for _, _, held in tables.values():
            store.release(held)
        found |= after
        log.info("%d edges: %d frequent patterns, %d so far", size, len(after), len(found))
        if progress:
            progress(size, len(found))
        if not after:
            break
        tables = grown
    edges.unpersist()
    return found


def pattern_table(spark, found: dict[Code, int]) -> DataFrame:
    """Patterns as a table, ordered by size and code."""
    rows = sorted((len(c), 1 + max(max(e.i, e.j) for e in c), text(c), s, [tuple(e) for e in c]) for c, s in found.items())
    return spark.createDataFrame(rows, PATTERN)


def mine(adj: DataFrame, min_support: int, max_edges: int = 100, progress: Callable[[int, int], None] | None = None, one_view: bool = False) -> DataFrame:
    """``n_edges, n_vertices, code, support, edges`` of every frequent pattern."""
    return pattern_table(adj.sparkSession, mine_codes(adj, min_support, max_edges, progress, one_view))


def orbit_table(spark, codes: list[Code]) -> DataFrame:
    return spark.createDataFrame([(text(c), v, o) for c in codes for v, o in enumerate(orbits(c))], "code string, vertex int, orbit int")
