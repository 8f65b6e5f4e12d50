"""Embeddings of patterns: injective, label-preserving, not induced.

An embedding table has a pattern id (``pid``) and one column for each vertex (``v0``, ``v1``, ...); patterns with the same
skeleton (edges without labels) share one table, and labels travel in a small table of candidates.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmine.functions.pattern import Code, Edge, EdgeType, n_vertices, vertex_labels
from graphmine.operators import store

#: Candidates that are broadcast (20 bytes each); more are joined by a shuffle.
MOST_STEPS = 500_000
STEP = "pid int, child int, s_label int, e_label int, d_label int"


def columns(emb: DataFrame) -> list[str]:
    return sorted((c for c in emb.columns if c.startswith("v")), key=lambda c: int(c[1:]))


def step_table(spark: SparkSession, steps: Iterable[tuple[int, int, Edge]]) -> DataFrame:
    """(pattern, child, last edge) rows as a table, broadcast up to ``MOST_STEPS`` of them; its size is the number of candidates, not of vertices."""
    rows = [(p, c, e.il, e.el, e.jl) for p, c, e in steps]
    table = spark.createDataFrame(rows, STEP)
    return F.broadcast(table) if len(rows) <= MOST_STEPS else table


def _named(adj: DataFrame, d: int, extra: Iterable[str] = ()) -> DataFrame:
    return adj.where(F.col("dir") == d).select(F.col("src").alias("__s"), F.col("src_label").alias("s_label"), F.col("edge_label").alias("e_label"), F.col("dst").alias("__d"), F.col("dst_label").alias("d_label"), *extra)


def seed_embeddings(adj: DataFrame, d: int, steps: DataFrame) -> DataFrame:
    """Embeddings of one-edge patterns (``child`` of ``steps``)."""
    found = _named(adj, d).join(steps, ["s_label", "e_label", "d_label"])
    return found.where("__s <> __d").select(F.col("child").alias("pid"), F.col("__s").alias("v0"), F.col("__d").alias("v1"))


def grow(emb: DataFrame, adj: DataFrame, i: int, j: int, d: int, steps: DataFrame) -> DataFrame:
    """Embeddings of the children: edge (i, j) of the candidates' labels added.

    A discovery is an inner join and keeps the new vertex apart from all earlier ones; a cycle edge is a semi-join on
    both ends.
    """
    own = columns(emb)
    wide = emb.join(steps, "pid")
    near = _named(adj, d)
    types = ["s_label", "e_label", "d_label"]
    if j < len(own):
        keyed = wide.withColumn("__s", F.col(f"v{i}")).withColumn("__d", F.col(f"v{j}"))
        return keyed.join(near, ["__s", "__d", *types], "left_semi").select(F.col("child").alias("pid"), *own)
    grown = wide.withColumn("__s", F.col(f"v{i}")).join(near, ["__s", *types])
    for c in own:
        grown = grown.where(F.col("__d") != F.col(c))
    return grown.select(F.col("child").alias("pid"), *own, F.col("__d").alias(f"v{j}"))


def supports(emb: DataFrame, representatives: Iterable[int] | None = None) -> DataFrame:
    """``pid, support``: the least number of distinct values over positions (over ``representatives`` of orbits if given)."""
    own = columns(emb) if representatives is None else [f"v{k}" for k in sorted(set(representatives))]
    counts = [F.count_distinct(c) for c in own]
    return emb.groupBy("pid").agg((F.least(*counts) if len(counts) > 1 else counts[0]).cast("long").alias("support"))


def grown_supports(emb: DataFrame, adj: DataFrame, i: int, d: int, steps: DataFrame) -> DataFrame:
    """Supports of children by a discovery from position ``i`` whose new label no earlier vertex of the pattern has.

    The new vertex is then apart from all others by its label alone, so nothing is enumerated: earlier positions
    keep the embeddings whose ``v_i`` has such an edge, and the new position's values are the ends of those edges.
    (Vertices must have one label each.)
    """
    own = columns(emb)
    near = _named(adj, d)
    types = ["s_label", "e_label", "d_label"]
    has = near.select("__s", *types).distinct()
    kept = emb.join(steps, "pid").withColumn("__s", F.col(f"v{i}")).join(has, ["__s", *types])
    old = kept.groupBy("child").agg(F.least(*(F.count_distinct(c) for c in own)).alias("old"))
    new = emb.select("pid", F.col(f"v{i}").alias("__s")).distinct().join(steps, "pid").join(near, ["__s", *types]).groupBy("child").agg(F.count_distinct("__d").alias("new"))
    return old.join(new, "child").select(F.col("child").alias("pid"), F.least("old", "new").cast("long").alias("support"))


#: Edge types that start at one label and fit a mask.
MOST_BITS = 62


def wedge_supports(adj: DataFrame, rows: int, wedges: Iterable[tuple[EdgeType, EdgeType]]) -> dict[tuple[EdgeType, EdgeType], int]:
    """Supports of pairs of edges at one centre, by the edges' types as the centre sees them, without enumerating pairs.

    An end y of an edge of type s has a partner of type t if the centre has another end of that type: two ends of type t, or one
    that is not y.  So each edge tells its end a mask of such types, and the ends' masks, and the centre's by type, are
    merged and counted.  ``adj`` has ``rows`` rows, both views of every edge and one label for each vertex; at most
    ``MOST_BITS`` types of ``wedges`` start at one label.
    """
    spark = adj.sparkSession
    wanted = list(wedges)
    at_label: dict[int, list[EdgeType]] = defaultdict(list)
    for t in sorted({t for pair in wanted for t in pair}):
        at_label[t.src_label].append(t)
    place = {t: k for ts in at_label.values() for k, t in enumerate(ts)}
    kind = {t: 64 * n + k for n, ts in enumerate(at_label.values()) for k, t in enumerate(ts)}
    width = max(map(len, at_label.values()))
    if width > MOST_BITS:
        raise ValueError(f"more than {MOST_BITS} edge types at one label")
    several = len({(t.src_label, t.dst_label) for t in kind}) < len(kind)
    names = spark.createDataFrame([(*t, k) for t, k in kind.items()], "src_label int, edge_label int, dst_label int, dir byte, kind int")
    named = adj.join(F.broadcast(names), ["src_label", "edge_label", "dst_label", "dir"]).where("src <> dst").select("src", "dst", "kind")
    bit = F.expr("shiftleft(1L, kind & 63)")
    told = []
    for part in store.slices("src", rows):
        some = named.where(part).repartition("src")
        counted = some.groupBy("src", "kind").agg(F.count("dst").alias("n"))
        types = counted.groupBy("src").agg(F.bit_or(bit).alias("once"), F.coalesce(F.bit_or(F.when(F.col("n") > 1, bit)), F.lit(0)).alias("twice")).hint("shuffle_hash")
        mask = F.col("twice").bitwiseOR(F.col("once").bitwiseAND(F.bitwise_not(F.col("here")))).alias("mask")
        if several:  # two vertices can have edges of several types
            here = some.groupBy("src", "dst").agg(F.bit_or(bit).alias("here")).hint("shuffle_hash")
            ends = some.join(here, ["src", "dst"]).join(types, "src").select("src", "dst", "kind", mask)
            own = ends.groupBy("src", "kind").agg(F.bit_or("mask").alias("mask"))
        else:
            ends = some.withColumn("here", bit).join(types, "src").select("dst", "kind", mask)
            own = counted.withColumn("here", bit).join(types, "src").select("src", "kind", mask)
        told.append(store.keep(ends.select(F.lit(False).alias("centre"), F.col("dst").alias("v"), "kind", "mask").unionByName(own.select(F.lit(True).alias("centre"), F.col("src").alias("v"), "kind", "mask"))))
    every = reduce(DataFrame.unionByName, told)
    counts: Counter = Counter()
    bits = [F.sum(F.shiftrightunsigned("mask", k).bitwiseAND(F.lit(1))).alias(f"n{k}") for k in range(width)]
    with store.tidy(spark):
        for part in store.slices("v", 2 * rows):
            merged = every.where(part).groupBy("centre", "v", "kind").agg(F.bit_or("mask").alias("mask"))
            for row in merged.groupBy("centre", "kind").agg(*bits).collect():
                counts.update({(row[0], row[1], k): row[2 + k] for k in range(width)})
    for table in told:
        store.release(table)
    return {(s, t): min(counts[True, kind[s], place[t]], counts[False, kind[s], place[t]], counts[False, kind[t], place[s]]) for s, t in wanted}


def embeddings(adj: DataFrame, code: Code) -> DataFrame:
    """All embeddings of one pattern: columns ``v0`` ... in the order of its code."""
    spark = adj.sparkSession
    emb = seed_embeddings(adj, code[0].d, step_table(spark, [(0, 0, code[0])]))
    for e in code[1:]:
        emb = grow(emb, adj, e.i, e.j, e.d, step_table(spark, [(0, 0, e)]))
    return emb.drop("pid")


def embedding_count(adj: DataFrame, code: Code) -> DataFrame:
    return embeddings(adj, code).agg(F.count("*").alias("embeddings"))


def clique_type(code: Code) -> EdgeType | None:
    """The edges' type if the code is a clique of three vertices or more, undirected and of one label and edge label, else None."""
    n = n_vertices(code)
    kinds = {EdgeType(e.il, e.el, e.jl, e.d) for e in code}
    pairs = {frozenset((e.i, e.j)) for e in code}
    whole = n > 2 and len(code) == len(pairs) == n * (n - 1) // 2
    kind = kinds.pop() if len(kinds) == 1 else None
    return kind if whole and kind and kind.src_label == kind.dst_label and kind.d == 0 else None


def clique_members(adj: DataFrame, kind: EdgeType, n: int) -> DataFrame:
    """``vid`` of the vertices in a clique of ``n`` vertices with edges of one undirected type; ``adj`` has one view of every edge or both.

    All positions of a clique have the same vertices, so each clique is found once: edges lead from the end with the lesser (degree, id) to
    the other, a vertex knows its followers, and a clique's first vertex tells each follower which others come after it.  What both know are the
    candidates for the next step.  The lists are shuffled, not embeddings, and slice by slice.
    """
    near = adj.where(F.col("src_label") == kind.src_label).where(F.col("dst_label") == kind.dst_label).where(F.col("edge_label") == kind.edge_label).where("dir = 0 and src <> dst")
    pairs = store.keep(near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    degree = store.keep(pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n")))
    of = lambda c: degree.select(F.col("v").alias(c), F.struct("n", F.col("v").alias("id")).alias(f"__{c}"))
    ranked = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("__a", "__b").alias("x"), F.greatest("__a", "__b").alias("y"))
    after = ranked.groupBy(F.col("x.id").alias("v")).agg(F.transform(F.array_sort(F.collect_list("y")), lambda y: y["id"]).alias("after"))
    after = store.keep(after.where(F.size("after") > 0))
    told = after.agg(F.coalesce(F.sum(F.expr("bigint(size(after)) * (size(after) - 1) div 2")), F.lit(0))).first()[0]
    found = []
    for part in store.slices("v", told):
        # members so far, the last of them as v, and those that may come after it
        met = after.where(part).select(F.array("v").alias("clique"), F.col("after").alias("may"))
        for left in range(n - 1, 1, -1):
            each = met.where(F.size("may") >= left).select("clique", "may", F.posexplode("may").alias("k", "v"))
            each = each.select("clique", "v", F.expr("slice(may, k + 2, size(may))").alias("may")).where(F.size("may") >= left - 1)
            met = each.join(after.hint("shuffle_hash"), "v").select(F.concat("clique", F.array("v")).alias("clique"), F.array_intersect("may", "after").alias("may")).where(F.size("may") >= left - 1)
        found.append(store.keep(met.select(F.explode(F.concat("clique", "may")).alias("vid")).distinct()))
    for table in (pairs, degree, after):
        store.release(table)
    return reduce(DataFrame.unionByName, found).distinct()


def support(adj: DataFrame, code: Code) -> DataFrame:
    """``support`` of one pattern; 0 if it has no embedding.  Cliques of one edge type are found without their embeddings."""
    kind = clique_type(code)
    if kind:
        return clique_members(adj, kind, n_vertices(code)).agg(F.count("*").alias("support"))
    emb = embeddings(adj, code)
    return emb.agg(F.least(*(F.count_distinct(c) for c in columns(emb))).cast("long").alias("support"))


def domains(emb: DataFrame) -> DataFrame:
    """Distinct (pos, vid) of an embedding table, one pass over it."""
    own = columns(emb)
    pairs = F.array(*(F.struct(F.lit(int(c[1:])).alias("pos"), F.col(c).alias("vid")) for c in own))
    return emb.select(F.explode(pairs).alias("p")).select("p.pos", "p.vid").distinct()


def domain_sizes(emb: DataFrame) -> DataFrame:
    """Distinct values of each position: the shape of the embedding set."""
    return domains(emb).groupBy("pos").agg(F.count("*").alias("n"))


def project(emb: DataFrame, keep: DataFrame) -> DataFrame:
    """Embeddings whose value at every position that ``keep(pos, vid)`` names is in it: one semi-join for each position."""
    positions = [r[0] for r in keep.select("pos").distinct().collect()]
    for p in sorted(positions):
        values = keep.where(F.col("pos") == p).select(F.col("vid").alias(f"v{p}"))
        emb = emb.join(values, f"v{p}", "left_semi")
    return emb.select("pid", *columns(emb)) if "pid" in emb.columns else emb.select(*columns(emb))


def reduced_domains(adj: DataFrame, code: Code, rounds: int = 2) -> DataFrame:
    """Upper bounds of the domains: values that have, for each edge of the pattern, a neighbour among the bound of its other end."""
    labels = vertex_labels(code)
    adj = adj.persist()  # read by each step
    bound: dict[int, DataFrame] = {}
    for v, label in enumerate(labels):
        bound[v] = adj.where(F.col("src_label") == label).select(F.col("src").alias("vid")).distinct()
    for _ in range(rounds):
        for e in code:
            for a, b, x in ((e.i, e.j, e), (e.j, e.i, e.reversed())):
                near = adj.where((F.col("src_label") == x.il) & (F.col("edge_label") == x.el) & (F.col("dst_label") == x.jl) & (F.col("dir") == x.d))
                ok = near.join(bound[b].select(F.col("vid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("vid"))
                bound[a] = bound[a].join(ok, "vid", "left_semi")
    out = None
    for v in range(n_vertices(code)):
        one = bound[v].select(F.lit(v).alias("pos"), "vid")
        out = one if out is None else out.unionByName(one)
    return out


def has_embedding(adj: DataFrame, code: Code, values: list[int]) -> DataFrame:
    """One row ``found``: do these vertices, in code order, embed the pattern?"""
    emb = embeddings(adj, code)
    same = emb
    for c, v in zip(columns(emb), values, strict=True):
        same = same.where(F.col(c) == v)
    return same.limit(1).agg((F.count("*") > 0).alias("found"))
