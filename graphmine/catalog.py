"""All graph queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmine.functions.pattern import ANY, OUT, Code, Edge, EdgeType, canonical_code, join_steps, orbits, query_graph_text, text
from graphmine.operators import match, types
from graphmine.plans import mine as plan
from graphmine.sources import exports, graph, importers

#: Patterns are frequent from a support of the number of orders / SHARE on.
SHARE = 62
AC, AO, AP = 101, 201, 301  # first labels of customers, orders and parts


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.trade_edges(spark, sf_dir), listed_once=True)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.event_edges(spark, sf_dir), directed=True)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(graph.flag_edges(spark, sf_dir))


def threshold(spark: SparkSession, sf_dir: str) -> int:
    return max(1, spark.read.parquet(f"{sf_dir}/orders.parquet").count() // SHARE)


def _by_skeleton(adj: DataFrame, codes: list[Code]) -> DataFrame:
    """``code, support`` of given patterns of one skeleton, counted by one job."""
    spark = adj.sparkSession
    prefix: dict[Code, int] = {}
    for c in codes:
        prefix.setdefault(c[:1], len(prefix))
    emb = match.seed_embeddings(adj, codes[0][0].d, match.step_table(spark, [(0, k, c[0]) for c, k in prefix.items()]))
    for n in range(2, len(codes[0]) + 1):
        now: dict[Code, int] = {}
        for c in codes:
            now.setdefault(c[:n], len(now))
        e = codes[0][n - 1]
        emb = match.grow(emb, adj, e.i, e.j, e.d, match.step_table(spark, [(prefix[c[:-1]], k, c[-1]) for c, k in now.items()]))
        prefix = now
    names = spark.createDataFrame([(k, text(c)) for c, k in prefix.items()], "pid int, code string")
    return match.supports(emb).join(F.broadcast(names), "pid").select("code", "support")


def _wedges(adj: DataFrame) -> DataFrame:
    """Two edges at one vertex: labels and support of every such pattern."""
    near = adj.select(F.col("src").alias("c"), F.col("src_label").alias("l1"), "edge_label", "dst", "dst_label")
    x = near.select("c", "l1", F.col("edge_label").alias("e0"), F.col("dst").alias("a"), F.col("dst_label").alias("l0"))
    y = near.select("c", "l1", F.col("edge_label").alias("e1"), F.col("dst").alias("b"), F.col("dst_label").alias("l2"))
    both = x.join(y, ["c", "l1"]).where("a <> b and (l0 < l2 or (l0 = l2 and e0 <= e1))")
    return both.groupBy("l0", "e0", "l1", "e1", "l2").agg(F.least(F.count_distinct("a"), F.count_distinct("c"), F.count_distinct("b")).cast("long").alias("support"))


def _triangle_codes() -> list[Code]:
    return [canonical_code([Edge(0, 1, c, 1, o), Edge(1, 2, o, 2, p), Edge(0, 2, c, 3, p)]) for c in range(AC, AC + 5) for o in range(AO, AO + 3) for p in range(AP, AP + 6)]


def _fixed(edges: list[tuple]) -> Code:
    return canonical_code([Edge(*e) for e in edges])


#: Two customers and an order around a part that both bought: the part's triangle with a tail.
TAILED = _fixed([(0, 1, AC, 1, AO), (1, 2, AO, 2, AP), (0, 2, AC, 3, AP), (2, 3, AP, 3, AC + 1)])
DIAMOND = _fixed([(0, 1, AC, 1, AO), (1, 2, AO, 2, AP), (0, 2, AC, 3, AP), (1, 3, AO, 2, AP + 1), (0, 3, AC, 3, AP + 1)])
PATH3 = _fixed([(0, 1, AC, 1, AO), (1, 2, AO, 2, AP), (2, 3, AP, 2, AO + 1)])
STAR3 = _fixed([(0, 1, AO, 2, AP), (0, 2, AO, 2, AP + 1), (0, 3, AO, 2, AP + 2)])
TRIANGLE = _triangle_codes()[0]
WEDGE = _fixed([(0, 1, AP, 2, AO), (1, 2, AO, 2, AP)])
TYPE_ONE, TYPE_TWO = EdgeType(AC, 1, AO, ANY), EdgeType(AC, 3, AP, ANY)


def _mine(edges: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = graph.trade_edges(spark, sf_dir).withColumn("dir", F.lit(0).cast("byte"))
        return plan.mine(one, threshold(spark, sf_dir), edges, one_view=True).select("n_edges", "code", "support")

    return run


def _mine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan.mine(events(spark, sf_dir), max(1, spark.read.parquet(f"{sf_dir}/events.parquet").count() // 1000), 3)
    size = found.groupBy("n_edges").agg(F.count("*").alias("patterns"), F.min("support").alias("least"), F.max("support").alias("most"))
    return size.select(F.col("n_edges").cast("int").alias("n_edges"), "patterns", "least", "most")


def _labels(adj: DataFrame) -> list[int]:
    return sorted(r[0] for r in adj.select("src_label").distinct().collect())


def _parallel(adj: DataFrame) -> DataFrame:
    """Two edges with different labels between the same two vertices, by the matcher: an edge and a cycle edge back."""
    kinds = adj.where("src_label < dst_label").select("src_label", "edge_label", "dst_label").distinct().collect()
    codes = sorted({canonical_code([Edge(0, 1, a, e, b), Edge(1, 0, b, f, a)]) for a, e, b in kinds for x, f, y in kinds if (a, b) == (x, y) and e < f})
    rows = [(text(c), c[0].il, c[0].el, c[1].el, c[0].jl) for c in codes]
    names = adj.sparkSession.createDataFrame(rows, "code string, src_label int, e0 int, e1 int, dst_label int")
    return _by_skeleton(adj, codes).join(F.broadcast(names), "code").select("src_label", "e0", "e1", "dst_label", "support")


def part_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst``: from the part of each line of an order to the part of its next line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    after = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return lines.select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null and src <> dst")


def _antiparallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow each other in both orders; a part's label is a function of its key."""
    label = lambda c: (F.pmod(F.col(c), F.lit(3)) + 1).cast("int")
    steps = part_steps(spark, sf_dir).select("src", label("src").alias("src_label"), F.lit(1).alias("edge_label"), "dst", label("dst").alias("dst_label"))
    adj = graph.adjacency(graph.edges(steps), directed=True)
    return _by_skeleton(adj, [canonical_code([Edge(0, 1, a, 1, b, OUT), Edge(1, 0, b, 1, a, OUT)]) for a in _labels(adj) for b in _labels(adj) if a <= b])


def _tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parse_adjacency(graph.format_adjacency(graph.trade_edges(spark, sf_dir)))


def _profile_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    positions = customer.select(F.col("c_custkey").alias("vertex"), (F.col("c_custkey") + 1000000).alias("uid"))
    profiles = customer.select((F.col("c_custkey") + 1000000).alias("uid"), (F.col("c_nationkey") + 1).cast("int").alias("label"))
    n = customer.count()
    network = customer.select(F.col("c_custkey").alias("v"), F.pmod(F.col("c_custkey") * 7 + 1, F.lit(n)).alias("nbr"), F.pmod("c_custkey", F.lit(2)).alias("kind"))
    return importers.profile_network(positions, profiles, network)


def _import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importers.edge_pairs(part_steps(spark, sf_dir), 5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    on = lambda build, f: lambda spark, sf_dir: f(build(spark, sf_dir))
    level = lambda adj, s: types.frequent_edge_types(adj, s)
    with_s = lambda f: lambda spark, sf_dir: f(trade(spark, sf_dir), threshold(spark, sf_dir))
    first = lambda adj: types.edges_of_type(adj, TYPE_ONE).select(F.col("dst").alias("vid"))
    return {
        "graph_edges": graph.trade_edges,
        "graph_vertices": on(trade, exports.vertices),
        "graph_adjacency": on(trade, lambda a: a.select(*graph.EDGE)),
        "graph_adjacency_directed": lambda spark, d: graph.adjacency(graph.trade_edges(spark, d), directed=True).withColumn("dir", F.col("dir").cast("int")),
        "graph_incident_counts": on(trade, lambda a: graph.incident_lists(a).select("src", F.size("incident").cast("long").alias("degree"))),
        "event_chain_edges": graph.event_edges,
        "adjacency_tsv_roundtrip": _tsv,
        "edge_type_support": on(trade, lambda a: types.edge_type_support(a).drop("dir")),
        "frequent_edge_types": with_s(lambda a, s: level(a, s).drop("dir")),
        "canonical_seeds": with_s(lambda a, s: types.canonical_seeds(level(a, s)).drop("dir")),
        "frequent_adjacency": with_s(lambda a, s: types.frequent_adjacency(a, level(a, s)).select(*graph.EDGE)),
        "leaf_extension_candidates": with_s(lambda a, s: types.extension_candidates(first(a), a, s // 2).drop("dir")),
        "edge_type_intersection": on(trade, lambda a: types.type_sources_intersection(a, TYPE_ONE, TYPE_TWO)),
        "edge_type_union": on(trade, lambda a: types.type_sources_union(a, TYPE_ONE, TYPE_TWO)),
        "edge_type_difference": on(trade, lambda a: types.type_sources_difference(a, TYPE_TWO, TYPE_ONE)),
        "wedge_support": on(trade, _wedges),
        "wedge_same_vertex_support": on(trade, lambda a: _wedges(a).where("l0 = l2 and e0 = e1").drop("l2", "e1")),
        "triangle_support": on(trade, lambda a: _by_skeleton(a, _triangle_codes())),
        "diamond_support": on(trade, lambda a: match.support(a, DIAMOND)),
        "tailed_triangle_support": on(trade, lambda a: match.support(a, TAILED)),
        "path3_support": on(trade, lambda a: match.support(a, PATH3)),
        "star3_support": on(trade, lambda a: match.support(a, STAR3)),
        "k4_support": lambda spark, d: match.support(_import_csv(spark, d).select("src", F.lit(1).alias("src_label"), "edge_label", "dst", F.lit(1).alias("dst_label"), F.lit(0).cast("byte").alias("dir")), canonical_code([Edge(i, j, 1, 0, 1) for i in range(4) for j in range(i + 1, 4)])),
        "parallel_edge_support": on(flags, _parallel),
        "antiparallel_edge_support": _antiparallel,
        "embedding_count": on(trade, lambda a: match.embedding_count(a, WEDGE)),
        "embedding_list": on(trade, lambda a: match.embeddings(a, TRIANGLE)),
        "has_embedding": on(trade, lambda a: match.has_embedding(a, TRIANGLE, [0, 1, 2])),
        "domain_per_position": on(trade, lambda a: match.domains(match.embeddings(a, TRIANGLE))),
        "domain_sizes": on(trade, lambda a: match.domain_sizes(match.embeddings(a, TRIANGLE))),
        "domain_bounds": on(trade, lambda a: match.reduced_domains(a, PATH3, 1)),
        "semi_join_projection": on(trade, lambda a: match.project(match.embeddings(a, TRIANGLE), match.domains(match.embeddings(a, DIAMOND)).where("pos = 0"))),
        "reversed_pair_dedup": lambda spark, d: importers.edge_pairs(part_steps(spark, d), 5).select("src", "dst"),
        "import_edge_csv": _import_csv,
        "import_profile_network": _profile_network,
        "export_arabesque": on(trade, exports.neighbour_lines),
        "export_scalemine_vertices": on(trade, exports.vertex_lines),
        "export_scalemine_edges": lambda spark, d: exports.edge_lines(graph.trade_edges(spark, d)),
        "mine_1": _mine(1),
        "mine_2": _mine(2),
        "pattern_count_by_size": lambda spark, d: _mine(2)(spark, d).groupBy("n_edges").agg(F.count("*").alias("patterns")),
        "mine_directed_chain_3": _mine_events,
        "mine_3": lambda spark, d: plan.mine(trade(spark, d), threshold(spark, d) * 6 // 5, 3).select("n_edges", "code", "support"),
        "pattern_orbits": lambda spark, d: plan.orbit_table(spark, [TRIANGLE, WEDGE, DIAMOND, STAR3]),
        "pattern_join_steps": lambda spark, d: spark.createDataFrame([(text(c), k, s) for c in (TAILED, DIAMOND, PATH3, STAR3) for k, s in enumerate(join_steps(c))], "code string, step int, kind string"),
        "pattern_lines": lambda spark, d: exports.pattern_lines(plan.mine(trade(spark, d), threshold(spark, d), 1)),
        "cfl_text": lambda spark, d: spark.createDataFrame([(text(c), query_graph_text(c, k)) for k, c in enumerate((TRIANGLE, DIAMOND))], "code string, value string"),
        "canonical_code": lambda spark, d: spark.createDataFrame([(text(c), text(canonical_code(c)), [int(o) for o in orbits(c)]) for c in (TRIANGLE, TAILED)], "code string, canonical string, orbits array<int>"),
    }


RANKS = """
seg AS (SELECT v, CAST(100 + row_number() OVER (ORDER BY v) AS INTEGER) l FROM (SELECT DISTINCT c_mktsegment v FROM customer)),
sta AS (SELECT v, CAST(200 + row_number() OVER (ORDER BY v) AS INTEGER) l FROM (SELECT DISTINCT o_orderstatus v FROM orders)),
typ AS (SELECT v, CAST(300 + row_number() OVER (ORDER BY v) AS INTEGER) l FROM (SELECT DISTINCT p_type v FROM part)),
cu AS (SELECT c_custkey k, CAST(3 * c_custkey AS BIGINT) id, l FROM customer JOIN seg ON v = c_mktsegment),
od AS (SELECT o_orderkey k, o_custkey ck, CAST(3 * o_orderkey + 1 AS BIGINT) id, l FROM orders JOIN sta ON v = o_orderstatus),
pa AS (SELECT p_partkey k, CAST(3 * p_partkey + 2 AS BIGINT) id, l FROM part JOIN typ ON v = p_type)"""
EDGES = RANKS + """,
edges AS (
  SELECT DISTINCT cu.id src, cu.l src_label, CAST(1 AS INTEGER) edge_label, od.id dst, od.l dst_label FROM od JOIN cu ON od.ck = cu.k
  UNION ALL SELECT DISTINCT od.id, od.l, CAST(2 AS INTEGER), pa.id, pa.l FROM lineitem JOIN od ON l_orderkey = od.k JOIN pa ON l_partkey = pa.k
  UNION ALL SELECT DISTINCT cu.id, cu.l, CAST(3 AS INTEGER), pa.id, pa.l FROM lineitem JOIN od ON l_orderkey = od.k JOIN cu ON od.ck = cu.k JOIN pa ON l_partkey = pa.k)"""
ADJ = EDGES + """,
adj AS (SELECT * FROM edges UNION ALL SELECT dst, dst_label, edge_label, src, src_label FROM edges)"""
TYPES = ADJ + """,
types AS (SELECT src_label, edge_label, dst_label, CAST(least(count(DISTINCT src), count(DISTINCT dst)) AS BIGINT) support FROM adj GROUP BY ALL),
lim AS (SELECT greatest(1, count(*) // 62) s FROM orders)"""
WEDGES = """
SELECT x.dst_label l0, x.edge_label e0, x.src_label l1, y.edge_label e1, y.dst_label l2,
  CAST(least(count(DISTINCT x.dst), count(DISTINCT x.src), count(DISTINCT y.dst)) AS BIGINT) support
FROM adj x JOIN adj y ON x.src = y.src AND x.src_label = y.src_label AND x.dst <> y.dst
WHERE x.dst_label < y.dst_label OR (x.dst_label = y.dst_label AND x.edge_label <= y.edge_label) GROUP BY ALL"""
TRI = """
tri AS (SELECT a.src c, a.src_label cl, a.dst o, a.dst_label ol, b.dst p, b.dst_label pl
  FROM edges a JOIN edges b ON a.dst = b.src AND a.edge_label = 1 AND b.edge_label = 2 JOIN edges d ON d.src = a.src AND d.dst = b.dst AND d.edge_label = 3)"""
EVENTS = """
ety AS (SELECT v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) l FROM (SELECT DISTINCT event_type v FROM events)),
ev AS (SELECT event_id id, l, lead(event_id) OVER w nid, lead(l) OVER w nl FROM events JOIN ety ON v = event_type WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
chain AS (SELECT id src, l src_label, CAST(1 AS INTEGER) edge_label, nid dst, nl dst_label FROM ev WHERE nid IS NOT NULL)"""
STEPS = """
steps AS (SELECT * FROM (SELECT l_partkey src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
PAIRS = STEPS + """,
csv AS (SELECT DISTINCT least(src, dst) src, greatest(src, dst) dst FROM steps)"""
CSV = f"WITH {PAIRS} SELECT src, CAST((src * 7 + 3) % 5 + 1 AS INTEGER) src_label, CAST(0 AS INTEGER) edge_label, dst, CAST((dst * 7 + 3) % 5 + 1 AS INTEGER) dst_label FROM csv"
#: The labels' triangle, each edge type filtered first.
TRIANGLE_ROWS = f"""
t1 AS MATERIALIZED (SELECT src, dst FROM edges WHERE edge_label = 1 AND src_label = {AC} AND dst_label = {AO}),
t2 AS MATERIALIZED (SELECT src, dst FROM edges WHERE edge_label = 2 AND src_label = {AO} AND dst_label = {AP}),
t3 AS MATERIALIZED (SELECT src, dst FROM edges WHERE edge_label = 3 AND src_label = {AC} AND dst_label = {AP}),
triangle AS MATERIALIZED (SELECT t1.src v0, t1.dst v1, t2.dst v2 FROM t1 JOIN t2 ON t1.dst = t2.src JOIN t3 ON t3.src = t1.src AND t3.dst = t2.dst)"""


def _bounds(code: Code) -> str:
    """SQL of the domains' bounds after one round over the edges, one table for each step."""
    now, ctes = {}, []
    for e in code:
        for v, label in ((e.i, e.il), (e.j, e.jl)):
            if v not in now:
                now[v] = f"b{v}"
                ctes.append(f"b{v} AS MATERIALIZED (SELECT DISTINCT src vid FROM adj WHERE src_label = {label})")
    for k, e in enumerate(code):
        for side, (a, b, x) in enumerate(((e.i, e.j, e), (e.j, e.i, e.reversed()))):
            ctes.append(f"s{k}_{side} AS MATERIALIZED (SELECT vid FROM {now[a]} WHERE vid IN (SELECT src FROM adj WHERE src_label = {x.il} AND edge_label = {x.el} AND dst_label = {x.jl} AND dst IN (SELECT vid FROM {now[b]})))")
            now[a] = f"s{k}_{side}"
    return f"WITH {ADJ}, {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT CAST({v} AS INTEGER) pos, vid FROM {t}" for v, t in sorted(now.items()))


def _one_edge_codes() -> str:
    return "SELECT CAST(1 AS INTEGER) n_edges, '(0,1,' || src_label || ',' || edge_label || ',' || dst_label || ',0)' code, support FROM types WHERE src_label <= dst_label AND support >= (SELECT s FROM lim)"


def _two_edge_codes() -> str:
    """Canonical code of a wedge whose leaves' labels differ from the centre's: it starts at the centre if that has the
    least label, else at the leaf with the lesser (label, edge label)."""
    centre = "'(0,1,' || l1 || ',' || a.e || ',' || a.l || ',0)(0,2,' || l1 || ',' || b.e || ',' || b.l || ',0)'"
    leaf = "'(0,1,' || l0 || ',' || e0 || ',' || l1 || ',0)(1,2,' || l1 || ',' || e1 || ',' || l2 || ',0)'"
    first = "CASE WHEN (e0, l0) <= (e1, l2) THEN {'e': e0, 'l': l0} ELSE {'e': e1, 'l': l2} END a, CASE WHEN (e0, l0) <= (e1, l2) THEN {'e': e1, 'l': l2} ELSE {'e': e0, 'l': l0} END b"
    return f"SELECT CAST(2 AS INTEGER) n_edges, CASE WHEN l1 < l0 AND l1 < l2 THEN {centre} ELSE {leaf} END code, support FROM (SELECT *, {first} FROM ({WEDGES}))  WHERE support >= (SELECT s FROM lim)"


def _support_of(edges: list[tuple[str, str, int, int, int]], apart: list[tuple[str, str]]) -> str:
    """Support of a fixed pattern; edges are (from, to, from's label, edge label, to's label) over vertex names."""
    tables, where, at = [], [], {}
    for k, (a, b, la, e, lb) in enumerate(edges):
        tables.append(f"adj t{k}")
        where += [f"t{k}.src_label = {la}", f"t{k}.edge_label = {e}", f"t{k}.dst_label = {lb}"]
        for v, col in ((a, f"t{k}.src"), (b, f"t{k}.dst")):
            where += [f"{at[v]} = {col}"] if v in at else []
            at.setdefault(v, col)
    where += [f"{at[a]} <> {at[b]}" for a, b in apart]
    counts = ", ".join(f"count(DISTINCT {c})" for c in at.values())
    return f"WITH {ADJ} SELECT CAST(least({counts}) AS BIGINT) support FROM {', '.join(tables)} WHERE {' AND '.join(where)}"


def oracle_sql() -> dict[str, str]:
    sources = lambda t: f"SELECT DISTINCT src vid FROM adj WHERE src_label = {t.src_label} AND edge_label = {t.edge_label} AND dst_label = {t.dst_label}"
    one, two = sources(TYPE_ONE), sources(TYPE_TWO)
    mine_2 = f"WITH {TYPES} {_one_edge_codes()} UNION ALL {_two_edge_codes()}"
    verts = "verts AS (SELECT src id, min(src_label) label FROM adj GROUP BY src)"
    triangle = f"SELECT * FROM tri WHERE cl = {AC} AND ol = {AO} AND pl = {AP}"
    chain = lambda n: f"SELECT CAST({n} AS INTEGER) n_edges, {', '.join(f'c{k}.src_label s{k}' for k in range(n))}, c{n - 1}.dst_label t, least({', '.join(f'count(DISTINCT c{k}.src)' for k in range(n))}, count(DISTINCT c{n - 1}.dst)) support FROM chain c0 {' '.join(f'JOIN chain c{k} ON c{k}.src = c{k - 1}.dst' for k in range(1, n))} GROUP BY ALL"
    sizes = " UNION ALL ".join(f"SELECT n_edges, support FROM ({chain(n)})" for n in (1, 2, 3))
    return {
        "graph_edges": f"WITH {EDGES} SELECT * FROM edges",
        "graph_vertices": f"WITH {ADJ}, {verts} SELECT id, label FROM verts",
        "graph_adjacency": f"WITH {ADJ} SELECT * FROM adj",
        "graph_adjacency_directed": f"WITH {EDGES} SELECT *, CAST(1 AS INTEGER) dir FROM edges UNION ALL SELECT dst, dst_label, edge_label, src, src_label, CAST(-1 AS INTEGER) FROM edges",
        "graph_incident_counts": f"WITH {ADJ} SELECT src, count(*) degree FROM adj GROUP BY src",
        "event_chain_edges": f"WITH {EVENTS} SELECT * FROM chain",
        "adjacency_tsv_roundtrip": f"WITH {EDGES} SELECT * FROM edges",
        "edge_type_support": f"WITH {TYPES} SELECT * FROM types",
        "frequent_edge_types": f"WITH {TYPES} SELECT * FROM types WHERE support >= (SELECT s FROM lim)",
        "canonical_seeds": f"WITH {TYPES} SELECT * FROM types WHERE support >= (SELECT s FROM lim) AND src_label <= dst_label",
        "frequent_adjacency": f"WITH {TYPES} SELECT adj.* FROM adj SEMI JOIN (SELECT * FROM types WHERE support >= (SELECT s FROM lim)) t USING (src_label, edge_label, dst_label)",
        "leaf_extension_candidates": f"WITH {TYPES} SELECT src_label, edge_label, dst_label, count(DISTINCT src) sources FROM adj WHERE src IN (SELECT dst FROM adj WHERE src_label = {AC} AND edge_label = 1 AND dst_label = {AO}) GROUP BY ALL HAVING count(DISTINCT src) >= (SELECT s // 2 FROM lim)",
        "edge_type_intersection": f"WITH {ADJ} {one} INTERSECT {two}",
        "edge_type_union": f"WITH {ADJ} {one} UNION {two}",
        "edge_type_difference": f"WITH {ADJ} {two} EXCEPT {one}",
        "wedge_support": f"WITH {ADJ} {WEDGES}",
        "wedge_same_vertex_support": f"WITH {ADJ} SELECT l0, e0, l1, support FROM ({WEDGES}) WHERE l0 = l2 AND e0 = e1",
        "triangle_support": f"WITH {EDGES}, {TRI} SELECT '(0,1,' || cl || ',1,' || ol || ',0)(1,2,' || ol || ',2,' || pl || ',0)(2,0,' || pl || ',3,' || cl || ',0)' code, CAST(least(count(DISTINCT c), count(DISTINCT o), count(DISTINCT p)) AS BIGINT) support FROM tri GROUP BY cl, ol, pl",
        "diamond_support": _support_of([("c", "o", AC, 1, AO), ("o", "p", AO, 2, AP), ("c", "p", AC, 3, AP), ("o", "q", AO, 2, AP + 1), ("c", "q", AC, 3, AP + 1)], []),
        "tailed_triangle_support": _support_of([("c", "o", AC, 1, AO), ("o", "p", AO, 2, AP), ("c", "p", AC, 3, AP), ("p", "d", AP, 3, AC + 1)], []),
        "path3_support": _support_of([("c", "o", AC, 1, AO), ("o", "p", AO, 2, AP), ("p", "q", AP, 2, AO + 1)], []),
        "star3_support": _support_of([("o", "p", AO, 2, AP), ("o", "q", AO, 2, AP + 1), ("o", "r", AO, 2, AP + 2)], []),
        "k4_support": f"WITH {PAIRS}, adj AS (SELECT src, dst FROM csv UNION SELECT dst, src FROM csv) SELECT CAST(least(count(DISTINCT a.src), count(DISTINCT a.dst), count(DISTINCT b.dst), count(DISTINCT c.dst)) AS BIGINT) support FROM adj a JOIN adj b ON a.src = b.src JOIN adj c ON a.src = c.src JOIN adj d ON d.src = a.dst AND d.dst = b.dst JOIN adj e ON e.src = a.dst AND e.dst = c.dst JOIN adj f ON f.src = b.dst AND f.dst = c.dst",
        "parallel_edge_support": f"WITH {RANKS}, fl AS (SELECT v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) l FROM (SELECT DISTINCT l_returnflag v FROM lineitem)), edges AS (SELECT DISTINCT od.id src, od.l src_label, fl.l edge_label, pa.id dst, pa.l dst_label FROM lineitem JOIN od ON l_orderkey = od.k JOIN pa ON l_partkey = pa.k JOIN fl ON fl.v = l_returnflag) SELECT x.src_label, x.edge_label e0, y.edge_label e1, x.dst_label, CAST(least(count(DISTINCT x.src), count(DISTINCT x.dst)) AS BIGINT) support FROM edges x JOIN edges y ON x.src = y.src AND x.dst = y.dst AND x.edge_label < y.edge_label GROUP BY ALL",
        "antiparallel_edge_support": f"WITH {STEPS}, x AS (SELECT DISTINCT src u, dst v, src % 3 + 1 a, dst % 3 + 1 b FROM steps) SELECT '(0,1,' || x.a || ',1,' || x.b || ',1)(1,0,' || x.b || ',1,' || x.a || ',1)' code, CAST(least(count(DISTINCT x.u), count(DISTINCT x.v)) AS BIGINT) support FROM x JOIN x y ON x.u = y.v AND x.v = y.u AND x.a <= x.b GROUP BY x.a, x.b",
        "embedding_count": f"WITH {ADJ} SELECT count(*) embeddings FROM adj x JOIN adj y ON x.src = y.src AND x.dst <> y.dst WHERE x.src_label = {AO} AND x.edge_label = 2 AND y.edge_label = 2 AND x.dst_label = {AP} AND y.dst_label = {AP}",
        "embedding_list": f"WITH {EDGES}, {TRIANGLE_ROWS} SELECT * FROM triangle",
        "domain_bounds": _bounds(PATH3),
        "semi_join_projection": f"WITH {EDGES}, {TRIANGLE_ROWS}, q2 AS MATERIALIZED (SELECT src, dst FROM edges WHERE edge_label = 2 AND src_label = {AO} AND dst_label = {AP + 1}), q3 AS MATERIALIZED (SELECT src, dst FROM edges WHERE edge_label = 3 AND src_label = {AC} AND dst_label = {AP + 1}) SELECT * FROM triangle WHERE v0 IN (SELECT t.v0 FROM triangle t JOIN q2 ON q2.src = t.v1 JOIN q3 ON q3.src = t.v0 AND q3.dst = q2.dst)",
        "has_embedding": f"WITH {EDGES}, {TRI} SELECT count(*) > 0 found FROM ({triangle}) WHERE c = 0 AND o = 1 AND p = 2",
        "domain_per_position": f"WITH {EDGES}, {TRI} SELECT DISTINCT CAST(0 AS INTEGER) pos, c vid FROM ({triangle}) UNION SELECT DISTINCT 1, o FROM ({triangle}) UNION SELECT DISTINCT 2, p FROM ({triangle})",
        "domain_sizes": f"WITH {EDGES}, {TRI} SELECT CAST(0 AS INTEGER) pos, count(DISTINCT c) n FROM ({triangle}) UNION ALL SELECT 1, count(DISTINCT o) FROM ({triangle}) UNION ALL SELECT 2, count(DISTINCT p) FROM ({triangle})",
        "reversed_pair_dedup": f"WITH {PAIRS} SELECT src, dst FROM csv",
        "import_edge_csv": CSV,
        "import_profile_network": "WITH lab AS (SELECT c_custkey k, CAST(c_nationkey + 1 AS INTEGER) l FROM customer), net AS (SELECT c_custkey v, (c_custkey * 7 + 1) % (SELECT count(*) FROM customer) nbr, c_custkey % 2 kind FROM customer) SELECT DISTINCT v src, a.l src_label, CAST(0 AS INTEGER) edge_label, nbr dst, b.l dst_label FROM net JOIN lab a ON a.k = v JOIN lab b ON b.k = nbr WHERE kind = 0 OR v < nbr",
        "export_arabesque": f"WITH {ADJ}, {verts}, ids AS (SELECT id, label, row_number() OVER (ORDER BY id) - 1 d FROM verts), near AS (SELECT DISTINCT a.src, ids.d FROM adj a JOIN ids ON a.dst = ids.id) SELECT ids.d dense, ids.d || ' ' || ids.label || ' ' || string_agg(CAST(near.d AS VARCHAR), ' ' ORDER BY near.d) AS \"value\" FROM ids JOIN near ON near.src = ids.id GROUP BY ids.d, ids.label",
        "export_scalemine_vertices": f"WITH {ADJ}, {verts} SELECT id, 'v ' || id || ' ' || label AS \"value\" FROM verts",
        "export_scalemine_edges": f"WITH {EDGES} SELECT 'e ' || dst || ' ' || src || ' 1' AS \"value\" FROM edges",
        "mine_1": f"WITH {TYPES} {_one_edge_codes()}",
        "mine_2": mine_2,
        "pattern_count_by_size": f"SELECT n_edges, count(*) patterns FROM ({mine_2}) GROUP BY n_edges",
        "mine_directed_chain_3": f"WITH {EVENTS} SELECT n_edges, count(*) patterns, min(support) least, max(support) most FROM ({sizes}) WHERE support >= (SELECT greatest(1, count(*) // 1000) FROM events) GROUP BY n_edges",
        "pattern_lines": f"WITH {TYPES} SELECT 'FrequentGraph (DFSCode (Edge (0, 1, ' || src_label || ', ' || edge_label || ', ' || dst_label || ', 0)  F ), freq ' || support || ')' AS \"value\" FROM types WHERE src_label <= dst_label AND support >= (SELECT s FROM lim)",
    }
