import random
from collections import Counter

import pytest

from brute_force import frequent
from graphmine.functions.pattern import Edge, canonical_code
from graphmine.operators import match, store, types
from graphmine.plans.mine import _wedge_types as wedge_types
from graphmine.plans.mine import mine, mine_codes
from graphmine.sources.graph import adjacency

SCHEMA = "src long, src_label int, edge_label int, dst long, dst_label int"


def graph(spark, rows, directed=False, **more):
    return adjacency(spark.createDataFrame(rows, SCHEMA), directed, **more).cache()


def drawn(pairs, label, e=0):
    return [(u, label[u], e, v, label[v]) for u, v in pairs]


def sizes(found):
    c = Counter(map(len, found))
    return [c[k] for k in sorted(c)]


FIXTURES = {
    "clique": (drawn([(a, b) for a in range(4) for b in range(a + 1, 4)], [0] * 4), False, 4, 6, [1, 1, 3, 2, 1, 1]),
    "star": (drawn([(0, 1), (0, 2), (0, 3), (0, 4)], {0: 1, 1: 2, 2: 2, 3: 2, 4: 3}), False, 1, 4, [2, 2, 2, 1]),
    "path": (drawn([(1, 2), (2, 3), (3, 4)], {k: 7 for k in range(1, 5)}), False, 1, 3, [1, 1, 1]),
    "parallel": ([(1, 0, 17, 2, 0), (2, 0, 18, 1, 0), (1, 0, 34, 2, 0), (3, 0, 17, 4, 0), (4, 0, 18, 3, 0), (3, 0, 34, 4, 0)], True, 2, 3, [3, 3, 1]),
    "tailed triangle": (drawn([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 7)], {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 2, 7: 3}), False, 1, 4, [4, 5, 4, 1]),
    "self-loop": ([(1, 0, 0, 1, 0), (1, 0, 0, 2, 0), (2, 0, 0, 3, 1)], False, 1, 2, [2, 1]),
    "repeated edge": ([(1, 0, 0, 2, 1), (2, 1, 0, 1, 0), (1, 0, 0, 2, 1)], False, 1, 3, [1]),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_fixture(spark, name):
    rows, directed, s, most, want = FIXTURES[name]
    found = mine_codes(graph(spark, rows, directed), s, most)
    assert sizes(found) == want
    assert found == frequent(rows, directed, s, most)


@pytest.mark.parametrize("seed", range(2))
def test_random_graph(spark, seed):
    r = random.Random(seed)
    label = [r.randint(0, 1) for _ in range(5)]
    rows = [(u, label[u], r.randint(0, 1), v, label[v]) for u, v in ((r.randrange(5), r.randrange(5)) for _ in range(7))]
    assert mine_codes(graph(spark, rows, seed == 0), 1, 3) == frequent(rows, seed == 0, 1, 3)


def test_support_shrinks_with_growth_and_orbits_share_domains(spark):
    rows = drawn([(0, 1), (1, 2), (2, 0), (2, 3), (3, 0), (0, 4)], {0: 0, 1: 0, 2: 1, 3: 1, 4: 1})
    adj = graph(spark, rows)
    found = mine_codes(adj, 1, 3)
    for code, support in found.items():
        if len(code) > 1:
            assert found[code[:-1]] >= support
    wedge = canonical_code([Edge(0, 1, 1, 0, 0), Edge(0, 2, 1, 0, 0)])
    values = {}
    for pos, vid in match.domains(match.embeddings(adj, wedge)).collect():
        values.setdefault(pos, set()).add(vid)
    leaves = [k for k in values if values[k] != values[0]] or [1, 2]
    assert values[leaves[0]] == values[leaves[-1]]


def test_arguments_and_empty_graph(spark):
    empty = graph(spark, [])
    assert mine(empty, 1, 2).count() == 0
    for s, most in ((0, 2), (1, 0)):
        with pytest.raises(ValueError):
            mine_codes(empty, s, most)


def test_vertex_with_two_labels_is_still_one_vertex(spark):
    rows = [(1, 0, 0, 2, 1), (2, 2, 0, 3, 0), (2, 1, 0, 3, 0)]
    found = mine_codes(graph(spark, rows), 1, 2)
    wedge = canonical_code([Edge(0, 1, 0, 0, 1), Edge(0, 2, 0, 0, 2)])
    assert wedge not in found  # its two leaves would be vertex 2 twice


def test_nulls_make_no_edges_and_self_loops_on_request(spark):
    rows = [(1, 0, 0, 2, 1), (None, 0, 0, 2, 1), (1, 0, None, 2, 1), (3, 0, 0, 3, 0)]
    assert graph(spark, rows).count() == 2
    assert types.edge_type_support(graph(spark, rows, allow_self_loops=True)).where("src_label = dst_label").first()["support"] == 1


def test_two_edges_are_counted_without_enumeration(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("enumerates")

    r = random.Random(3)
    label = [r.randint(0, 2) for _ in range(12)]
    rows = drawn([(r.randrange(12), r.randrange(12)) for _ in range(16)] + [(0, k) for k in range(1, 9)], label)
    want = frequent(rows, False, 1, 2)
    directed = frequent(rows, True, 1, 2) if not any((v, u) in {(a[0], a[3]) for a in rows} for u, _, _, v, _ in rows) else None
    monkeypatch.setattr(match, "grow", refuse)
    for part in (1 << 30, 30):  # all rows by one job, and slice by slice
        monkeypatch.setattr(store, "SLICE_ROWS", part)
        assert mine_codes(graph(spark, rows), 1, 2) == want
        if directed is not None:
            assert mine_codes(graph(spark, rows, True), 1, 2) == directed


def test_wedges_of_parallel_edges(spark):
    r = random.Random(4)
    label = [r.randint(0, 1) for _ in range(7)]
    rows = [(u, label[u], r.randint(0, 1), v, label[v]) for u, v in ((r.randrange(7), r.randrange(7)) for _ in range(18)) if u != v]
    adj = graph(spark, rows)
    want = {c: s for c, s in frequent(rows, False, 1, 2).items() if len(c) == 2 and c[1].forward}
    pairs = {c: wedge_types(c) for c in want}
    found = match.wedge_supports(adj, adj.count(), pairs.values())
    assert {c: found[p] for c, p in pairs.items()} == want


def rows_made_by_joins(spark, run):
    """What ``run`` returns, and the rows that joins put out meanwhile."""
    kept, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    seen = kept.executionsList().size()
    found = run()
    bus.waitUntilEmpty(30_000)
    made = 0
    for k in range(seen, kept.executionsList().size()):
        number = kept.executionsList().apply(k).executionId()
        values, nodes = kept.executionMetrics(number), kept.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = node.metrics()
            for metric in map(metrics.apply, range(metrics.size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return found, made


def test_cliques_around_a_hub_are_found_without_pairs_of_its_neighbours(spark):
    fours = [(a, b) for k in (1000, 2000) for a in range(k, k + 4) for b in range(a + 1, k + 4)]
    pairs = [(0, v) for v in range(1, 400)] + fours + [(0, 1000), (0, 1001)]
    adj = graph(spark, drawn(pairs, [1] * 2004))
    code = canonical_code([Edge(i, j, 1, 0, 1) for i in range(4) for j in range(i + 1, 4)])
    found, made = rows_made_by_joins(spark, lambda: match.support(adj, code).first()["support"])
    assert found == 8 and made < 10 * len(pairs)


@pytest.mark.parametrize("n", [3, 4, 5])
def test_cliques_of_random_graphs(spark, monkeypatch, n):
    monkeypatch.setattr(store, "SLICE_ROWS", 150)
    r = random.Random(n)
    pairs = {tuple(sorted(r.sample(range(40), 2))) for _ in range(260)} | {(a, b) for a in range(5) for b in range(a + 1, 5)}
    rows = drawn([p if r.random() < 0.5 else p[::-1] for p in sorted(pairs)], [1] * 40) + [(50, 1, 0, 51, 1), (51, 1, 1, 52, 1), (50, 1, 0, 52, 1), (7, 1, 0, 60, 2)]
    adj = graph(spark, rows)
    near = {v: {b for a, b in pairs | {(b, a) for a, b in pairs} if a == v} for v in range(40)}
    cliques = [{v} for v in near]
    for _ in range(n - 1):
        cliques = [c | {v} for c in cliques for v in set.intersection(*(near[x] for x in c)) if v > max(c)]
    code = canonical_code([Edge(i, j, 1, 0, 1) for i in range(n) for j in range(i + 1, n)])
    want = len(set().union(*cliques))
    assert want and match.support(adj, code).first()["support"] == want == match.support(adj.where("src < dst"), code).first()["support"]
