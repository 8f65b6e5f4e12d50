import random
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphmine.functions import pattern as p
from graphmine.functions.pattern import Edge, EdgeType, canonical_code, is_canonical


@st.composite
def graphs(draw):
    n = draw(st.integers(2, 5))
    labels = [draw(st.integers(0, 1)) for _ in range(n)]
    directed = draw(st.booleans())
    edges = set()
    for v in range(1, n):
        edges.add((draw(st.integers(0, v - 1)), v, draw(st.integers(0, 1)), draw(st.sampled_from([-1, 1])) if directed else 0))
    for _ in range(draw(st.integers(0, 3))):
        u, v = draw(st.integers(0, n - 1)), draw(st.integers(0, n - 1))
        if u < v:
            edges.add((u, v, draw(st.integers(0, 1)), draw(st.sampled_from([-1, 1])) if directed else 0))
    return [Edge(u, v, labels[u], e, labels[v], d) for u, v, e, d in sorted(edges)]


@given(graphs(), st.randoms())
@settings(max_examples=150, deadline=None)
def test_code_does_not_depend_on_numbering(edges, rnd):
    code = canonical_code(edges)
    number = list(range(p.n_vertices(tuple(edges))))
    rnd.shuffle(number)
    again = [Edge(number[e.i], number[e.j], *e[2:]) for e in edges]
    again = [e.reversed() if rnd.random() < 0.5 else e for e in again]
    rnd.shuffle(again)
    assert canonical_code(again) == code
    assert is_canonical(code) and len(code) == len(edges) and p.has_potential(code)


@given(graphs())
@settings(max_examples=100, deadline=None)
def test_prefixes_are_canonical_and_reached(edges):
    code = canonical_code(edges)
    types = {EdgeType(x.il, x.el, x.jl, x.d) for e in code for x in (e, e.reversed())}
    assert code[:1] in p.seeds(types)
    for k in range(1, len(code)):
        assert is_canonical(code[:k])
        assert code[: k + 1] in p.extensions(code[:k], types)


@given(graphs(), graphs())
@settings(max_examples=100, deadline=None)
def test_equal_codes_mean_isomorphic(one, two):
    def isomorphic(a, b):
        n = p.n_vertices(tuple(a))
        if n != p.n_vertices(tuple(b)) or len(a) != len(b):
            return False
        la, lb = p.vertex_labels(tuple(a)), p.vertex_labels(tuple(b))
        names = {p._name(e) for e in b}
        return any(all(la[v] == lb[m[v]] for v in range(n)) and {p._name(e._replace(i=m[e.i], j=m[e.j])) for e in a} == names for m in permutations(range(n)))

    assert (canonical_code(one) == canonical_code(two)) == isomorphic(one, two)


def test_four_clique_keeps_its_second_cycle_edge():
    k4 = canonical_code([Edge(i, j, 0, 0, 0) for i in range(4) for j in range(i + 1, 4)])
    assert p.text(k4) == "(0,1,0,0,0,0)(1,2,0,0,0,0)(2,0,0,0,0,0)(2,3,0,0,0,0)(3,0,0,0,0,0)(3,1,0,0,0,0)"
    assert p.orbits(k4) == [0, 0, 0, 0] and p.join_steps(k4) == ["extend", "close", "after_cycle", "close", "close_again"]
    assert p.right_path(k4) == [0, 1, 2, 3]


def test_parts_of_codes():
    path = canonical_code([Edge(0, 1, 1, 5, 2), Edge(1, 2, 2, 6, 3)])
    assert p.parse(p.text(path)) == path
    assert p.edges_at(path, 1) == list(path) and p.on_right_path(path, 2) and p.last_cycle_target(path) is None
    assert p.previous_discovery(path) == path[-1]
    with pytest.raises(ValueError):
        p.extend(path, Edge(2, 3, 9, 0, 1))
    with pytest.raises(ValueError):
        p.extend(path, Edge(2, 5, 3, 0, 1))
    longer = p.extend(path, Edge(2, 3, 3, 0, 1))
    assert p.code_rank(longer) < p.code_rank(path)
    assert path[0].other_end(0) == 1 and path[0].shifted(2).i == 2 and p.make_edge(0, 1, 1, 1, 2, True, False).d == p.IN
    assert p.query_graph_text(path, 3) == "t 3 3 4\n0 1 1 1\n1 2 2 0 2\n2 3 1 1\n"
    assert p.pattern_line(path[:1], 7) == "FrequentGraph (DFSCode (Edge (0, 1, 1, 5, 2, 0)  F ), freq 7)"


def test_orbits_respect_direction():
    out = canonical_code([Edge(0, 1, 0, 0, 0, 1), Edge(0, 2, 0, 0, 0, 1)])
    assert sorted(p.orbits(out)).count(0) == 1 and len(set(p.orbits(out))) == 2
    assert len(set(p.orbits(canonical_code([Edge(0, 1, 0, 0, 0, 1)])))) == 2
    random.seed(0)
