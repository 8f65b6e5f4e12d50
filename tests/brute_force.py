"""The specification by enumeration: all connected edge subsets of the data, all injective maps."""

from itertools import permutations

from graphmine.functions.pattern import Edge, canonical_code, n_vertices, vertex_labels


def frequent(rows, directed, min_support, max_edges):
    label = {}
    for u, lu, _, v, lv in rows:
        label[u], label[v] = lu, lv
    edges = {(u, v, e, 1) if directed else (min(u, v), max(u, v), e, 0) for u, _, e, v, _ in rows if u != v}
    codes, frontier = set(), {frozenset([x]) for x in edges}
    for _ in range(max_edges):
        for some in frontier:
            number = {v: k for k, v in enumerate(sorted({x for a in some for x in a[:2]}))}
            codes.add(canonical_code([Edge(number[u], number[v], label[u], e, label[v], d) for u, v, e, d in some]))
        frontier = {some | {x} for some in frontier for x in edges - some if {x[0], x[1]} & {v for a in some for v in a[:2]}}
    views = edges | {(v, u, e, -d) for u, v, e, d in edges}
    out = {}
    for code in codes:
        want, n = vertex_labels(code), n_vertices(code)
        domains = [set() for _ in range(n)]
        for at in permutations(label, n):
            if all(label[v] == x for v, x in zip(at, want, strict=True)) and all((at[e.i], at[e.j], e.el, e.d) in views for e in code):
                for k, v in enumerate(at):
                    domains[k].add(v)
        support = min(map(len, domains))
        if support >= min_support:
            out[code] = support
    return out
