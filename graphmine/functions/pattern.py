"""Patterns as DFS codes.

A code is a tuple of edges; edge (i, j) with i < j discovers vertex j, with i > j it closes a cycle.  One total order
ranks the edges that can follow the same prefix: cycle edges first, by target, then direction (OUT before IN), then edge
label; discoveries from deeper vertices first, then direction, then labels.  The canonical code of a pattern is
the least one in that order, found by keeping every partial traversal that still spells the least prefix.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from typing import NamedTuple

#: Directions of an edge as seen from its first vertex.
IN, ANY, OUT = -1, 0, 1


class Edge(NamedTuple):
    i: int
    j: int
    il: int
    el: int
    jl: int
    d: int = ANY

    @property
    def forward(self) -> bool:
        return self.i < self.j

    def rank(self) -> tuple:
        """Place among the edges that can follow one prefix."""
        return (1, -self.i, -self.d, self.il, self.el, self.jl) if self.forward else (0, self.j, -self.d, self.el)

    def other_end(self, v: int) -> int:
        return self.j if v == self.i else self.i

    def reversed(self) -> Edge:
        return Edge(self.j, self.i, self.jl, self.el, self.il, -self.d)

    def as_start(self) -> Edge:
        """The least first edge of a code that this edge can be."""
        one, two = Edge(0, 1, self.il, self.el, self.jl, self.d), Edge(0, 1, self.jl, self.el, self.il, -self.d)
        return min(one, two, key=Edge.rank)

    def shifted(self, by: int) -> Edge:
        return self._replace(i=self.i + by, j=self.j + by)

    def compatible(self, d: int) -> bool:
        return self.d == d

    def __str__(self) -> str:
        return f"({self.i},{self.j},{self.il},{self.el},{self.jl},{self.d})"


Code = tuple[Edge, ...]


def make_edge(i: int, j: int, il: int, el: int, jl: int, directed: bool = False, outgoing: bool = True) -> Edge:
    return Edge(i, j, il, el, jl, (OUT if outgoing else IN) if directed else ANY)


def text(code: Code) -> str:
    return "".join(map(str, code))


def parse(line: str) -> Code:
    return tuple(Edge(*map(int, part.split(","))) for part in line.strip("()").split(")("))


def vertex_labels(code: Code) -> list[int]:
    found: dict[int, int] = {}
    for e in code:
        for v, label in ((e.i, e.il), (e.j, e.jl)):
            if found.setdefault(v, label) != label:
                raise ValueError(f"vertex {v} has two labels in {text(code)}")
    return [found[v] for v in range(len(found))]


def n_vertices(code: Code) -> int:
    return 1 + max(max(e.i, e.j) for e in code)


def code_rank(code: Code) -> tuple:
    """Output order: longer codes first, then edge by edge."""
    return (-len(code), [e.rank() for e in code])


def right_path(code: Code) -> list[int]:
    """Vertices from the first to the last discovered one along discovery edges."""
    parent = {e.j: e.i for e in code if e.forward}
    path = [n_vertices(code) - 1]
    while path[-1]:
        path.append(parent[path[-1]])
    return path[::-1]


def on_right_path(code: Code, v: int) -> bool:
    return v in right_path(code)


def edges_at(code: Code, v: int) -> list[Edge]:
    return [e for e in code if v in (e.i, e.j)]


def last_cycle_target(code: Code) -> int | None:
    """Target of the cycle edges at the end of the code, if it ends with one."""
    return code[-1].j if code and not code[-1].forward else None


def previous_discovery(code: Code) -> Edge | None:
    return next((e for e in reversed(code) if e.forward), None)


def admits_cycle_edge(code: Code, e: Edge) -> bool:
    """Can a cycle edge follow the code: from the last vertex to its right path, not there already, not before the last one."""
    path = right_path(code)
    if e.forward or e.i != path[-1] or e.j not in path[:-1] or same_edge_in(code, e):
        return False
    return code[-1].forward or code[-1].rank() < e.rank()


def same_edge_in(code: Code, e: Edge) -> bool:
    return any((x.i, x.j, x.el, x.d) in ((e.i, e.j, e.el, e.d), (e.j, e.i, e.el, -e.d)) for x in code)


def extend(code: Code, e: Edge) -> Code:
    """The code with ``e`` behind it; labels must fit and a discovery must name the next vertex."""
    labels = vertex_labels(code)
    if e.forward and e.j != len(labels):
        raise ValueError("a discovery names the next vertex")
    if e.i >= len(labels) or labels[e.i] != e.il or (not e.forward and labels[e.j] != e.jl):
        raise ValueError("labels do not fit")
    return (*code, e)


def has_potential(code: Code) -> bool:
    """No edge could start a lesser code than the first one does."""
    return all(code[0].rank() <= e.as_start().rank() for e in code)


def adjacency(code: Code) -> list[list[Edge]]:
    """For each vertex its edges, seen from it."""
    out: list[list[Edge]] = [[] for _ in range(n_vertices(code))]
    for e in code:
        out[e.i].append(e)
        out[e.j].append(e.reversed())
    return out


def _steps(traversal: tuple, labels: list[int], near: list[list[Edge]]) -> Iterator[tuple[Edge, tuple]]:
    """Edges that can follow a partial traversal (order of vertices, edges used, right path), with the traversal after each."""
    order, used, path = traversal
    place = {v: k for k, v in enumerate(order)}
    last = path[-1]
    for e in near[last]:
        name = _name(e)
        if name not in used and e.j in path:
            k = place[e.j]
            yield Edge(place[last], k, labels[last], e.el, labels[e.j], e.d), (order, used | {name}, path)
    for at in range(len(path) - 1, -1, -1):
        v = path[at]
        for e in near[v]:
            if e.j not in place:
                yield Edge(place[v], len(order), labels[v], e.el, labels[e.j], e.d), ((*order, e.j), used | {_name(e)}, (*path[: at + 1], e.j))


def _name(e: Edge) -> tuple:
    return (e.i, e.j, e.el, e.d) if e.i < e.j else (e.j, e.i, e.el, -e.d)


_canonical: dict[Code, Code] = {}


def canonical_code(edges: Iterable[Edge]) -> Code:
    """The least code of the connected pattern that ``edges`` draw (any vertex numbers from 0 on)."""
    code = tuple(edges)
    if code in _canonical:
        return _canonical[code]
    labels, near = vertex_labels(code), adjacency(code)
    live = [((v,), frozenset(), (v,)) for v in range(len(labels))]
    out: list[Edge] = []
    for _ in code:
        steps = [(e, t) for traversal in live for e, t in _steps(traversal, labels, near)]
        if not steps:
            raise ValueError("the pattern is not connected")
        least = min(e.rank() for e, _ in steps)
        out.append(next(e for e, _ in steps if e.rank() == least))
        live = list({t: None for e, t in steps if e.rank() == least})
    if len(_canonical) > 200_000:
        _canonical.clear()
    _canonical[code] = tuple(out)
    return tuple(out)


def is_canonical(code: Code) -> bool:
    return canonical_code(code) == code


class EdgeType(NamedTuple):
    """Labels and direction that an edge of the data has, seen from its source."""

    src_label: int
    edge_label: int
    dst_label: int
    d: int


def extensions(code: Code, types: Iterable[EdgeType]) -> list[Code]:
    """Canonical codes with one edge more whose last edge is of one of ``types``."""
    labels, path = vertex_labels(code), right_path(code)
    by_source: dict[int, list[EdgeType]] = {}
    for t in types:
        by_source.setdefault(t.src_label, []).append(t)
    out = []
    last = path[-1]
    for t in by_source.get(labels[last], []):
        for j in path[:-1]:
            e = Edge(last, j, labels[last], t.edge_label, t.dst_label, t.d)
            if labels[j] == t.dst_label and admits_cycle_edge(code, e):
                out.append((*code, e))
    for i in path:
        out += [(*code, Edge(i, len(labels), labels[i], t.edge_label, t.dst_label, t.d)) for t in by_source.get(labels[i], [])]
    return [c for c in out if has_potential(c) and is_canonical(c)]


def seeds(types: Iterable[EdgeType]) -> list[Code]:
    """Canonical one-edge codes of the types, in order."""
    found = {(Edge(0, 1, t.src_label, t.edge_label, t.dst_label, t.d),) for t in types}
    return sorted((c for c in found if is_canonical(c)), key=lambda c: c[0].rank())


def automorphisms(code: Code) -> list[tuple[int, ...]]:
    """Vertex permutations that keep labels, edges and directions."""
    labels = vertex_labels(code)
    edges = {_name(e) for e in code}
    classes: dict[int, list[int]] = {}
    for v, label in enumerate(labels):
        classes.setdefault(label, []).append(v)

    def maps(groups: list[list[int]]) -> Iterator[dict[int, int]]:
        if not groups:
            yield {}
            return
        for rest in maps(groups[1:]):
            for p in permutations(groups[0]):
                yield rest | dict(zip(groups[0], p, strict=True))

    return [tuple(m[v] for v in range(len(labels))) for m in maps(list(classes.values())) if {_name(e._replace(i=m[e.i], j=m[e.j])) for e in code} == edges]


def orbits(code: Code) -> list[int]:
    """For each vertex the least vertex that an automorphism maps it to; vertices of an orbit have equal domains."""
    return [min(p[v] for p in automorphisms(code)) for v in range(n_vertices(code))]


def join_steps(code: Code) -> list[str]:
    """How each edge after the first is joined: ``extend``, ``sibling``, ``close``, ``close_again`` or ``after_cycle``."""
    out = []
    for before, e in zip(code, code[1:], strict=False):
        if not e.forward:
            out.append("close" if before.forward else "close_again")
        else:
            out.append("after_cycle" if not before.forward else "extend" if e.i == before.j else "sibling")
    return out


def pattern_line(code: Code, support: int) -> str:
    """One line of the result listing."""
    edges = ",".join(f"Edge ({e.i}, {e.j}, {e.il}, {e.el}, {e.jl}, {e.d})  {'F' if e.forward else 'B'} " for e in code)
    return f"FrequentGraph (DFSCode ({edges}), freq {support})"


def query_graph_text(code: Code, index: int = 0) -> str:
    """The pattern as a query graph: a head line, then id, label, degree and neighbours of each vertex."""
    labels, near = vertex_labels(code), adjacency(code)
    rows = [f"t {index} {len(labels)} {2 * len(code)}"]
    rows += [" ".join(map(str, [v, labels[v], len(near[v]), *sorted(e.j for e in near[v])])) for v in range(len(labels))]
    return "\n".join(rows) + "\n"
