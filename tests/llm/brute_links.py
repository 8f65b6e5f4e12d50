"""Near copies by comparing every document with every other that shares a shingle."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components(docs):
    """(id, set size, least id of the component) of each document."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += 1
            holders[x].append(k)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        root = find(k)
        known = least.get(root)
        least[root] = i if known is None else known if i is None else min(known, i)
    return [(i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def link_counts(docs):
    """(id, number of other rows that it links with) of each document."""
    sets = [shingles(t) for _, t in docs]
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    return [(i, sum(near(sets[k], s) for j, s in enumerate(sets) if j != k)) for k, (i, _) in enumerate(docs)]
