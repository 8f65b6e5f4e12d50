"""Operators 3 and 4 and the components under them, against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

import brute_links
from graphmine.llm import line_dedup, ngram_join
from graphmine.llm.components import components
from llm_rows import as_rows


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_components_of_random_links(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(-40, 40), rnd.randrange(-40, 40)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)] + [(None, 3), (3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for v in sorted(near):
        stack = [v] if v not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = v
                stack += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_on_awkward_rows(docs, rows, clashing):
    want = in_order(brute_links.components([r[:2] for r in rows]))
    got = ngram_join.join_components(docs).collect()
    assert in_order([r[:3] for r in map(tuple, got)]) == want
    assert in_order([(r.doc_id, r.n_links) for r in got]) == in_order(brute_links.link_counts([r[:2] for r in rows]))
    assert as_rows(ngram_join.join_components(clashing), "doc_id", "n_shingles", "component_id") == want


@pytest.mark.parametrize("seed, small", [(0, 4), (1, 12)])
def test_join_with_crowds(spark, seed, small):
    """Crowds of near copies around the threshold, with batches and blocks so small that every path is taken."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(words) for _ in range(n)] for n in (6, 12, 40, 90, 150)]
    hot = [rnd.choice(words) for _ in range(13)]
    rows = []
    for i in range(350):
        text = list(rnd.choice(base)) if rnd.random() < 0.7 else [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 5) if len(text) > 5 else 0):
            k = rnd.randrange(len(text))
            text[k : k + rnd.randint(0, 1)] = [rnd.choice(words)]
        rows.append((i, " ".join(text + (hot if rnd.random() < 0.4 else []))))
    got = ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batch_docs=25, small=small, block_sets=16)
    got = got.collect()
    assert in_order([r[:3] for r in map(tuple, got)]) == in_order(brute_links.components(rows))
    assert in_order([(r.doc_id, r.n_links) for r in got]) == in_order(brute_links.link_counts(rows))


def test_join_of_repeated_rows(spark):
    """Many copies of two near texts under null and equal ids: one set each, and one row stays."""
    base = [f"w{k}" for k in range(60)]
    one, two = " ".join(base), " ".join([*base, "more"])
    rows = [(None, one)] * 700 + [(7, two)] * 700 + [(None, two)] * 300 + [(9, "alone"), (9, one), (3, ""), (3, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.join_components(df)
    want = {(56 if t == one else 57 if t == two else 1 if t else 0, 7 if t in (one, two) else i, 1700 if t in (one, two) else 0) for i, t in rows}
    assert {(r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == want and got.count() == len(rows)
    assert as_rows(ngram_join.keep_one(df), "doc_id", "text") == as_rows(spark.createDataFrame([(7, two), (9, "alone"), (3, ""), (3, ""), (None, None)], "doc_id long, text string"), "doc_id", "text")


def test_join_of_nothing(empty):
    assert ngram_join.join_components(empty).count() == 0


def test_signatures_meet_for_all_linked_pairs():
    """Pigeonhole: whatever elements differ, a probe of the larger set meets the index of the smaller."""
    rnd = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 8, 9, 10, 17, 33, 80, 200):
        for _ in range(30):
            x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
            out = int(rnd.integers(0, max(1, n // 5) + 1))
            y = np.unique(np.concatenate([x[out:], rnd.integers(0, 1 << 63, int(rnd.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or not ngram_join.linked(len(x), len(y), both):
                continue
            key, who, role = ngram_join.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
            probes, held = (0, 1) if len(x) >= len(y) else (1, 0)
            assert set(key[(who == probes) & (role & 2 > 0)]) & set(key[(who == held) & (role & 1 > 0)])
            assert 9 * ngram_join.least_difference(ngram_join.sketch(x), ngram_join.sketch(y)) <= len(x) + len(y)


def test_sketches_never_exceed_the_difference():
    rnd = np.random.default_rng(6)
    for _ in range(200):
        x, y = (np.unique(rnd.integers(0, 1 << 63, int(rnd.integers(1, 700)), dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        y = np.unique(np.concatenate([y, x[: int(rnd.integers(0, len(x)))]]))
        assert ngram_join.least_difference(ngram_join.sketch(x), ngram_join.sketch(y)) <= len(np.setxor1d(x, y))
        assert ngram_join.least_differences([ngram_join.bitmap(x), ngram_join.bitmap(y)])[0, 1] <= len(np.setxor1d(x, y))


def brute_drops(rows):
    """(id, place) of lines that a component of all lines by exact Jaccard drops."""
    where = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                where[line].append((i, k))
    lines = list(where)
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for k, line in enumerate(lines):
        groups[find(k)] |= set(where[line])
    return {x for g in groups.values() for x in sorted(g)[1:]}


def test_lines_against_brute_force(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "theta", "kappa", "lambda", "zeta"]
    base = [" ".join(rnd.choice(words) for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(40):
        lines = [rnd.choice(base) if rnd.random() < 0.5 else " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(9)) for _ in range(3)]
        lines = [x + "!" if rnd.random() < 0.3 else x for x in lines]
        rows.append((i, "\n".join([*lines, "", "ok"])))
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    drops = brute_drops(rows)
    want = []
    for i, t in rows:
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if (i, k) not in drops]
        want.append((i, "\n".join(left) if any(x.strip() for x in left) else ""))
    assert as_rows(got, "doc_id", "text") == want


@pytest.mark.parametrize("length", [9, 12, 13, 40, 200])
def test_near_lines_without_spaces_meet(spark, length):
    rnd = random.Random(length)
    pairs = []
    for _ in range(300):
        line = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz的一是不了") for _ in range(length))
        pairs.append((line, line + "!" if length < 40 else "?" + line[1:]))
    rows = [(k, t) for k, t in enumerate(x for p in pairs for x in p)]
    done = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("__dropped = 1").collect()
    assert all(r.doc_id % 2 for r in done) and len(done) >= 297


def test_lines_of_awkward_rows(docs, clashing, empty):
    done = line_dedup.dedup(clashing)
    assert done.columns == [*clashing.columns, "__lines", "__dropped"] and done.count() == docs.count()
    got = {r.doc_id: r for r in done.where("doc_id >= 100").collect()}
    assert got[100].text is None and got[100]["__lines"] == 0 and got[101].text == "" and got[102].text == " \n\t "
    assert line_dedup.dedup(empty).count() == 0
    shared = [r for r in done.collect() if r.text and "a line that many" in r.text]
    assert len({r.doc_id for r in shared}) == 1


def test_repetitive_lines_and_templates(spark):
    """Equal sets of unequal length, and near copies in a crowd of lines with a common part, which a band's least line is unlike."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    common = " ".join(word() for _ in range(10))
    rows = [(0, "ab" * 50), (1, "ab" * 75), (2, "Then " * 400), (3, "Then " * 90)]
    for k in range(150):
        line = " ".join([common, *(word() for _ in range(3))])
        rows += [(10 + 2 * k, line), (11 + 2 * k, line[:-1])]
    gone = brute_drops(rows)
    got = {r.doc_id for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("__dropped = 1").collect()}
    assert {1, 3} <= got and got <= {i for i, _ in gone} and len(got) >= 0.99 * len(gone)


def test_members_that_the_least_line_of_a_band_leaves_apart_are_compared(spark):
    import random

    from graphmine.llm import line_dedup

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common, lines = " ".join(word(7) for _ in range(12)), []
    for _ in range(60):
        line = f"{common} {word(7)} {word(7)} {word(7)}"
        lines += [line, line[:20] + "#" + line[21:-12] + "#" + line[-11:]]
    bands, _ = line_dedup.signatures(lines)
    root = list(range(len(lines)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(lines)):
        for j in range(i):
            both, either = (int(x[0]) for x in line_dedup.jaccard_counts([lines[i]], [lines[j]]))
            if 100 * both >= line_dedup.THRESHOLD * either and (bands[i] == bands[j]).any():
                root[top(i)] = top(j)
    parts = len({top(k) for k in range(len(lines))})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.dedup(docs).where("__dropped = 0").count() == parts < len(lines)


def test_a_crowd_of_near_lines_makes_one_tie_a_line(spark, monkeypatch):
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common = " ".join(word() for _ in range(40))
    docs = spark.createDataFrame([(k, f"{common} {k:04d}") for k in range(400)], "doc_id long, text string")
    read, verified = [], line_dedup.verified

    def counted(pairs, texts):
        read.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(line_dedup, "verified", counted)
    assert line_dedup.dedup(docs).where("__dropped = 0").count() == 1 and sum(read) <= 400


def test_rounds_of_components_leave_one_table(spark):
    import glob

    from graphmine.llm import runtime

    folder = runtime.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/links-*"))
    label = components(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"))
    assert label.where("component = 0").count() == 61 and len(set(glob.glob(f"{folder}/links-*")) - before) == 1


def test_a_written_table_frees_the_garbage_on_the_driver(spark):
    from graphmine.llm import runtime

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    assert runtime.materialize(spark.range(3), "test-garbage").count() == 3 and whole() > before


def test_maps_never_exceed_the_difference():
    rnd = random.Random(3)
    lines = ["", "ab", "abcde", "ab" * 50, "ab" * 75]
    for n in (9, 60, 300, 3000):
        line = "".join(rnd.choice("abcdefgh") for _ in range(n))
        lines += [line, line[1:] + "!", line[: n // 2] + "?" + line[n // 2 :]]
    sizes, maps = line_dedup.parity_maps(lines)
    alone = [line_dedup.parity_maps([x]) for x in lines]
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in lines]
    assert list(sizes) == [len(x) for x in sets] == [int(n[0]) for n, _ in alone]
    assert all((maps[i] == m[0]).all() for i, (_, m) in enumerate(alone))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert sum(int(w).bit_count() for w in (maps[i] ^ maps[j]).view(np.uint64)) <= len(x ^ y)


def test_a_crowd_of_unlike_lines_makes_few_pairs(spark, monkeypatch):
    """Lines with a common part, no two of which link: the full comparison leaves hardly any pair to verify."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    common = " ".join(word() for _ in range(24))
    lines = [" ".join([common, *(word() for _ in range(6))]) for _ in range(150)]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    assert 0.6 < min(len(x & y) / len(x | y) for x in sets for y in sets) and max(len(x & y) / len(x | y) for x in sets for y in sets if x is not y) < 0.8
    read, verified = [], line_dedup.verified

    def counted(pairs, texts):
        read.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(line_dedup, "verified", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert line_dedup.dedup(docs).where("__dropped = 0").count() == len(lines) and sum(read) <= len(lines)
