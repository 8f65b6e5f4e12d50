"""N-gram Jaccard join: universe partition, pigeonhole, exact verification.

A document is the set of hashes of its distinct five-word shingles.  Sets fall into size bands, each a quarter
wider than the last, so that two sets with Jaccard 0.8 lie in one band or in neighbouring ones.  A band cuts the hash
universe into ``m`` ranges (segments).  Two sets of sizes a <= b that link differ in at most (a + b) / 9 elements; so
of segments with weights that add up to one more than that, one segment of weight 1 is equal on both sides, or one of weight 2
differs in one element at most and is found in the one-deletion neighbourhood.  The smaller set is indexed by all its
segments, with the deletions of some; the larger one probes with the cheapest choice of weights.  A segment costs as
many sets as are thought to share it: the least number of sets of the map batch that one of its elements occurs in, and without
end if it is empty; of equal costs the larger segment is taken.  Any choice of enough weight finds all links, so costs need not be
agreed on.

Signatures travel as packed arrays.  A signature of up to ``SMALL`` pairs gives them all; a more frequent one gives a
star around its least set (in the map batch first, so that a hot group leaves each batch as one row) and the list of
its members.  Pairs are verified on the exact sets, best partner first; pairs inside one component are
not tried again.  Members of frequent signatures that stay in different components are compared in blocks: crowds
with one centre are cut into blocks of bounded size, and the bitmaps of each two blocks meet in one task, where their differences rule out nearly all that don't link.

Links are counted once components are whole, since both ends of a link lie in one: the sets of a component meet block by block, and
the products of their membership matrices give all intersections exactly.  Counts come out, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmine.llm import runtime
from graphmine.llm.components import components
from graphmine.llm.kept import Kept, sole

WORDS = 5
U = np.uint64
#: Documented parameters: spare weight of a band in hundredths (segments, deletions); most pairs of a signature that
#: are written outright; documents and words of a map batch; text bytes for each partition of signatures.
SPARE, DELETIONS, SMALL = 5, 6, 64
BATCH_DOCS, BATCH_WORDS, PARTITION_BYTES = 2000, 600_000, 8_000_000
#: Members and set elements that a block of a crowd is aimed at.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 400_000
BUCKETS_PER_PARTITION = 2
CACHED_WORDS = 200_000
_NEVER = 1 << 40
INDEX, PROBE, HOT = 1, 2, 4


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def band_limits(largest: int) -> list[int]:
    """Largest size of each band; band k holds sizes above limit k - 1."""
    out = [0, 1]
    while out[-1] < largest:
        out.append(math.ceil(1.25 * out[-1]))
    return out


_LIMITS = np.array(band_limits(1 << 40), np.int64)


def band_segments(limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of a band, and how many of them (the first) are indexed with their deletions."""
    need = (limit + limit * 5 // 4) // 9 + 1
    return need + need * SPARE // 100 + 1, need * DELETIONS // 100 + 1


def shingle_sets(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and where each text's begin (one more at the end).

    A text of fewer than ``n`` words is one shingle, the whole sequence; without words it is empty.
    """
    look = sole("word hashes", lambda: Kept(xxhash.xxh3_64_intdigest, CACHED_WORDS)).__getitem__
    parts = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    w = np.fromiter((x for p in parts for x in map(look, p)), U, int(counts.sum()))
    ends = np.cumsum(counts)
    total = len(w)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    if total >= n:
        h = w[: total - n + 1].copy()
        for k in range(1, n):
            h = mix(h) + w[k : total - n + 1 + k]
        h = mix(h)
    for d, (end, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if c >= n:
            one = np.sort(h[end - c : end - n + 1])
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        elif c:
            x = np.array([c], U)
            for k in range(end - c, end):
                x = mix(x) + w[k : k + 1]
            one = mix(x + U(0x5851F42D4C957F2D))
        else:
            continue
        sets.append(one)
        sizes[d] = len(one)
    return np.concatenate(sets) if sets else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)])


def set_class(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set, the same for equal sets."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ U(0xD6E8FEB86659FD93)), dtype=U)])
    return mix(total[starts[1:]] - total[starts[:-1]] + np.diff(starts).astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _segment_keys(sums: np.ndarray, band: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(sums + mix(band.astype(U) * U(0x9E3779B97F4A7C15) + place.astype(U) * U(0xC2B2AE3D27D4EB4F)))


def signatures(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set number, role) of all sets' signatures: as members of their own band, and as the larger set of the band below."""
    sizes = np.diff(starts)
    own = np.searchsorted(_LIMITS, sizes)
    out = []
    token_mix = mix(sets + U(0x2545F4914F6CDD1D))
    _, same, times = np.unique(sets, return_inverse=True, return_counts=True)
    common = times[same]
    high = sets >> U(32)
    for below in (0, 1):
        band = own - below
        live = np.flatnonzero((sizes > 0) & (band > 0) & ((_LIMITS[band] * 5 >= sizes * 4) if below else True))
        if not len(live):
            continue
        limit = _LIMITS[band[live]]
        m, deletions = band_segments(limit)
        first = np.concatenate([[0], np.cumsum(m)])
        owner = np.repeat(np.arange(len(live)), sizes[live])
        token = np.repeat(starts[live] - np.concatenate([[0], np.cumsum(sizes[live])[:-1]]), sizes[live]) + np.arange(len(owner))
        place = ((high[token] * m[owner].astype(U)) >> U(32)).astype(np.int64)
        segment = first[owner] + place
        count = np.bincount(segment, minlength=first[-1])
        seg_owner = np.repeat(np.arange(len(live)), m)
        seg_place = np.arange(first[-1]) - first[seg_owner]
        begin = np.cumsum(count) - count
        # a segment's elements are neighbours in the sorted set
        run = np.concatenate([np.zeros(1, U), np.cumsum(token_mix[token], dtype=U)])
        sums = run[begin + count] - run[begin]
        seg_band = band[live][seg_owner]
        keys = _segment_keys(sums, seg_band, seg_place)
        deletable = np.flatnonzero(seg_place < deletions[seg_owner])
        b = sizes[live]
        need = (b + np.minimum(b, limit)) // 9 + 1
        by_cost = np.lexsort((common[token], segment))
        ranked = np.append(common[token][by_cost], _NEVER)
        cost = np.where(count > 0, ranked[begin], _NEVER)
        cut_cost = np.where(count > 1, ranked[np.minimum(begin + 1, len(ranked) - 1)], _NEVER)
        item_owner = np.concatenate([seg_owner, seg_owner[deletable]])
        item_size = np.concatenate([count, count[deletable] - 1])
        item_cost = np.concatenate([cost, np.maximum(cost, cut_cost)[deletable]])
        order = np.lexsort((-item_size, item_cost, item_owner))
        items = m + deletions
        item_first = np.concatenate([[0], np.cumsum(items)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - item_first[item_owner[order]]
        taken = rank < need[item_owner]
        seg_probe, del_probe = taken[: len(keys)], np.zeros(len(keys), bool)
        del_probe[deletable] = taken[len(keys) :]
        wanted = seg_place < deletions[seg_owner]
        if below:
            wanted &= del_probe
        cut = np.flatnonzero(wanted[segment])
        cut_keys = _segment_keys(sums[segment[cut]] - token_mix[token[cut]], seg_band[segment[cut]], place[cut])
        cut_role = np.where(del_probe[segment[cut]], PROBE, 0) | (0 if below else INDEX)
        role = np.where(seg_probe, PROBE, 0) | (0 if below else INDEX)
        keep = role > 0
        out.append((keys[keep], live[seg_owner[keep]], role[keep]))
        out.append((cut_keys, live[owner[cut]], cut_role))
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out]).astype(np.uint8)


def sketch(elements: np.ndarray) -> bytes:
    """Counts of a set's elements in equal ranges of the hash space, a power of two of them, about two elements each (255 at most)."""
    bits = max(3, (len(elements) // 2).bit_length())
    return np.minimum(np.bincount((elements >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Elements that two sets differ in at least, from their sketches: counts that differ belong to different elements."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if len(a) != len(b):
        small, large = (a, b) if len(a) < len(b) else (b, a)
        if 255 in large:
            return 0
        a, b = small, np.minimum(large.reshape(len(small), -1).sum(1), 255)
    return int(np.abs(a - b).sum())


def bitmap(elements: np.ndarray) -> bytes:
    """Which of equal ranges of the hash space a set has elements in; about eight ranges, a power of two, for an element."""
    bits = max(6, (len(elements) - 1).bit_length() + 3)
    held = np.zeros(1 << bits, bool)
    held[(elements >> U(64 - bits)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def least_differences(bitmaps: list[bytes]) -> np.ndarray:
    """Elements that each two sets differ in at least: ranges that one has elements in and the other has none.

    Longer bitmaps are folded to the shortest, two ranges to one.
    """
    width = min(map(len, bitmaps))
    rows = []
    for x in bitmaps:
        held = np.unpackbits(np.frombuffer(x, np.uint8))
        rows.append(np.packbits(held.reshape(8 * width, -1).any(1)))
    table = np.ascontiguousarray(np.stack(rows)).view(U)
    out = np.zeros((len(rows), len(rows)), np.int32)
    for k in range(len(rows)):
        out[k] = np.bitwise_count(table ^ table[k]).sum(1)
    return out


def linked(n_a, n_b, common):
    """100 * common >= 80 * union."""
    return 100 * common >= 80 * (n_a + n_b - common)


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


ROWS = "bucket int, kind int, payload binary"
#: kind 0: packed signatures; 1: stars of a batch's hot signatures (key, set, size, role, centre); 2: documents.
BASE = "kind int, x long, y long, z long, w long"
#: kind 1: pairs (x > y), times seen, 0; 2: members of frequent signatures (key, set, size << 3 | role, centre); 0: documents (id, size << 1 | null mark, set, hash of the text).
KEY_BITS = 40
#: Columns of a membership matrix that are multiplied at once.
COLUMNS = 4096


def _pack(key: np.ndarray, who: np.ndarray, role: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> bytes:
    seen, local = np.unique(who, return_inverse=True)
    low = key & U((1 << KEY_BITS) - 1)
    return b"".join([np.array([len(key), len(seen)], "<u4").tobytes(), names[seen].astype("<i8").tobytes(), sizes[seen].astype("<u4").tobytes(), low.astype("<u4").tobytes(), (low >> U(32)).astype("u1").tobytes(), local.astype("<u2").tobytes(), role.astype("u1").tobytes()])


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, s = np.frombuffer(payload, "<u4", 2).tolist()
    at, parts = 8, []
    for kind, count in (("<i8", s), ("<u4", s), ("<u4", n), ("u1", n), ("<u2", n), ("u1", n)):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += parts[-1].nbytes
    names, sizes, low, high, local, role = parts
    return low.astype(U) | high.astype(U) << U(32), names[local], sizes[local].astype(np.int64), role


def _map_batch(ids: list[int | None], hashes: list[int], texts: list[str], buckets: int, small: int) -> Iterator[tuple[int, int, bytes]]:
    sets, starts = shingle_sets(texts)
    sizes = np.diff(starts)
    names = set_class(sets, starts)
    spread = xxhash.xxh32_intdigest(repr(ids[:1]))
    rows = np.stack([np.array([i or 0 for i in ids], np.int64), sizes << 1 | np.array([i is None for i in ids], np.int64), names, np.array(hashes, np.int64)], 1)
    yield spread % buckets, 2, rows.tobytes()
    _, first = np.unique(names, return_index=True)
    once = np.zeros(len(names), bool)
    once[first] = True
    some = once & (sizes > 0)
    pick = np.repeat(some, sizes)
    sets, names, sizes = sets[pick], names[some], sizes[some]
    key, who, role = signatures(sets, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(key):
        return
    key &= U((1 << (KEY_BITS + 23)) - 1)
    order = np.lexsort((names[who], key))
    key, who, role = key[order], who[order], role[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    probes, indexed = _products(group, role)
    hot = (probes * indexed > small)[group]
    if hot.any():
        centre = who[np.flatnonzero(new)][group]
        star = np.stack([key[hot].view(np.int64), names[who[hot]], sizes[who[hot]], role[hot].astype(np.int64), names[centre[hot]], sizes[centre[hot]]], 1)
        for k in range(0, len(star), 50_000):
            yield (spread + k) % buckets, 1, star[k : k + 50_000].tobytes()
        stay = ~hot | new
        role = np.where(hot, HOT | INDEX | PROBE, role).astype(np.uint8)[stay]
        key, who = key[stay], who[stay]
    bucket = ((key >> U(KEY_BITS)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, cuts = np.unique(bucket[order], return_index=True)
    for b, at in zip(used.tolist(), np.split(order, cuts[1:]), strict=True):
        yield b, 0, _pack(key[at], who[at], role[at], names, sizes)


def _base_rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    full = [*columns, *([np.zeros(n, np.int64)] * (4 - len(columns)))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in full)], names=["kind", "x", "y", "z", "w"])


def _products(group: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many probing and how many indexed sets each group has."""
    n = int(group[-1]) + 1 if len(group) else 0
    return np.bincount(group, roles & PROBE > 0, n).astype(np.int64), np.bincount(group, roles & INDEX > 0, n).astype(np.int64)


def _reduce(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, roles: np.ndarray, most: int = SMALL) -> Iterator[pa.RecordBatch]:
    """Pairs of rare signatures; stars and members of frequent ones.  Signatures that nothing probes are done with."""
    order = np.lexsort((names, keys))
    keys, names, sizes, roles = keys[order], names[order], sizes[order], roles[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])])
    at = np.flatnonzero(new)
    roles = np.bitwise_or.reduceat(roles, at)
    keys, names, sizes = keys[at], names[at], sizes[at]
    start = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(start) - 1
    probes, indexed = _products(group, roles)
    hot = np.bitwise_or.reduceat(roles, np.flatnonzero(start)) & HOT > 0
    live = (np.bincount(group) > 1) & (probes > 0) & (indexed > 0)
    large = live & (hot | (probes * indexed > most))
    small = (live & ~large)[group]
    pairs = []
    k, n, s, r = keys[small], names[small], sizes[small], roles[small]
    if len(k):
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(head, len(k)))
        g = np.repeat(np.arange(len(head)), count)
        i = np.flatnonzero(r & INDEX > 0)
        i_count = np.bincount(g[i], minlength=len(head))
        i_first = np.cumsum(i_count) - i_count
        p = np.flatnonzero(r & PROBE > 0)
        times = i_count[g[p]]
        left = np.repeat(p, times)
        right = i[np.repeat(i_first[g[p]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
        fit = (left != right) & (s[left] >= s[right]) & _sizes_fit(s[left], s[right])
        x, y = n[left[fit]], n[right[fit]]
        pairs.append(np.stack([np.maximum(x, y), np.minimum(x, y)], 1))
    some = large[group]
    k, n, s, r, g = keys[some], names[some], sizes[some], roles[some], group[some]
    if len(k):
        head = np.concatenate([[True], g[1:] != g[:-1]])
        centre = np.flatnonzero(head)[np.cumsum(head) - 1]
        fit = ~head & _sizes_fit(s, s[centre])
        pairs.append(np.stack([n[fit], n[centre[fit]]], 1))
        yield _base_rows(2, k.view(np.int64), n, s << 3 | (r & 3), n[centre])
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    if len(found):
        order = np.lexsort((found[:, 1], found[:, 0]))
        found = found[order]
        new = np.concatenate([[True], (found[1:] != found[:-1]).any(1)])
        at = np.flatnonzero(new)
        yield _base_rows(1, found[at, 0], found[at, 1], np.diff(np.append(at, len(found))))


def _base_table(docs: DataFrame, batch_docs: int, small: int) -> DataFrame:
    """Documents, candidate pairs and members of frequent signatures, written by one pass over the texts."""
    spark = docs.sparkSession
    runtime.ship(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))
    buckets = BUCKETS_PER_PARTITION * parts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids, hashes, texts):
            rows = list(zip(*_map_batch(ids, hashes, texts, buckets, small), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], names=["bucket", "kind", "payload"])

        ids: list = []
        hashes: list = []
        texts: list = []
        held = 0
        for batch in batches:
            for i, h, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                hashes.append(h)
                texts.append(t)
                held += len(t)
                if len(ids) >= batch_docs or held >= 6 * BATCH_WORDS:
                    yield flush(ids, hashes, texts)
                    ids, hashes, texts, held = [], [], [], 0
        if ids:
            yield flush(ids, hashes, texts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for bucket, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kind == 2:
                    yield _base_rows(0, *np.frombuffer(payload, np.int64).reshape(-1, 4).T)
                elif kind == 1:
                    key, name, n, role, centre, centre_n = np.frombuffer(payload, np.int64).reshape(-1, 6).T
                    b = (key.view(U) >> U(KEY_BITS)) % U(buckets)
                    key = (b << U(KEY_BITS) | key.view(U) & U((1 << KEY_BITS) - 1)).view(np.int64)
                    yield _base_rows(2, key, name, n << 3 | (role & 3), centre)
                    fit = (name != centre) & _sizes_fit(n, centre_n)
                    x, y = np.maximum(name, centre)[fit], np.minimum(name, centre)[fit]
                    order = np.lexsort((y, x))
                    x, y = x[order], y[order]
                    at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
                    yield _base_rows(1, x[at], y[at], np.diff(np.append(at, len(x))))
                else:
                    low, name, n, role = _unpack(payload)
                    held.append((low | U(bucket) << U(KEY_BITS), name, n, role))
        if held:
            yield from _reduce(*(np.concatenate(c) for c in zip(*held, strict=True)), small)

    packed = docs.select("__id", "__hash", "__text").mapInArrow(scan, ROWS)
    path = runtime.new_path(spark, "ngram-base")
    packed.repartition(parts, "bucket").mapInArrow(gather, BASE).write.partitionBy("kind").parquet(path)
    return spark.read.schema(BASE).parquet(path)


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name, n, sketch, bits`` and ``elements`` of the sets of the documents with an id in ``wanted`` (column ``__wanted``), each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), 500):
                sets, starts = shingle_sets(texts[k : k + 500])
                names = set_class(sets, starts)
                cut = starts.tolist()
                each = [sets[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.diff(starts)), pa.array([sketch(x) for x in each], pa.binary()), pa.array([bitmap(x) for x in each], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())], names=["name", "n", "sketch", "bits", "elements"])

    some = docs.join(wanted, docs["__id"].eqNullSafe(wanted["__wanted"]), "left_semi")
    return some.select("__text").mapInArrow(run, "name long, n long, sketch binary, bits binary, elements binary").dropDuplicates(["name"])


def _both_ends(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    left = sets.select(F.col("name").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = sets.select(F.col("name").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", *(f"{c}_{e}" for c in columns for e in "ab"))


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.sort(np.concatenate([x, y]))
                good.append(linked(len(x), len(y), int((both[1:] == both[:-1]).sum())))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return _both_ends(pairs, sets, "elements").mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link: sketches rule most others out, the sets themselves decide on the rest."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            least = np.fromiter(map(least_difference, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(9 * least <= n)) for c in batch.columns[:2]], names=["a", "b"])

    return _exact(runtime.materialize(_both_ends(pairs, sets, "n", "sketch").mapInArrow(near, "a long, b long"), "ngram-near"), sets)


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    la, lb = (label.select(F.col("node").alias(c), F.col("component").alias(f"__{c}")) for c in "ab")
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select(*pairs.columns)


def _block_pairs(table: pa.Table) -> pa.Table:
    """Pairs of different components among the sets of two blocks that their bitmaps don't rule out."""
    name, n, part, minor, block = (table.column(c).to_numpy() for c in ("name", "n", "component", "minor", "block"))
    if not minor.any():
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    least = least_differences(table.column("bits").to_pylist())
    alone = table.column("i").to_numpy()[0] == table.column("j").to_numpy()[0]
    near = (9 * least <= n[:, None] + n[None, :]) & (part[:, None] != part[None, :]) & (minor[:, None] | minor[None, :]) & (name[:, None] > name[None, :]) & (alone | (block[:, None] != block[None, :]))
    x, y = np.nonzero(near)
    return pa.table({"a": name[x], "b": name[y]})


def _between(crowds: DataFrame, sets: DataFrame, block_sets: int) -> DataFrame:
    """Links between components of one crowd (``centre``): pairs found block by block, then verified."""
    tally = crowds.groupBy("centre", "component").agg(F.count("*").alias("here"), F.sum("n").alias("elements"))
    size = tally.groupBy("centre").agg(F.max(F.struct("here", "component")).alias("top"), F.count("*").alias("parts"), F.sum("here").alias("members"), F.sum("elements").alias("elements")).where("parts > 1")
    blocks = F.ceil(F.greatest(F.col("members") / block_sets, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    placed = crowds.join(size.select("centre", F.col("top.component").alias("main"), blocks.alias("blocks")), "centre")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("centre", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "n", "component", (F.col("component") != F.col("main")).alias("minor"))
    near = rows.join(sets.select("name", "bits"), "name").groupBy("centre", "i", "j").applyInArrow(_block_pairs, "a long, b long").distinct()
    return _exact(runtime.materialize(near, "ngram-near"), sets)


def _intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``one`` with each of ``two``, by products of membership matrices over the elements they share."""
    out = np.zeros((len(one), len(two)), np.float64)
    a, b = np.concatenate(one), np.concatenate(two)
    shared = np.intersect1d(a, b)
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two))
    place_a, place_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    keep_a, keep_b = (shared[np.minimum(p, len(shared) - 1)] == x if len(shared) else np.zeros(len(x), bool) for p, x in ((place_a, a), (place_b, b)))
    rows_a, place_a, rows_b, place_b = rows_a[keep_a], place_a[keep_a], rows_b[keep_b], place_b[keep_b]
    order_a, order_b = np.argsort(place_a, kind="stable"), np.argsort(place_b, kind="stable")
    rows_a, place_a, rows_b, place_b = rows_a[order_a], place_a[order_a], rows_b[order_b], place_b[order_b]
    for lo in range(0, len(shared), COLUMNS):
        wide = min(COLUMNS, len(shared) - lo)
        held = []
        for rows, place, n in ((rows_a, place_a, len(one)), (rows_b, place_b, len(two))):
            i, j = np.searchsorted(place, [lo, lo + wide])
            m = np.zeros((n, wide), np.float32)
            m[rows[i:j], place[i:j] - lo] = 1
            held.append(m)
        out += held[0] @ held[1].T
    return out.astype(np.int64)


def _block_links(table: pa.Table) -> pa.Table:
    """Weighted links of the sets of two blocks (or of one) of a component: ``name, links``."""
    name, copies, block = (table.column(c).to_numpy() for c in ("name", "copies", "block"))
    sets = [np.frombuffer(x, U) for x in table.column("elements").to_pylist()]
    size = np.array([len(x) for x in sets], np.int64)
    i, j = table.column("i").to_numpy()[0], table.column("j").to_numpy()[0]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    links = np.zeros(len(name), np.int64)
    if len(left) and len(right):
        common = _intersections([sets[k] for k in left], [sets[k] for k in right])
        good = linked(size[left][:, None], size[right][None, :], common)
        if i == j:
            np.fill_diagonal(good, False)
            links[left] = good @ copies[left]
        else:
            links[left], links[right] = good @ copies[right], good.T @ copies[left]
    return pa.table({"name": name, "links": links})


def _link_counts(label: DataFrame, sets: DataFrame, copies: DataFrame, block_sets: int) -> DataFrame:
    """``name, links``: how many documents with another set each set of a component links with."""
    held = label.select(F.col("node").alias("name"), "component").join(copies, "name").join(sets.select("name", "n"), "name")
    held = runtime.materialize(held, "ngram-classes")
    size = held.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("all"), F.sum("copies").alias("docs"))
    # two sets of one component link, by being one
    pairs = held.join(size.where("members = 2").select("component", "docs"), "component").select("name", (F.col("docs") - F.col("copies")).alias("links"))
    blocks = F.ceil(F.greatest(F.col("members") / block_sets, F.col("all") / BLOCK_ELEMENTS)).cast("int")
    placed = held.join(size.where("members > 2").select("component", blocks.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "name", "copies").join(sets.select("name", "elements"), "name")
    met = rows.groupBy("component", "i", "j").applyInArrow(_block_links, "name long, links long")
    return pairs.unionByName(met).groupBy("name").agg(F.sum("links").alias("links"))


def join_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", batch_docs: int = BATCH_DOCS, small: int = SMALL, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Per row ``doc_id, text_hash, n_shingles, component_id, class_id, n_links``; see ``join_components``.

    ``class_id`` names the component in any case, also without an id, and is null where a text has no words.
    """
    spark = docs.sparkSession
    text = F.col(text_column)
    source = docs.select(F.col(id_column).cast("long").alias("__id"), F.xxhash64(text).alias("__hash"), F.coalesce(text, F.lit("")).alias("__text"))
    base = _base_table(source, batch_docs, small)
    rows = base.where("kind = 0").select(F.when(F.col("y") % 2 == 0, F.col("x")).alias("doc_id"), F.shiftright("y", 1).alias("n_shingles"), F.col("z").alias("name"), F.col("w").alias("text_hash"))
    pairs = runtime.materialize(base.where("kind = 1").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("z").alias("seen")), "ngram-pairs")
    members = base.where("kind = 2").select(F.col("x").alias("key"), F.col("y").alias("name"), F.expr("z div 8").alias("n"), F.col("w").alias("centre"))
    ends = pairs.select(F.col("a").alias("name")).union(pairs.select(F.col("b").alias("name"))).union(members.select("name")).distinct()
    wanted = runtime.materialize(rows.join(ends, "name", "left_semi").groupBy("name").agg(F.min("doc_id").alias("__wanted")).select("__wanted").distinct(), "ngram-wanted")
    sets = runtime.materialize(_sets_of(source, wanted), "ngram-sets")
    written = [base, pairs, wanted, sets]

    best = pairs.groupBy("a").agg(F.max(F.struct("seen", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    best = runtime.materialize(best, "ngram-best")
    links = runtime.materialize(_verify(best, sets), "ngram-links")
    label = components(links)
    written += [best, links]

    rest = runtime.materialize(_apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), label), "ngram-rest")
    written.append(rest)
    if not rest.isEmpty():
        more = runtime.materialize(_verify(rest, sets), "ngram-links")
        written.append(more)
        if not more.isEmpty():
            links = links.union(more)
            label = components(links)

    if not members.isEmpty():
        named = members.join(label.select(F.col("node").alias("name"), "component"), "name", "left").withColumn("component", F.coalesce("component", "name"))
        # a batch's star has a centre of its own; all members of a signature belong to the least one
        heads = members.groupBy("key").agg(F.min("centre").alias("head"))
        crowds = runtime.materialize(named.join(heads, "key").select(F.col("head").alias("centre"), "name", "n", "component").distinct(), "ngram-crowds")
        more = runtime.materialize(_between(crowds, sets, block_sets), "ngram-links")
        written += [crowds, more]
        if not more.isEmpty():
            label = components(links.union(more))

    copies = rows.where("n_shingles > 0").groupBy("name").agg(F.count("*").alias("copies"))
    counts = runtime.materialize(copies.join(label.withColumnRenamed("node", "name"), "name", "left").join(_link_counts(label, sets, copies, block_sets), "name", "left"), "ngram-counts")
    of_set = counts.select("name", F.coalesce("component", "name").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = rows.join(of_set, "name", "left").select("doc_id", "text_hash", "n_shingles", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = runtime.materialize(named, "ngram-rows")
    runtime.drop_tables([*written, counts, label])
    least = named.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "class_id", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class_id", "n_links")


def join_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", batch_docs: int = BATCH_DOCS, small: int = SMALL, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable by links) and ``n_links`` (other rows that it links with).

    Null text has no words and links with nothing; a null id takes part in links and is never the least; equal texts are
    one set and link; repeated rows each come out; an empty table gives an empty one; other columns are not read.  Sets are named by 64
    bits, so two different ones share a name with probability n**2 / 2**65.
    """
    return join_rows(docs, id_column, text_column, batch_docs, small, block_sets).select("doc_id", "n_shingles", "component_id", "n_links")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, of which one of each component stays: that with the least id (an id before none), then the least text hash.

    Of rows that repeat an id and text any one stays.  Rows without words all stay.
    """
    found = runtime.materialize(join_rows(docs, id_column, text_column).where("class_id is not null").groupBy("class_id", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n")), "ngram-kept")
    # without a null id first, and below no other
    order = F.struct(F.col("__id").isNull(), "__id", "__hash")
    first = found.groupBy("class_id").agg(F.count("*").alias("several"), F.min(order).alias("k"))
    judged = found.join(first.where("several > 1"), "class_id", "left").withColumn("stays", F.col("k").isNull() | (F.col("__id").eqNullSafe(F.col("k.__id")) & (F.col("__hash") == F.col("k.__hash"))))
    # an id and text has one set, so it is in one class
    gone = runtime.materialize(judged.where("not stays or n > 1").select("__id", "__hash", (F.col("stays") & (F.col("n") > 1)).alias("once")), "ngram-gone")
    key = docs.withColumn("__text_hash", F.xxhash64(text_column))
    same = F.col(id_column).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    left = key.join(gone, same, "left_anti").select(*docs.columns)
    once = key.join(gone.where("once").select("__id", "__hash"), same, "left_semi").dropDuplicates([id_column, "__text_hash"]).select(*docs.columns)
    return left if gone.where("once").isEmpty() else left.unionByName(once)
