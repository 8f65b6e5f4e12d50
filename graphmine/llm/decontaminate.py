"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A seed is, at each word of a benchmark item, the shortest run of words that chance would hardly put into a text: the
words' frequencies over the whole corpus must multiply to 2 ** -SEED_BITS or less.  An item whose words together don't reach that,
such as one frequent word, is no evidence of a leak and has no seeds.  A document that has a seed is
aligned with the item around the places of its seeds, so copies with words changed, added or left out
score as high as their unchanged part lets them.  No seed is dropped for being frequent in the corpus: a
passage that leaked a thousand times stays findable.

Benchmarks are taken in blocks of bounded size; a block's seeds and items are broadcast, and each block is one pass over the
documents without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmine.llm import runtime
from graphmine.llm.kept import Kept, sole
from graphmine.llm.ngram_join import mix

U = np.uint64
#: Documented parameters: bits of a seed, its least words (or all of a shorter item), text bytes of a block of items.
SEED_BITS, LEAST_SEED, BLOCK_BYTES = 26.0, 2, 8_000_000
#: Scores of the alignment; share of an item's best score, and matched words (or all of a shorter item), that make a leak.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SHARE, LEAST_MATCHED = 0.4, 8
CACHED_WORDS = 250_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"


def _name(word: str) -> int:
    """Name of a word without the marks around it; 0 for marks alone."""
    bare = word.strip(MARKS)
    return (xxhash.xxh3_64_intdigest(bare) >> 1 | 1) if bare else 0


def names_of(text: str) -> np.ndarray:
    words = text.lower().split()
    out = np.fromiter(map(sole("word names", lambda: Kept(_name, CACHED_WORDS)).__getitem__, words), U, len(words))
    return out[out > 0] if len(out) and not out.all() else out


def runs(names: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    m = len(names) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    h = names[:m].copy()
    for k in range(1, n):
        h = mix(h) + names[k : k + m]
    return mix(h + U(n))


def _next_row(up: np.ndarray, name: int, text: np.ndarray, step: np.ndarray) -> np.ndarray:
    row = np.maximum(up + GAP, 0)
    row[1:] = np.maximum(row[1:], up[:-1] + np.where(text == name, MATCH, MISMATCH))
    return (np.maximum.accumulate(row + step) - step).astype(np.int32)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: score, matched words, begin and end in ``text``.

    Every k-th row is kept, k the square root of the item's length; the rows between are computed again on the way back.
    """
    step = np.arange(len(text) + 1, dtype=np.int32) * -GAP
    every = max(1, math.isqrt(len(item)))
    row = np.zeros(len(text) + 1, np.int32)
    kept, best, i, j = [row], 0, 0, 0
    for k, name in enumerate(item, 1):
        row = _next_row(row, name, text, step)
        top = int(row.max())
        if top > best:
            best, i, j = top, k, int(row.argmax())
        if k % every == 0:
            kept.append(row)
    end, matched = j, 0
    first, rows = i, []
    while i and j:
        if i <= first:  # rows of the block below
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for name in item[first:i]:
                rows.append(_next_row(rows[-1], name, text, step))
        here, up = rows[i - first], rows[i - first - 1]
        if here[j] <= 0:
            break
        same = item[i - 1] == text[j - 1]
        if here[j] == up[j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif here[j] == up[j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, matched, int(j), end


class Seeds:
    """Items of a block and their seeds by run length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], bits: dict[int, float]):
        self.items = items
        tables: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, names) in enumerate(items):
            weight = np.array([bits.get(int(x), 64.0) for x in names])
            least = min(LEAST_SEED, len(names))
            for at in range(len(names)):
                total, n = 0.0, 0
                while at + n < len(names) and (total < SEED_BITS or n < least):
                    total += weight[at + n]
                    n += 1
                if total >= SEED_BITS and n >= least:
                    tables.setdefault(n, []).append((int(runs(names[at : at + n], n)[0]), k, at))
        self.tables = {}
        for n, rows in tables.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], U)
            known = np.zeros(1 << 18, bool)
            known[hashes >> U(46)] = True
            self.tables[n] = (hashes, np.array([r[1:] for r in rows], np.int64).reshape(-1, 2), known)

    def leaks(self, names: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item id, share of the best score, matched words, begin, end) of items that the words hold."""
        found = []
        for n, (hashes, places, known) in self.tables.items():
            h = runs(names, n)
            at = np.flatnonzero(known[h >> U(46)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            times = hi - lo
            if times.any():
                place = places[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                found.append(np.stack([place[:, 0], np.repeat(at, times) - place[:, 1]], 1))
        if not found:
            return []
        hits = np.unique(np.concatenate(found), axis=0)
        out = []
        cuts = np.flatnonzero(np.diff(hits[:, 0], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(hits)], strict=True):
            k, begins = int(hits[a, 0]), hits[a:b, 1].tolist()
            item_id, item = self.items[k]
            reach = len(item) // 2 + 4
            best, lo = None, begins[0]
            for this, after in zip(begins, [*begins[1:], None], strict=True):
                if after is not None and after - this <= reach and after - lo <= 4 * len(item):
                    continue
                a, b = max(0, lo - reach), min(len(names), this + len(item) + reach)
                score, matched, begin, end = align(item, names[a:b])
                share = score / (MATCH * len(item))
                if matched >= min(LEAST_MATCHED, len(item)) and share >= LEAST_SHARE and (best is None or share > best[1]):
                    best = (item_id, share, matched, a + begin, a + end)
                lo = after
            if best:
                out.append(best)
        return out


def word_bits(docs: DataFrame, wanted: list[int]) -> dict[int, float]:
    """Bits (-log2 of the share of all words) of the wanted words, counted over all documents' ``__text``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(sorted(wanted), U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        place = {n: k for k, n in enumerate(names.tolist())}
        find = Kept(lambda w: place.get(_name(w), len(place)), CACHED_WORDS)
        counts = np.zeros(len(place) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.lower().split()
                counts += np.bincount(np.fromiter(map(find.__getitem__, words), np.int64, len(words)), minlength=len(counts)) if len(words) > 2000 else 0
                if len(words) <= 2000:
                    np.add.at(counts, np.fromiter(map(find.__getitem__, words), np.int64, len(words)), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(counts[some])], names=["k", "n"])

    found = dict(docs.select("__text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect())
    total = max(1, sum(found.values()))
    ordered = sorted(wanted)
    return {n: float(np.log2(total / found[k])) for k, n in enumerate(ordered) if found.get(k)}


def blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items in blocks of about ``BLOCK_BYTES`` of text, streamed to the driver one block at a time; items without words are left out."""
    rows = benchmark.select(F.col(id_column).cast("long"), F.col(text_column)).where(F.col(text_column).isNotNull()).toLocalIterator()
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for item, text in rows:
        names = names_of(text)
        if len(names):
            block.append((item, names))
            size += len(text)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


LEAKS = "doc_id long, item_id long, score double, matched int, begin_word int, end_word int"


def _prepared(docs: DataFrame, benchmark: DataFrame, text: str) -> Iterator[Seeds]:
    runtime.ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"))
    for block in blocks(benchmark, "item_id", "text"):
        bits = word_bits(texts, list({int(x) for _, names in block for x in names}))
        yield Seeds(block, bits)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document and item it holds: ``score`` (share of the item's best), matched words, and the words it spans.

    Words are counted without those that are marks alone.  Null texts and items hold nothing; null ids come out as null;
    repeated rows each come out; without documents or items the result is empty.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = spark.createDataFrame([], LEAKS)
    for seeds in _prepared(docs, benchmark, text):
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in shared.value.leaks(names_of(t))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "matched", "begin_word", "end_word"])

        out = out.unionByName(source.mapInArrow(run, LEAKS))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; null texts stay."""
    at = docs.columns.index(text)
    out = docs
    for seeds in _prepared(docs, benchmark, text):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.leaks(names_of(t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out
