"""Token ids in grammar-compressed shards (Re-Pair) with random access.

A shard holds whole documents.  Frequent id pairs are replaced by nonterminals, round by round: each round counts all
pairs of the shard, takes the frequent ones, most frequent first, such that no symbol is the right part of one and
the left part of another (so that occurrences cannot overlap), and replaces them all, until no pair is frequent or the symbols run out.  The shard stores the rules, the
expansion length of each rule and of each document, and the remaining sequence; symbols fit in 16 bits.

Payload, little endian: magic ``RPG1``; u32 counts of documents, rules, symbols, and the first nonterminal; i64
document ids; u8 marks of null ids; u32 document lengths in ids; u16 left and right parts of the rules; u32 expansion
lengths of the rules; u16 symbols.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphmine.llm import runtime
from graphmine.llm.bpe_automaton import white_runs
from graphmine.llm.kept import sole

MAGIC = b"RPG1"
SYMBOLS = 1 << 16
#: Documented parameters of the format: ids a shard closes at, and the least count that pays.
SHARD_IDS, LEAST_COUNT = 1 << 20, 6
PICKED = 4096
HASH_BITS = 19


def _place(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))
    h >>= np.uint32(32 - HASH_BITS)
    return h


def _frequent(seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the most frequent pairs, which occur ``least`` times or more, with their pair keys and hashes (a hashed count first, then an exact one)."""
    h = _place(seq[:-1], seq[1:])
    counts = np.bincount(h, minlength=1 << HASH_BITS)
    most = counts[counts >= least]
    if len(most) > PICKED:
        least = int(np.partition(most, len(most) - PICKED)[len(most) - PICKED])
    at = np.flatnonzero((counts >= least)[h])
    return at, seq[at] << np.uint32(16) | seq[at + 1], h[at]


def _choose(keys: np.ndarray, least: int, room: int) -> np.ndarray:
    """Pairs to replace in this round, in the order of their nonterminals; of pairs with one hash only the most frequent."""
    found, counts = np.unique(keys, return_counts=True)
    order = np.argsort(-counts, kind="stable")[: min(PICKED, int((counts >= least).sum()))]
    lefts: set[int] = set()
    rights: set[int] = set()
    taken: set[int] = set()
    picked = []
    found = found[order]
    for k, h in zip(found.tolist(), _place(found >> np.uint32(16), found & np.uint32(0xFFFF)).tolist(), strict=True):
        a, b = k >> 16, k & 0xFFFF
        if len(picked) < room and h not in taken and a not in rights and b not in lefts and (a != b or a not in lefts):
            picked.append(k)
            taken.add(h)
            lefts.add(a)
            rights.add(b)
    return np.array(picked, np.uint32)


def compress(ids: np.ndarray, first: int, rounds: int | None = None, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols, in order from symbol ``first`` on) and the remaining sequence of ``ids``; without ``rounds`` until no pair occurs ``least`` times or the symbols run out."""
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    for _ in itertools.count() if rounds is None else range(rounds):
        room = SYMBOLS - first - len(rules)
        if len(seq) < 2 * least or room <= 0:
            break
        at, keys, places = _frequent(seq, least)
        picked = _choose(keys, least, room)
        if not len(picked):
            break
        table = np.zeros(1 << HASH_BITS, np.int32)
        table[_place(picked >> np.uint32(16), picked & np.uint32(0xFFFF))] = np.arange(len(picked), dtype=np.int32)
        rule = table[places]
        hit = picked[rule] == keys
        at, rule = at[hit], rule[hit]
        same = seq[at] == seq[at + 1]
        if same.any():  # a run of one symbol is cut into pairs from its start
            p = at[same]
            start = np.maximum.accumulate(np.where(np.diff(p, prepend=-2) != 1, p, 0))
            drop = np.zeros(len(at), bool)
            drop[np.flatnonzero(same)[(p - start) % 2 == 1]] = True
            at, rule = at[~drop], rule[~drop]
        seq[at] = (rule + (first + len(rules))).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules = np.concatenate([rules, np.stack([picked >> np.uint32(16), picked & np.uint32(0xFFFF)], 1)])
    return rules.astype(np.uint16), seq.astype(np.uint16)


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; a rule's parts come before it."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, np.uint32)


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, first: int) -> bytes:
    rules, seq = compress(ids, first)
    return b"".join([
        MAGIC, struct.pack("<4I", len(doc_ids), len(rules), len(seq), first),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), np.array(counts, "<u4").tobytes(),
        rules.astype("<u2").tobytes(), lengths(rules, first).astype("<u4").tobytes(), seq.astype("<u2").tobytes(),
    ])


class Shard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        n, r, m, self.first = struct.unpack_from("<4I", payload, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        ids, null, self.counts = take("<i8", n), take("u1", n), take("<u4", n)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.rules, self.rule_lengths, self.seq = take("<u2", 2 * r).reshape(r, 2), take("<u4", r), take("<u2", m)
        self._flat: np.ndarray | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols' expansions one after another, with each symbol's place and length in them."""
        if self._flat is None:
            size = np.ones(self.first + len(self.rules), np.int64)
            size[self.first :] = self.rule_lengths
            self._place = np.concatenate([[0], np.cumsum(size)[:-1]])
            self._size = size
            flat = np.zeros(int(size.sum()), np.uint32)
            flat[: self.first] = np.arange(self.first)
            place, sizes = self._place.tolist(), size.tolist()
            for k, (a, b) in enumerate(self.rules.tolist()):
                p = place[self.first + k]
                flat[p : p + sizes[a]] = flat[place[a] : place[a] + sizes[a]]
                flat[p + sizes[a] : p + sizes[a] + sizes[b]] = flat[place[b] : place[b] + sizes[b]]
            self._flat = flat
        return self._flat, self._place, self._size

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the shard; only symbols that reach into the range are expanded."""
        flat, place, size = self._expansions()
        ends = np.cumsum(size[self.seq])
        stop = int(ends[-1]) if stop is None and len(ends) else (stop or 0)
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        part = self.seq[lo:hi]
        took = size[part]
        if not len(part) or stop <= start:
            return np.zeros(0, np.uint32)
        before = np.cumsum(took) - took
        out = flat[np.repeat(place[part] - before, took) + np.arange(int(took.sum()))]
        skip = start - (int(ends[lo - 1]) if lo else 0)
        return out[skip : skip + stop - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class LibraryIds:
    """Ids by the tokenizers library, which encodes each run without white space once while it is known.

    The tokenizer drops white space and splits there, so a text's ids are those of its runs one after another.
    """

    def __init__(self, spec: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = tokenizers.Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.cached = cached
        self.known: dict[str, bytes] = {}

    def learn(self, runs: list[str]) -> None:
        for lo in range(0, len(runs), RUNS_AT_ONCE):
            some = runs[lo : lo + RUNS_AT_ONCE]
            for run, made in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[run] = array("H", made.ids).tobytes()

    def batch(self, texts: list[str], end: int) -> tuple[bytes, list[int]]:
        """16-bit ids of all texts one after another, each with ``end`` behind it, and their counts."""
        if len(self.known) > self.cached:
            self.known.clear()
        parts = [white_runs(t) for t in texts]
        self.learn(list(set().union(*parts).difference(self.known)))
        stop = struct.pack("<H", end)
        out = [b"".join(map(self.known.__getitem__, p)) + stop for p in parts]
        return b"".join(out), [len(x) // 2 for x in out]


def library_ids(spec: str) -> LibraryIds:
    """The tokenizer of a file's content, one per worker; what it knows outlives a task."""
    return sole(("library", spec), lambda: LibraryIds(spec, CACHED))


BLOCK = "part int, block int, n_docs long, n_ids long, payload binary"
READ = "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long"
#: Runs that a worker knows before it starts anew, characters of a batch, and runs that the library encodes at once.
CACHED, AT_ONCE, RUNS_AT_ONCE = 400_000, 4_000_000, 20_000


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append ``end_id`` to each and write shards, in ascending ``doc_id`` order, below ``path``.

    A null text counts as empty and is stored as its end id; a null id sorts first; rows with one id stay
    apart, in the order of their texts' hashes.  The order comes from one range exchange on id and hash, so that many texts with one
    id are dealt to many tasks; ids of a vocabulary
    over 65,535 symbols don't fit this format and are refused.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    spec = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = library_ids(spec.value)
        first = made.library.get_vocab_size(with_added_tokens=True)
        if first >= SYMBOLS:
            raise ValueError("this format holds 16-bit symbols")
        part, block = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int | None] = []
        counts: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, held
            payload = pack(names, counts, np.frombuffer(b"".join(ids), "<u2"), first)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "n_docs", "n_ids", "payload"])
            block, held = block + 1, 0
            for x in (ids, names, counts):
                x.clear()
            return row

        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                    size += len(texts[to])
                    to += 1
                small, n = made.batch(texts[at:to], end_id)
                done = 0
                for d, c in zip(docs_[at:to], n, strict=True):
                    names.append(d)
                    counts.append(c)
                    ids.append(small[done : done + 2 * c])
                    done += 2 * c
                    held += c
                    if held >= shard_ids:
                        yield close()
                at = to
        if names:
            yield close()

    source.repartitionByRange("doc_id", F.xxhash64("__text")).sortWithinPartitions("doc_id", F.xxhash64("__text")).mapInArrow(run, BLOCK).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document ``doc_id``, ``start`` (ids before it), ``n_tokens`` and ``ids_crc32``, decoded from the shards.

    ``start`` adds up two small tables: blocks within their part, and totals of the parts.
    """
    runtime.ship(spark)
    blocks = spark.read.schema(BLOCK).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                starts = shard.starts.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:], strict=False)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    each = blocks.select("part", "block", "payload").mapInArrow(run, READ)
    sizes = blocks.select("part", "block", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("all")).select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("parts_before"))
    starts = sizes.select("part", "block", (F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("blocks_before")).join(totals, "part")
    return each.join(starts, ["part", "block"]).select("doc_id", (F.col("parts_before") + F.col("blocks_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
