"""LM scoring by subword lattices: a unigram piece model that adds up all segmentations of every word.

The vocabulary is a public one and stays as it is; its own scores (merge ranks) give the first piece
probabilities, and expectation maximisation over the training words' counts fits them.  A text is its words,
each with a space before it, and one end.  The probability of a word is the sum over all ways to cut it into pieces,
by a forward recursion in log space; single bytes are pieces too, so every word has one.  Texts' probabilities add up
to at most 1, since the pieces are drawn independently and the end is one of the draws.

Counts of words are taken over all training texts.  Frequent words, up to a bound, are broadcast; occurrences of all other
words are joined with the table of counts, so no table that grows with the corpus is held in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmine.llm import runtime

U = np.uint64
LN10 = math.log(10)
#: Documented parameters: rounds of expectation maximisation, weight of the first probabilities in tokens, most words that
#: are broadcast, words of a batch of the recursion.
ROUNDS, PRIOR_TOKENS, HEAD_WORDS, WORD_BATCH = 3, 1000.0, 300_000, 100_000
#: Other words whose scores a task knows before it starts anew.
RARE_WORDS = 250_000
#: Fixed values of the base model: its smoothing, and the part of ids that is held out.
SMOOTHING, FOLDS = 0.1, 10
#: Expected counts are added up as whole numbers of this unit, so that their sum has one value in any order.
UNIT = 1 << 16


class Lattice:
    """Pieces of a vocabulary, found in a batch of words; a space stands for the mark of a word's beginning."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        rng = np.random.default_rng(7)
        self.letter = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = U(0x9E3779B97F4A7C15 | 1)
        self.longest = max(map(len, pieces))
        wrap, base, letter = (1 << 64) - 1, int(self.base), self.letter.tolist()
        self.power = np.array([pow(base, k, 1 << 64) for k in range(self.longest + 1)], U)
        hashes = np.zeros(len(pieces), U)
        for k, piece in enumerate(pieces):
            h = 0
            for x in piece:
                h = (h * base + letter[x]) & wrap
            hashes[k] = h
        lengths = np.array([len(p) for p in pieces])
        self.tables = {}
        for n in np.unique(lengths[lengths > 0]).tolist():
            ids = np.flatnonzero(lengths == n)
            order = np.argsort(hashes[ids])
            known = np.zeros(1 << 20, bool)
            known[hashes[ids] >> U(44)] = True
            self.tables[n] = (hashes[ids][order], ids[order], known)

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of all arcs, by their end's place in the word; each word's first node and last node.

        Word k has one node more than bytes.  Arcs come sorted by (place of the end in its word, end).
        """
        sizes = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        nodes = int((sizes + 1).sum())
        place = np.arange(nodes) - np.repeat(first, sizes + 1)
        value = np.zeros(nodes, U)
        value[place > 0] = self.letter[text]
        # prefix hashes of each word, by place: words are short, so few steps cover nearly all
        prefix = np.zeros(nodes, U)
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(int(sizes.max(initial=0)) + 2))
        for p in range(1, len(cuts) - 1):
            at = by_place[cuts[p] : cuts[p + 1]]
            prefix[at] = prefix[at - 1] * self.base + value[at]
        starts, ends, found = [], [], []
        at = np.flatnonzero(place > 0)
        for n in range(1, self.longest + 1):
            at = at[place[at] >= n]
            if not len(at):
                break
            if n not in self.tables:
                continue
            hashes, ids, known = self.tables[n]
            h = prefix[at] - prefix[at - n] * self.power[n]
            some = np.flatnonzero(known[h >> U(44)])
            k = np.minimum(np.searchsorted(hashes, h[some]), len(hashes) - 1)
            hit = hashes[k] == h[some]
            end = at[some[hit]]
            starts.append(end - n)
            ends.append(end)
            found.append(ids[k[hit]])
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, found))
        order = np.argsort(place[end] * np.int64(nodes) + end)
        return start[order], end[order], piece[order], first, first + sizes

    def _sweep(self, nodes: int, source: np.ndarray, target: np.ndarray, weight: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log sums of paths from ``begin`` nodes; arcs are sorted by (step, target)."""
        out = np.full(nodes, -np.inf)
        out[begin] = 0.0
        if len(source):
            new = np.concatenate([[True], target[1:] != target[:-1]])
            heads = np.flatnonzero(new)
            cut = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])).tolist() + [len(step)]
            for a, b in zip(cut, cut[1:], strict=False):
                lo, hi = np.searchsorted(heads, [a, b])
                own = heads[lo:hi]
                value = out[source[a:b]] + weight[a:b]
                top = np.maximum.reduceat(value, own - a)
                safe = np.where(np.isfinite(top), top, 0.0)
                spread = np.repeat(safe, np.diff(np.append(own, b)))
                with np.errstate(divide="ignore"):
                    out[target[own]] = safe + np.log(np.add.reduceat(np.exp(value - spread), own - a))
        return out

    def forward(self, words: list[bytes], log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability, over all segmentations."""
        out = []
        for k in range(0, len(words), WORD_BATCH):
            some = words[k : k + WORD_BATCH]
            start, end, piece, first, last = self.arcs(some)
            place = end - first[np.searchsorted(first, end, "right") - 1]
            out.append(self._sweep(int(last[-1]) + 1, start, end, log_p[piece], place, first)[last])
        return np.concatenate(out) if out else np.zeros(0)

    def expected(self, words: list[bytes], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, ``counts`` times each."""
        out = np.zeros(self.size)
        for k in range(0, len(words), WORD_BATCH):
            some = words[k : k + WORD_BATCH]
            start, end, piece, first, last = self.arcs(some)
            word = np.searchsorted(first, end, "right") - 1
            weight, nodes = log_p[piece], int(last[-1]) + 1
            alpha = self._sweep(nodes, start, end, weight, end - first[word], first)
            ahead = last[word] - start
            order = np.argsort(ahead * np.int64(nodes) + start)
            beta = self._sweep(nodes, end[order], start[order], weight[order], ahead[order], last)
            share = np.exp(alpha[start] + weight + beta[end] - alpha[last][word])
            out += np.bincount(piece, share * counts[k : k + WORD_BATCH][word], self.size)
        return out


_lattices: dict[bytes, Lattice] = {}


def vocabulary(model: bytes) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a space for the word mark; control pieces are empty), and first log probabilities from the scores.

    The file's scores are merge ranks; a piece of rank r gets weight 1 / (r + 256), a single byte or letter 1 / 256 of the first.
    """
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces, weights = [], []
    seen: set[bytes] = set()
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            piece = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            piece = b""
        else:
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
        if piece in seen:
            piece = b""
        seen.add(piece)
        pieces.append(piece)
        weights.append(1 / (256 + max(0.0, -sp.get_score(i))) if piece else 0.0)
    weights = np.array(weights)
    with np.errstate(divide="ignore"):
        return pieces, np.log(weights / weights.sum())


def lattice(model: bytes) -> Lattice:
    key = model[-64:] + len(model).to_bytes(8, "little")
    if key not in _lattices:
        _lattices[key] = Lattice(vocabulary(model)[0])
    return _lattices[key]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out(id_column: Column) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` (binary) and ``c`` of the only column's texts; batches are added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > 1_000_000:
                    yield flush(counts)
        if counts:
            yield flush(counts)

    def flush(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return out

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Model:
    """Piece log probabilities, the end's, and what the base model needs."""

    def __init__(self, log_p: np.ndarray, log_end: float, total: int, distinct: int, ends: int):
        self.log_p, self.log_end, self.total, self.distinct, self.ends = log_p, log_end, total, distinct, ends

    def base(self, c):
        """log10 of a token's base probability, given its count."""
        return np.log10((np.asarray(c, float) + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1)))


def fit(counts: DataFrame, ends: int, model: bytes, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over the table of training words; a round moves one row for each piece and task."""
    spark = counts.sparkSession
    _, first = vocabulary(model)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    file = spark.sparkContext.broadcast(model)
    log_p = first
    prior = PRIOR_TOKENS * np.exp(first)
    drawn = 0.0
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(log_p)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            net = lattice(file.value)
            uses = np.zeros(net.size)
            for batch in batches:
                words = [b" " + w for w in batch.column(0).to_pylist()]
                uses += net.expected(words, batch.column(1).to_numpy().astype(float), now.value)
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.round(uses[some] * UNIT).astype(np.int64))], names=["piece", "uses"])

        uses = np.zeros(len(first))
        for piece, n in counts.select("word", "c").mapInArrow(run, "piece int, uses long").groupBy("piece").agg(F.sum("uses")).collect():
            uses[piece] = n / UNIT
        drawn = uses.sum() + prior.sum() + ends
        with np.errstate(divide="ignore"):
            log_p = np.log((uses + prior) / drawn)
        now.unpersist()
    log_end = math.log(max(ends, 0.5) / max(drawn, 1.0))
    return Model(log_p, log_end, total + ends, distinct + (ends > 0), ends)


def head(counts: DataFrame, most: int = HEAD_WORDS) -> tuple[list[bytes], np.ndarray, int]:
    """All words of at least some count, the least power of two that keeps them at ``most`` or fewer; and that count."""
    sizes = dict(counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().collect())
    least = 63
    while least > 0 and sum(n for k, n in sizes.items() if k >= least - 1) <= most:
        least -= 1
    rows = counts.where(F.col("c") >= F.lit(1 << min(least, 62))).collect()
    return [bytes(r[0]) for r in rows], np.array([r[1] for r in rows], np.int64), 1 << min(least, 62)


DOC = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<int>"


def score(docs: DataFrame, piece_model: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    A null text is empty and has its end only; a null id is scored as the id of empty text; repeated rows are each
    scored; an empty table gives an empty one.  Without training texts every token is unknown.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    model = open(piece_model, "rb").read()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    training = source.where(~F.col("held_out"))
    counts = runtime.materialize(count_words(training.select("__text")), "lm-words")
    fitted = fit(counts, training.count(), model)
    words, times, least = head(counts, head_words)
    shared = spark.sparkContext.broadcast((model, fitted, words, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, m, known, c = shared.value
        net = lattice(file)
        place = {w: k for k, w in enumerate(known)}
        base = np.append(m.base(c), 0.0)
        own = np.append(net.forward([b" " + w for w in known], m.log_p), 0.0)
        end_base, end_known = float(m.base(m.ends)), int(m.ends > 0)
        rare: dict[bytes, float] = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo in range(0, len(texts), 2000):
                parts = [words_of(t) for t in texts[lo : lo + 2000]]
                if len(rare) > RARE_WORDS:
                    rare.clear()
                new = list(set().union(*parts).difference(place, rare))
                rare.update(zip(new, net.forward([b" " + w for w in new], m.log_p).tolist(), strict=True))
                rows = []
                for ps in parts:
                    at = np.fromiter(map(place.get, ps, [-1] * len(ps)), np.int64, len(ps))
                    miss = Counter(ps[k] for k in np.flatnonzero(at < 0).tolist())
                    value = float(own[at].sum()) + sum(n * rare[w] for w, n in miss.items()) + m.log_end
                    rows.append((len(ps) + 1, int((at >= 0).sum()) + end_known, float(base[at].sum()) + end_base, value / LN10, list(miss), list(miss.values())))
                cut = [batch.column(k).slice(lo, len(rows)) for k in (0, 1)]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*cut, *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "times"])

    scored = runtime.materialize(source.mapInArrow(run, DOC).withColumn("row", F.monotonically_increasing_id()), "lm-docs")
    rest = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.xxhash64("w.words").alias("h"), F.hash("w.words").alias("h2"), F.col("w.times").alias("n"))
    tail = counts.where(F.col("c") < F.lit(least)).select(F.xxhash64("word").alias("h"), F.hash("word").alias("h2"), "c")
    found = rest.join(tail, ["h", "h2"], "left")
    chance = F.log10((F.coalesce(F.col("c"), F.lit(0)) + SMOOTHING) / F.lit(float(fitted.total + SMOOTHING * (fitted.distinct + 1))))
    sums = found.groupBy("row").agg(F.sum(F.col("n") * chance).alias("more_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = scored.drop("words", "times").join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(fitted.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
