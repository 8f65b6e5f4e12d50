"""Quality rules: how public tokenizer vocabularies take to a text, with rejection bands per language.

Every whole text is measured by a piece vocabulary with byte fallback (characters per token, share of byte tokens,
token entropy) and by a byte-level vocabulary (characters per token).  The bands come from all documents that
pass the base rules: per language the median and the quartiles of each measure, read off histograms of fixed
bins, so that the same documents give the same bands on any cluster and nothing but the histograms is moved.
Languages are two- or three-letter codes; any other value, and null, is the group ``und``.  That bounds the table of
bands, which is broadcast, to 26**2 + 26**3 + 1 rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmine.llm import runtime
from graphmine.llm.kept import sole

#: Fixed values of the base rules: symbols that are counted, least words, and most repeated words in a hundred.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documented parameters of the bands: half width in quartile ranges, and at least this share of the median.
CPT_RANGES, CPT_SHARE = 6.0, 0.15
BYTE_RANGES, BYTE_LEAST = 10.0, 0.05
ENTROPY_RANGES, ENTROPY_SHARE = 5.0, 0.25
#: Documented parameters: words below which bands are wider, and words for each width more.
SHORT, SHORT_STEP = 150, 80
#: Entropy is measured against the most that so many tokens can have.
ENTROPY_TOKENS = 1024
BIN, MOST_BIN = 0.002, 32_000
#: Runs that a worker keeps, documents measured at once.
CACHED, SLICE = 200_000, 500
WHITE = " \t\n\r\x0b\x0c"

MEASURES = {"cpt_piece": "double", "cpt_byte": "double", "byte_share": "double", "entropy": "double"}
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window of ``window`` words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = h[:n].copy()
    for k in range(1, window):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key += h[k : k + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    twin = np.zeros(n, bool)
    twin[1:] = ranked[1:] == ranked[:-1]
    twin[:-1] |= twin[1:]
    if not twin.any():
        return 0
    mark = np.zeros(len(words), bool)
    for k in range(window):
        mark[order[twin] + k] = True
    return int(mark.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, WHITE))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


class Meter:
    """The two vocabularies; what they make of a run without white space is kept for the frequent ones."""

    def __init__(self, piece_model: bytes, ranks: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bytes = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.kept: dict[str, tuple[int, int, bytes]] = {}
        n = np.arange(1, 1 << 16, dtype=np.float64)
        self.nlogn = np.concatenate([[0.0], n * np.log2(n)])

    def learn(self, runs: list[str]) -> dict[str, tuple[int, int, bytes]]:
        found = {}
        encode = self.bytes.encode_ordinary
        for run, ids in zip(runs, self.pieces.encode(runs, num_threads=1), strict=True):
            found[run] = (len(ids), len(encode(" " + run)), np.array(ids, "<u2").tobytes())
        return found

    def measure(self, texts: list[str]) -> list[tuple[float, float, float, float]]:
        parts = [t.split() for t in texts]
        now = self.learn(list(set().union(*parts).difference(self.kept)))
        if len(self.kept) < CACHED:
            self.kept.update(now)
        look = (self.kept | now).__getitem__ if len(now) > len(self.kept) else lambda p, k=self.kept.get: k(p) or now[p]
        out = []
        for ps in parts:
            if not ps:
                out.append((0.0, 0.0, 0.0, 0.0))
                continue
            a, b, ids = zip(*map(look, ps), strict=True)
            n, chars = sum(a), sum(map(len, ps))
            seen = np.frombuffer(b"".join(ids), "<u2")
            counts = np.bincount(seen)
            counts = counts[counts > 0]
            total = float(self.nlogn[counts].sum() if counts.max() < len(self.nlogn) else (counts * np.log2(counts)).sum())
            entropy = (math.log2(n) - total / n) / max(1.0, math.log2(min(n, ENTROPY_TOKENS)))
            out.append((chars / n, chars / sum(b), float(self.is_byte[seen].sum()) / n, entropy))
        return out


def measure(docs: DataFrame, piece_model: str, byte_ranks: str, pattern: str, text: str = "text", prefix: str = "__q_") -> DataFrame:
    """All columns of ``docs`` plus, under ``prefix``, the base counts and the measures of every whole text (null: empty)."""
    spark = docs.sparkSession
    runtime.ship(spark)
    files = spark.sparkContext.broadcast((open(piece_model, "rb").read(), open(byte_ranks, "rb").read(), pattern))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + k, T.LongType()) for k in BASE), *(T.StructField(prefix + k, T.DoubleType()) for k in MEASURES)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = sole("meter", lambda: Meter(*files.value))
        for batch in (big.slice(k, SLICE) for big in batches for k in range(0, big.num_rows, SLICE)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base = list(zip(*map(base_counts, texts), strict=True)) or [[]] * len(BASE)
            rates = list(zip(*meter.measure(texts), strict=True)) or [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in base), *(pa.array(x, pa.float64()) for x in rates)], names=names)

    return docs.mapInArrow(run, schema)


def base_failed(prefix: str = "__q_"):
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)


def language_group(docs: DataFrame):
    if "lang" not in docs.columns:
        return F.lit("und")
    low = F.lower(F.col("lang").cast("string"))
    return F.when(low.rlike("^[a-z]{2,3}$"), low).otherwise(F.lit("und"))


def bands(measured: DataFrame, prefix: str = "__q_") -> DataFrame:
    """Per language group and measure the quartiles over all documents that pass the base rules."""
    passed = measured.where(~base_failed(prefix)).select(language_group(measured).alias("group"), *(F.least(F.floor(F.col(prefix + k) / BIN), F.lit(MOST_BIN)).alias(k) for k in MEASURES))
    each = passed.select("group", F.explode(F.create_map(*(x for k in MEASURES for x in (F.lit(k), F.col(k))))).alias("measure", "bin"))
    counts = each.groupBy("group", "measure", "bin").agg(F.count("*").alias("n"))
    by = W.partitionBy("group", "measure")
    upto = counts.select("group", "measure", "bin", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("all"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * BIN
    marks = upto.groupBy("group").pivot("measure", list(MEASURES)).agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    wide = lambda k, ranges, share: F.greatest(ranges * (F.col(k + "_hi") - F.col(k + "_lo")), share * F.col(k + "_mid"))
    return marks.select(
        F.col("group").alias("__group"),
        *(x for k in ("cpt_piece", "cpt_byte") for x in (F.col(k + "_mid").alias(f"__{k}_mid"), wide(k, CPT_RANGES, CPT_SHARE).alias(f"__{k}_wide"))),
        F.col("byte_share_hi").alias("__byte_share_mid"), F.greatest(BYTE_RANGES * (F.col("byte_share_hi") - F.col("byte_share_lo")), F.lit(BYTE_LEAST)).alias("__byte_share_wide"),
        F.col("entropy_mid").alias("__entropy_mid"), wide("entropy", ENTROPY_RANGES, ENTROPY_SHARE).alias("__entropy_wide"),
    )


def judge(docs: DataFrame, piece_model: str, byte_ranks: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default), measures under ``__q_``, ``__q_base_failed`` and ``__q_kept``.

    Measured rows are written once, so that texts are tokenised once and nothing but the histograms is shuffled.
    Null text is empty and fails the base rules; null language is ``und``; repeated rows are each judged; an empty
    table gives an empty result.
    """
    measured = measure(docs, piece_model, byte_ranks, pattern)
    wanted = docs.columns if carry is None else carry
    extra = ["__q_lang"] if "lang" in docs.columns and "lang" not in wanted else []
    table = runtime.materialize(measured.select(*wanted, *([F.col("lang").alias("__q_lang")] if extra else []), *("__q_" + k for k in (*BASE, *MEASURES))), "measured")
    source = table.withColumnRenamed("__q_lang", "lang") if extra else table
    limits = bands(source)
    joined = source.withColumn("__group", language_group(source)).join(F.broadcast(limits), "__group", "left")
    # rates of short texts scatter: a band grows by its width for every SHORT_STEP words below SHORT
    room = 1 + F.greatest(F.lit(0.0), (SHORT - F.col("__q_n_words")) / SHORT_STEP)
    off = lambda k: (F.col(f"__q_{k}") - F.col(f"__{k}_mid")) / (room * F.col(f"__{k}_wide"))
    inside = (F.abs(off("cpt_piece")) <= 1) & (F.abs(off("cpt_byte")) <= 1) & (off("byte_share") <= 1) & (off("entropy") >= -1)
    return joined.select(*wanted, *("__q_" + k for k in (*BASE, *MEASURES)), base_failed().alias("__q_base_failed"), (~base_failed() & F.coalesce(inside, F.lit(False))).alias("__q_kept"))
