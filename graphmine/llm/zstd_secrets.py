"""Secret scans: base patterns, and zstandard novelty of strings in sensitive contexts.

A candidate is a long token of key letters, of any case and kind, behind a sensitive word.  Its novelty is what it adds to the compressed
size of its surroundings: a compressor is primed with a dictionary of identifiers (fixed ones, and the words that most documents of
the corpus use, counted over all of it) and the text around the candidate without its other copies, and the bytes with the candidate less the bytes without it are its marginal size.  A string that the
dictionary or the text explains costs little; a random one costs nearly its entropy.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmine.llm import runtime

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")
#: Words that make a context sensitive.
SENSITIVE = re.compile(r"(?:secret|token|passw(?:or)?d|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|signature|client[_-]?id|AKIA)", re.IGNORECASE | re.ASCII)
FIRST_LETTERS = ("secret", "token", "passw", "pwd", "credential", "key", "auth", "bearer", "signature", "client", "akia")
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Identifiers that code and configuration are full of; the dictionary that primes the compressor.
IDENTIFIERS = (
    "configuration application environment development production localhost username password database connection "
    "authorization authentication credentials repository container deployment kubernetes certificate encryption "
    "get_access_token set_secret_key client_secret client_id api_key apiKey accessToken refreshToken privateKey publicKey "
    "example placeholder changeme your-secret-here 0123456789abcdef ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz "
)
#: Documented parameters: characters around a candidate, reach of a sensitive word, least marginal bytes per character.
AROUND, REACH, NOVELTY = 400, 48, 0.6
#: Documented parameters: letters of a word that counts, the longest looked up, and the part of a candidate in words that makes it no key (of 12,000 random strings of one case 2 have it).
LEAST_WORD, LONGEST_WORD, WORDED = 4, 16, 0.5

#: Words of the corpus in the dictionary; they are shorter than any candidate, so that no secret that is often repeated explains itself.
DICTIONARY_WORDS = 3000
WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{4,15}(?![A-Za-z0-9])", re.ASCII)


def marginal_bytes(before: str, candidate: str, after: str, prefix: bytes = IDENTIFIERS.encode()) -> int:
    """Compressed bytes that ``candidate`` adds between its surroundings, with the surroundings and identifiers known."""
    primed = zstandard.ZstdCompressionDict(prefix + after.encode() + b"\n" + before.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    frame = before[-32:].encode()
    return len(press.compress(frame + candidate.encode())) - len(press.compress(frame))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def vocabulary_words(path: str) -> frozenset[str]:
    """Words of a public vocabulary, in lower case."""
    pieces = (p.removesuffix("</w>").lower() for p in json.load(open(path, encoding="utf-8"))["model"]["vocab"])
    return frozenset(p for p in pieces if LEAST_WORD <= len(p) <= LONGEST_WORD and p.isascii() and p.isalpha())


def worded(candidate: str, words: frozenset[str]) -> bool:
    """Of one case without digits, and made of words of a public vocabulary: in so short a text all letters cost the compressor the same."""
    if any(c.isdigit() for c in candidate) or not (candidate[1:].islower() or candidate.isupper()):
        return False
    low, at, known = candidate.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(min(LONGEST_WORD, len(low) - at), LEAST_WORD - 1, -1) if low[at : at + k] in words), 0)
        known += size
        at += size or 1
    return known >= WORDED * len(low)


def novel_spans(text: str, low: str, words: frozenset[str], prefix: bytes = IDENTIFIERS.encode()) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose marginal size says that nothing around explains them.

    Every candidate is met once and matched once, so a text of one long token costs its length.
    """
    if not any(w in low for w in FIRST_LETTERS):
        return []
    out, done = [], 0
    for word in SENSITIVE.finditer(text):
        begin = max(done, word.start() if word.group().upper() == "AKIA" else word.end())
        while begin <= word.end() + REACH:
            near = CANDIDATE.search(text, begin, min(len(text), word.end() + REACH + LEAST_CANDIDATE))
            if not near:
                break
            start, end = CANDIDATE.match(text, near.start()).span()
            begin = done = end
            found = text[start:end]
            if worded(found, words):
                continue
            # a copy of the candidate nearby must not explain it; one cut by the reach's end is blanked whole
            reach = AROUND + len(found)
            before = text[max(0, start - reach) : start].replace(found, " ")[-AROUND:]
            after = text[end : end + reach].replace(found, " ")[:AROUND]
            if marginal_bytes(before, found, after, prefix) >= NOVELTY * len(found):
                out.append((start, 3, end))
    return out


def dictionary(docs: DataFrame, text: str) -> bytes:
    """The compressor's dictionary: the words in most documents, the most frequent last, behind the fixed identifiers.

    Words are counted over all documents; the ``DICTIONARY_WORDS`` first of them go to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                counts.update(set(WORD.findall(t)))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()
    return " ".join([IDENTIFIERS, *(r.word for r in reversed(top)), ""]).encode()


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document the base counts, a digest of the base spans, and all spans (code points, end exclusive).

    Null text is empty: no spans, and the digest of an empty string.  Rows with equal or null ids are each scanned.
    ``vocabulary`` is a public tokenizer file, the word BPE unless given.
    """
    from graphmine.llm.queries import tokenizer

    spark = docs.sparkSession
    runtime.ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    known = spark.sparkContext.broadcast((vocabulary_words(vocabulary or tokenizer("word_bpe_49k.json")), dictionary(source, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                every = sorted([*base, *novel_spans(text, text.lower(), *known.value)])
                kinds = [k for _, k, _ in every]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return source.mapInArrow(run, SPANS)
