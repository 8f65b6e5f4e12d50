"""BPE encoding and decoding by an automaton compiled from the merge list.

Compilation follows the merge-gadget construction: start from one state with a loop for every base symbol;
merge ``a b -> ab`` splits the state behind the ``a`` arcs into a copy without its ``b`` arc, sends the ``a`` arcs
to the copy and adds an ``ab`` arc, to where ``b`` led, in every state that has an ``a`` arc.  All arcs with one
label lead to one state throughout, so a state is known by the label that leads to it, and the gadgets are kept
as what they add and remove: for a label ``x``, the label whose state it was copied from and when (``born``,
``left``, ``right``); for a pair, when its arc was cut (``cut``).  ``follows`` reads one cell of the transition table from
these; the cells in use are tabulated in a dictionary, since the full table would have 2.4 thousand million cells.

A path through the automaton spells a word by exactly one sequence of labels, and that is the sequence that
merging by rank gives.  So each prefix of a word has at most one live path, and encoding is a walk along the
longest labels first in which a position that was left once is dead.  Decoding emits arc labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmine.llm import runtime
from graphmine.llm.kept import Kept, sole

#: Cells of the transition table and words that a worker keeps; beyond it they are computed again.
TABLE_CELLS = 2_000_000
CACHED_CHUNKS = 250_000
CACHED_SPELLINGS = 300_000

#: The pre-tokenizer's pattern, white space of Unicode, and the byte values written as themselves.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE_SPACE = "[\t-\r \x85\xa0  -     　]+"
VISIBLE_BYTES = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
NOT_WHITE_HERE = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: visible bytes for themselves, the others from code point 256 on."""
    shown = {b for lo, hi in VISIBLE_BYTES for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_white = regex.compile(WHITE_SPACE)


def white_runs(text: str) -> list[str]:
    """Runs without Unicode white space."""
    if any(c in text for c in NOT_WHITE_HERE):  # white space to Python alone
        return [p for p in _white.split(text) if p]
    return text.split()


class MergeAutomaton:
    """The compiled automaton; ``merges`` are id triples (left, right, merged) in rank order."""

    def __init__(self, labels: list[str], merges: list[tuple[int, int, int]], end: str):
        self.labels, self.end = labels, end
        self.born = [-1] * len(labels)
        self.left = [-1] * len(labels)
        self.right = [-1] * len(labels)
        self.cut: dict[int, int] = {}
        for when, (a, b, ab) in enumerate(merges):
            self.cut.setdefault(a << 20 | b, when)
            if self.born[ab] < 0:
                self.born[ab], self.left[ab], self.right[ab] = when, a, b
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for i, label in enumerate(labels):
            if end and label.endswith(end) and label != end:
                self.final[label[: -len(end)]] = i
            else:
                self.inner[label] = i
        if not end:
            self.final = self.inner
        self.longest = max(map(len, labels), default=1)
        self.longest_by_first: dict[str, int] = {}
        for s in (*self.inner, *self.final):
            if s:
                self.longest_by_first[s[0]] = max(self.longest_by_first.get(s[0], 1), len(s))
        self.table: dict[int, bool] = {}

    def follows(self, x: int, y: int) -> bool:
        """Is there an arc labelled ``y`` in the state that ``x`` leads to, after the last gadget?"""
        cut, born, now = self.cut, self.born, len(self.cut) + len(self.born)
        while True:
            when = cut.get(x << 20 | y, -1)
            if 0 <= when < now:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[y] >= born[x]:
                now, y = born[y] + 1, self.left[y]  # arcs are cut before the new label's are added: tells for a merge of equal labels
            else:
                now, x = born[x], self.right[x]

    def walk(self, word: str) -> list[int]:
        """Labels of the one accepting path that spells ``word``."""
        n = len(word)
        whole = self.final.get(word)
        if whole is not None and n == 1:
            return [whole]
        inner, final, table, limit = self.inner, self.final, self.table, self.longest_by_first
        path: list[int] = []
        ends: list[int] = []
        dead = bytearray(n + 1)
        at, prev = 0, -1
        stop = min(n, limit.get(word[0], 1))
        while True:
            found = -1
            for to in range(stop, at, -1):
                if dead[to]:
                    continue
                label = final.get(word[at:to], -1) if to == n else inner.get(word[at:to], -1)
                if label < 0:
                    continue
                if prev >= 0:
                    cell = prev << 20 | label
                    ok = table.get(cell)
                    if ok is None:
                        ok = self.follows(prev, label)
                        if len(table) >= TABLE_CELLS:
                            table.clear()
                        table[cell] = ok
                    if not ok:
                        continue
                found = to
                break
            if found < 0:
                if not path:
                    raise ValueError(f"no path spells {word!r}")
                dead[at] = 1
                path.pop()
                stop = ends.pop() - 1
                at = ends[-1] if ends else 0
                prev = path[-1] if path else -1
                continue
            path.append(label)
            ends.append(found)
            if found == n:
                return path
            at, prev = found, label
            stop = min(n, at + limit.get(word[at], 1))


class Codec:
    """Text to ids and back for one tokenizer file (BPE over byte letters with an end-of-word suffix)."""

    def __init__(self, spec: dict, cached: int = CACHED_CHUNKS):
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("a BPE tokenizer file is needed")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        labels = [""] * size
        for label, i in model["vocab"].items():
            labels[i] = label
        end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec))
        self.automaton = MergeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], end)
        self.labels = list(labels)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.labels[i] = content
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple({c[:2] for c in self.special})
        self.letters = {b: ord(c) for b, c in byte_letters().items()}
        self.pre = regex.compile(PRE_SPLIT)
        self.cached = cached
        self.chunks = Kept(self.part_ids, cached)
        self.words: dict[str, tuple[int, ...]] = {}

    def split(self, chunk: str) -> list[str]:
        """The chunk's words, in byte letters.

        Below U+0250 all is in NFC and lower case has no rule that looks at neighbours, so Python's own functions do;
        other scripts go through the file's normalizer and pre-tokenizer, whose Unicode version decides.
        """
        if max(chunk) >= "ɐ":
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        chunk = chunk.lower()
        if chunk.isalpha():
            words = [chunk]
        elif chunk[-1] in ".," and chunk[:-1].isalpha():
            words = [chunk[:-1], chunk[-1]]
        else:
            words = self.pre.findall(chunk)
        return words if chunk.isascii() and chunk.isprintable() else [w.encode("utf-8").decode("latin-1").translate(self.letters) for w in words]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run without white space and without special tokens."""
        words, out = self.words, []
        for word in self.split(chunk):
            ids = words.get(word)
            if ids is None:
                ids = tuple(self.automaton.walk(word))
                if len(words) < self.cached:
                    words[word] = ids
            out.extend(ids)
        return tuple(out)

    def parts(self, text: str) -> list[str]:
        """Special tokens and runs without white space, in order."""
        if self.special_split and any(m in text for m in self.marks):
            out: list[str] = []
            for k, part in enumerate(self.special_split.split(text)):
                out.extend([part] if k % 2 else self._runs(part))
            return out
        return self._runs(text)

    def _runs(self, text: str) -> list[str]:
        return white_runs(text)

    def part_ids(self, part: str) -> tuple[int, ...]:
        return (self.special[part],) if part in self.special else self.chunk_ids(part)

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, self.parts(text))))

    def decode(self, ids: Iterable[int]) -> str:
        """Arc labels joined by one space, as the library does for a file without a decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


def codec(spec: str) -> Codec:
    """The compiled codec of a tokenizer file's content, one per worker."""
    return sole(("codec", spec), lambda: Codec(json.loads(spec)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_frame(docs: DataFrame, tokenizer_path: str, keep: Iterable[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns plus ``ids`` (array of int) of every whole text.

    A null text counts as empty and gets an empty array.  The tokenizer file is read on the driver and broadcast: its
    size does not grow with the data.  Output columns are only ``keep`` and ``ids``, so other columns cannot clash.
    """
    keep = list(keep)
    spark = docs.sparkSession
    runtime.ship(spark)
    spec = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = source.select(*keep, F.lit(None).cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(spec.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # ids take many times the room of their text here
                some = batch.slice(lo, 500)
                ids = pa.array([made.ids(t) for t in some.column(len(keep)).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], ids], names=[*keep, "ids"])

    return source.mapInArrow(run, schema)


def decode_frame(encoded: DataFrame, tokenizer_path: str, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``decoded``, the labels of ``ids`` (null ids count as none) joined by spaces."""
    keep = list(keep)
    spark = encoded.sparkSession
    runtime.ship(spark)
    spec = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    source = encoded.select(*keep, F.coalesce(F.col("ids"), F.array().cast("array<int>")).alias("ids"))
    schema = source.select(*keep, F.lit("").cast("string").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(spec.value)
        for batch in batches:
            out = pa.array([made.decode(x) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], out], names=[*keep, "decoded"])

    return source.mapInArrow(run, schema)


def roundtrip_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded text.

    Encoding and decoding run in one pass, so neither ids nor decoded texts leave the worker.  A null text counts as
    empty; rows with equal or null ids are each kept.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    spec = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(spec.value)

        def spell(part: str) -> tuple[int, str, str]:
            ids = made.part_ids(part)
            return len(ids), " ".join(map(str, ids)), made.decode(ids)

        kept = Kept(spell, CACHED_SPELLINGS)
        for batch in batches:
            n, digests, decoded = [], [], []
            for t in batch.column(1).to_pylist():
                counts, numerals, labels = zip(*map(kept.__getitem__, made.parts(t)), strict=True) if t and not t.isspace() else ((), (), ())
                n.append(sum(counts))
                digests.append(hashlib.sha256(" ".join(numerals).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join(labels).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("__text")).mapInArrow(run, DIGEST)
