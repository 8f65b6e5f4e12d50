"""Operators 8 and 10: ids equal the tokenizers library's, and come back whole."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tokenizers

from llm_rows import as_rows
from llm_rows import texts as made_texts
from graphmine.llm import bpe_automaton as bpe
from graphmine.llm import repair_store as store
from graphmine.llm import runtime
from graphmine.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_automaton_equals_library_on_odd_texts(library):
    codec = bpe.codec(open(PATH, encoding="utf-8").read())
    rnd = random.Random(5)
    letters = list("aabcdeeehiillmnoorrrrsttu  '.,;-_<|>/\n\t\x1c\x85 éüßİΣςſK中字한ا019½²ªº́̈ﬁ😀​")
    for k in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        if k % 9 == 0:
            text += "<|endoftext|>" + text[:4] + "<|startoftext|>"
        if k % 5 == 0:
            text = "".join(chr(rnd.choice([rnd.randint(1, 0x7FF), rnd.randint(0x800, 0xD7FF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(8))
        ids = codec.ids(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for word in ("r" * 9, "nrrrr", "l" * 30, "ab" * 40):
        assert codec.ids(word) == library.encode(word, add_special_tokens=False).ids


def test_automaton_equals_plain_merging():
    """All words up to six letters over a merge list with equal and overlapping pairs."""
    labels, merges = ["a", "b"], []
    for a, b in (("a", "a"), ("a", "b"), ("aa", "a"), ("ab", "a"), ("b", "ab")):
        labels.append(a + b)
        merges.append((labels.index(a), labels.index(b), labels.index(a + b)))
    automaton = bpe.MergeAutomaton(labels, merges, "")

    def merged(word):
        parts = [labels.index(c) for c in word]
        for a, b, ab in merges:
            k = 0
            while k < len(parts) - 1:
                if parts[k : k + 2] == [a, b]:
                    parts[k : k + 2] = [ab]
                k += 1
        return parts

    for n in range(1, 7):
        for k in range(1 << n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert automaton.walk(word) == merged(word), word


def test_query_digests(spark, docs, rows, library):
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = as_rows(bpe.roundtrip_digest(docs, PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(want, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_frames_keep_columns(spark, docs, clashing, empty, library):
    coded = bpe.encode_frame(clashing.drop("ids"), PATH, ["doc_id", "name"])
    assert coded.columns == ["doc_id", "name", "ids"] and coded.count() == docs.count()
    back = bpe.decode_frame(coded, PATH)
    some = back.where("doc_id = 103").first()["decoded"]
    assert some == library.decode(library.encode("one", add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.encode_frame(empty, PATH).count() == 0 and bpe.roundtrip_digest(empty, PATH).count() == 0


def test_grammar_round_trip_and_random_access():
    rnd = random.Random(1)
    for _ in range(150):
        ids = np.array([rnd.choice([1, 1, 1, 2, 3]) for _ in range(rnd.randint(0, 300))], np.uint16)
        shard = store.Shard(store.pack([7, None], [len(ids) // 2, len(ids) - len(ids) // 2], ids, 10))
        assert shard.ids().tolist() == ids.tolist() and shard.doc_ids == [7, None]
        assert shard.document(1).tolist() == ids[len(ids) // 2 :].tolist()
        a, b = sorted((rnd.randint(0, len(ids)), rnd.randint(0, len(ids))))
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()
    rules, seq = store.compress(np.array([5, 6] * 500, np.uint16), 10)
    assert len(rules) and len(seq) < 600 and store.lengths(rules, 10)[-1] >= 2
    with pytest.raises(ValueError):
        store.Shard(b"none of it")


@pytest.mark.parametrize("shard_ids", [50, 1 << 20])
def test_store(spark, docs, rows, library, shard_ids):
    path = runtime.new_path(spark, "test-store")
    store.write_store(docs, PATH, path, end_id=2, shard_ids=shard_ids)
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert as_rows(store.read_store(spark, path), "start", "doc_id", "n_tokens", "ids_crc32") == want
    assert (spark.read.parquet(path).count() > 20) == (shard_ids == 50)


def test_repeated_passages_shrink_to_a_symbol():
    rnd = np.random.default_rng(1)
    passage = rnd.integers(0, 40_000, 50)
    ids = np.concatenate([np.concatenate([passage, rnd.integers(0, 40_000, 5)]) for _ in range(1000)]).astype(np.uint16)
    rules, seq = store.compress(ids, 49_408)
    assert len(seq) == 6000 and store.lengths(rules, 49_408).max() == 50
    shard = store.Shard(store.pack([1], [len(ids)], ids, 49_408))
    assert np.array_equal(shard.ids(), ids)


def test_store_of_nothing(spark, empty):
    path = runtime.new_path(spark, "test-store")
    store.write_store(empty, PATH, path, end_id=2)
    assert store.read_store(spark, path).count() == 0


def test_runs_give_the_ids_of_whole_texts(spark):
    """The store's encoder against the library on whole texts of a whole table."""
    from graphmine.llm.queries import tokenizer

    spec = open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read()
    library = tokenizers.Tokenizer.from_str(spec)
    texts = [r.text or "" for r in runtime.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()] + [t or "" for _, t in made_texts()]
    raw, counts = store.LibraryIds(spec, 1000).batch(texts, 2)
    ids, at = np.frombuffer(raw, "<u2").tolist(), 0
    for made, n in zip(library.encode_batch(texts, add_special_tokens=False), counts, strict=True):
        assert ids[at : at + n] == [*made.ids, 2]
        at += n
