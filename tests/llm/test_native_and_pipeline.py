"""Operators 6 and 9, and the pipeline."""

import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

import brute_links
import corpus_pipeline
from graphmine.llm import decontaminate, hilbert_shards, quote_links, runtime
from llm_rows import as_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2)])
def test_curve_visits_every_cell_by_single_steps(spark, n, bits):
    cells = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"x{k} int" for k in range(n)))
    at = {r.h: tuple(r)[:n] for r in df.withColumn("h", hilbert_shards.hilbert_index([F.col(f"x{k}") for k in range(n)], bits)).collect()}
    assert sorted(at) == list(range(1 << bits * n))
    assert all(sum(abs(a - b) for a, b in zip(at[h], at[h + 1], strict=True)) == 1 for h in range(len(at) - 1))


def test_shards(spark, docs, rows, clashing, empty):
    for df in (docs, clashing):
        got = hilbert_shards.assign_documents(df, 16).collect()
        assert len(got) == len(rows) and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
        sizes = {k: [r for r in got if r.shard == k] for k in range(16)}
        assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
        curve = -1
        for k in range(16):
            part = sorted(sizes[k], key=lambda r: r.slot)
            assert [r.slot for r in part] == list(range(len(part)))
            for r in part:
                assert r.curve >= curve
                curve = r.curve
        want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    assert hilbert_shards.assign_documents(empty).count() == 0
    assert hilbert_shards.assign_documents(docs.limit(3)).select("shard").distinct().count() == 3


def test_written_shards(spark, docs, tmp_path):
    hilbert_shards.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("__shard").distinct().count() == 4


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there my friend.\nHow are you today?"), (1, 1, "a", "> hello there  my friend.\nI am fine."), (1, 2, "u", ">> Hello there my friend.\n> I am fine.\nGreat to hear it."),
        (1, 3, "a", "On Monday bob wrote:\n> Great to hear\n> it.\nindeed so."), (1, 4, "u", "> unknown words here\nx"), (1, 5, "u", "> indeed so.\n"), (1, 5, "u", "> indeed so.\n"), (1, 1030, "a", "> hello there my friend.\nlate"),
        (2, 0, "u", None), (None, 1, "u", "> I am fine.\nq"), (2, None, "u", "a"), (2, 1, "u", ""), (2, 2, "a", "> I am fine.\nother conversation"), (3, 0, "u", "ok then\nmore"), (3, 1, "u", "ok then"), (3, 2, "u", "> ok then\nboth said so"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("level", F.lit("x"))
    got = {(r.conv_id, r.turn): r for r in quote_links.link(df).collect()}
    assert quote_links.link(df).count() == len(rows)
    links = {k: (r.reply_to, r.root_turn, r.depth) for k, r in got.items()}
    assert links == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (2, 0, 3), (1, 4): (None, 4, 0), (1, 5): (3, 0, 4), (1, 1030): (0, 0, 1), (2, 0): (None, 0, 0), (None, 1): (None, 1, 0), (2, None): (None, None, 0),
        (2, 1): (None, 1, 0), (2, 2): (None, 2, 0), (3, 0): (None, 0, 0), (3, 1): (None, 1, 0), (3, 2): (1, 1, 1),
    }
    assert got[1, 3].body == "indeed so." and got[1, 2].body == "Great to hear it." and got[1, 2].max_level == 2 and got[1, 2].n_quoted == 2
    assert got[2, 0].body is None and got[1, 0].body == rows[0][3] and got[1, 5].body == ""
    assert quote_links.link(df.limit(0)).count() == 0


def test_no_python_in_native_plans(docs, spark):
    empty = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    frames = [quote_links.link(empty), quote_links.keys(empty), hilbert_shards.assign_documents(docs)]
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.fixture(scope="module")
def stages(spark):
    docs = runtime.table(spark, SF, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, runtime.materialize(stage(spark, out[-1][1], SF), "test-pipeline")))
    return out


def test_pipeline_stages(spark, stages):
    frames = dict(stages)
    columns = frames["documents"].columns
    for name, df in stages[:-1]:
        assert df.columns == columns and df.schema == frames["documents"].schema, name
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in stages}
    order = [name for name, _ in stages]
    assert all(ids[b] <= ids[a] for a, b in zip(order, order[1:], strict=False)) and ids["bpe"] == ids["decontaminate"]
    before = as_rows(frames["line_dedup"], "doc_id", "text")
    keep = {i for i, _, least in brute_links.components(before) if i == least}
    assert ids["ngram_join"] == keep
    held = {r.doc_id for r in decontaminate.leaks(frames["ngram_join"], runtime.table(spark, SF, "benchmark")).collect()}
    assert ids["decontaminate"] == ids["ngram_join"] - held
    whole = {r.doc_id: r.text for r in frames["documents"].collect()}
    for r in frames["line_dedup"].collect():
        lines = iter(whole[r.doc_id].split("\n"))
        assert all(x in lines for x in r.text.split("\n"))
        assert r.n_chars == len(r.text) or r.text == whole[r.doc_id]
    seen = [x for r in frames["line_dedup"].collect() for x in r.text.split("\n") if x.strip()]
    assert len(seen) == len(set(seen))


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect())) == sorted(map(tuple, stages[-1][1].select("doc_id", "n_tokens").collect()))


def test_quotes_of_made_up_conversations(spark):
    """Nested quotes against a search of every earlier message, newest first."""
    import random

    rnd = random.Random(12)
    word = lambda: rnd.choice("alpha beta gamma delta omega sigma theta kappa".split()) + str(rnd.randrange(60))
    rows, want = [], {}
    for conv in range(25):
        own: list[list[str]] = []
        chain: list[list[int]] = []
        for turn in range(rnd.randint(1, 9)):
            lines = [" ".join(word() for _ in range(rnd.randint(2, 6))) for _ in range(rnd.randint(1, 3))]
            quoted, path = [], []
            if turn and rnd.random() < 0.7:
                at = rnd.randrange(turn)
                path = [at, *chain[at]]
                for level, t in enumerate(path, 1):
                    quoted += [">" * level + " " + x.upper() for x in own[t]]
            own.append(lines)
            chain.append(path)
            rows.append((conv, turn, "user", "\n".join([*quoted, "", *lines])))
            want[conv, turn] = (path[0] if path else None, path[-1] if path else turn, len(path), len(quoted))
    got = quote_links.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert {(r.conv_id, r.turn): (r.reply_to, r.root_turn, r.depth, r.n_quoted) for r in got.collect()} == want
