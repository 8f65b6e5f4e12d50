"""The ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmine.llm import bpe_automaton, decontaminate, fertility_rules, hilbert_shards, lattice_lm, line_dedup, ngram_join, quote_links, repair_store, runtime, zstd_secrets
from graphmine.llm.runtime import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; ``GRAPHMINE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("GRAPHMINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text by the lattice model, and the word-unigram base; null texts are empty."""
    return lattice_lm.score(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its dropped lines, and the counts of lines; null texts stay null."""
    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its set size, component and number of links; texts without words link with nothing."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op5_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, tokenizer measures and verdict of every row; null texts fail the base rules."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = fertility_rules.judge(docs, tokenizer("piece_bpe_32k.model"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
    names = [*fertility_rules.BASE, *fertility_rules.MEASURES, "base_failed", "kept"]
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col("__q_" + k).alias(k) for k in names))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row under the law `rows`."""
    return hilbert_shards.assign_documents(table(spark, sf_dir, "documents"), 16)


def op7_zstd_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest and all spans of every text; null texts have none."""
    return zstd_secrets.scan(table(spark, sf_dir, "documents"))


def op8_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document, read back from the grammar-compressed store."""
    path = runtime.new_path(spark, "op8")
    repair_store.write_store(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path, end_id=2)
    return repair_store.read_store(spark, path)


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with what it replies to, its root and its text without quotes."""
    return quote_links.link(table(spark, sf_dir, "conversations"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row; null texts are empty."""
    return bpe_automaton.roundtrip_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lattice_lm": op1_lattice_lm,
        "op2_decontaminate": op2_decontaminate,
        "op4_line_dedup": op4_line_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op5_fertility_rules": op5_fertility_rules,
        "op6_hilbert_shards": op6_hilbert_shards,
        "op7_zstd_secrets": op7_zstd_secrets,
        "op8_repair_store": op8_repair_store,
        "op9_quote_links": op9_quote_links,
        "op10_bpe_automaton": op10_bpe_automaton,
    }


def oracle_sql() -> dict[str, str]:
    return {}
