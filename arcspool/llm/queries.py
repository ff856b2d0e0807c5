"""Registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspool.llm import exact_dedup, html_text, lattice_lm, mixing, oracles, packing, pu_quality, quality_rules, simhash, suffix_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdict under the production thresholds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept"]
    return quality_rules.judge(docs).select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of one fold of three are held out."""
    made = pu_quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return made.withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate class."""
    made = simhash.near_dups(_table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    made = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url with its rule and verdict."""
    made = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return made.select("page_id", *[F.col(f"url_filter.{f}").alias(f) for f in ("host", "path", "rule", "verdict", "score")])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its block, release, deadline and slot; weights follow the square roots of the sources' sizes."""
    made = mixing.schedule(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return made.select("doc_id", "source", *[F.col(f"mix.{f}").alias(f) for f in ("parts", "block", "place", "release", "due", "slot")])


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and lattice log10 probabilities; one fold of five is held out."""
    return lattice_lm.score(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what removing repeated 100-byte strings leaves of it."""
    made = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return suffix_dedup.digest(made).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py one after another."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    "op1_pu_quality": op1_pu_quality,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_lattice_lm": op8_lattice_lm,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "pipeline": pipeline,
}
#: The other operators aren't SQL; tests/llm hold them against brute force, round trips or held-out accuracy.
ORACLES = {"op5_mixing": oracles.op5(), "op6_exact_dedup": oracles.OP6, "op7_quality_rules": oracles.op7()}
