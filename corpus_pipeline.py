"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``. Filtering stages keep every document that their
operator doesn't reject; mixing keeps all rows and writes them in the order of
the schedule; packing takes its groups as stretches of that order, as the files
hold it, and returns the pieces with their sequences. A null in any
column, empty texts, repeated rows and empty tables are handled as the
operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcspool.llm import exact_dedup, mixing, packing, quality_rules, simhash
from arcspool.llm.exprs import free_name
from arcspool.llm.queries import tokenizer_path
from arcspool.plans.stash import drop, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    at = free_name(docs.columns, "place")
    return packing.pack(packing.file_places(docs, at), tokenizer_path(), place=at).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("packing", pack)]

#: Tokenization and first-fit placement aren't SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name.split()[0])
            if before is not None:  # nothing reads it any more
                drop(before)
            before = docs
    return docs
