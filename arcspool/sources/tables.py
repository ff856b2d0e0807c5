"""Hypergraphs from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspool.operators.model import Hypergraph
from arcspool.plans.rank import rank_within
from arcspool.plans.stash import stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_part(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Orders as hyperedges over parts; a line item is an incidence."""
    lines = table(spark, sf_dir, "lineitem")
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return Hypergraph.from_incidence(lines, "l_orderkey", "l_partkey", table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "part").select("p_partkey"), order)


def doc_token(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Documents as hyperedges over the distinct lower-case tokens of their text; tokens are numbered in binary order."""
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("token")).where("token != ''")
    tokens = stash(rank_within(pairs.select("token").distinct(), [], [F.col("token")], "token_id"), "tokens")
    return Hypergraph.from_incidence(pairs.join(tokens, "token"), "doc_id", "token_id", docs.select("doc_id"), tokens.select("token_id"))


def user_event(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Users as hyperedges over event types, which are numbered in binary order."""
    events = table(spark, sf_dir, "events")
    types = rank_within(events.select("event_type").distinct(), [], [F.col("event_type")], "type_id")
    return Hypergraph.from_incidence(events.join(types, "event_type"), "user_id", "type_id", order=[F.col("event_id")])
