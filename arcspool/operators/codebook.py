"""Ranking of symbols by frequency, the Huffman codebook of the most frequent, and the width of the others."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.functions.huffman import canonical, length_runs, tree_codes
from arcspool.operators.model import Side
from arcspool.plans.rank import rank_within
from arcspool.plans.stash import stash

#: Codebooks up to so many symbols get an exact tree on the driver and are broadcast; larger ones get canonical codes by a join.
DRIVER_SYMBOLS = 1 << 17
#: Of the larger ones, so many of the most frequent symbols are broadcast, as their keys are the hot ones of that join.
HOT_SYMBOLS = 1 << 17


def top_count(n_symbols: int, pct: float) -> int:
    """How many symbols ``pct`` percent are: rounded half up, from 0 to all."""
    return min(max(0, math.trunc(n_symbols * (pct * 0.01) + 0.5)), n_symbols)


def ranked_symbols(side: Side) -> DataFrame:
    """(rk, id, freq): symbols from 1 by falling frequency, ties by id; those that never occur take part."""
    ranked = rank_within(side.symbols.select("id", "freq"), [], [F.col("freq").desc(), F.col("id")], "rk")
    return ranked.select((F.col("rk") + 1).alias("rk"), "id", "freq")


def width_of(largest: int) -> int:
    """The bits that ids up to ``largest`` take, 1 at least."""
    return max(1, int(largest).bit_length())


@dataclass
class Codebook:
    """``table`` (symbol, freq, code, len[, no]); k symbols; ``fallback_bits`` for each other id; ``codes`` on the driver if it's small.

    If it isn't, codes are canonical: ``no`` counts symbols up by length and code,
    ``spans`` has (length, first code, number of codes) of each length, and the
    first ``hot`` symbols may be broadcast.
    """

    table: DataFrame
    k: int
    pct: float
    fallback_bits: int
    max_sym: int
    codes: list[tuple[int, str]] | None
    spans: list[tuple[int, int, int]] | None = None
    hot: int = HOT_SYMBOLS


def build(side: Side, pct: float, ranked: DataFrame | None = None, driver_symbols: int = DRIVER_SYMBOLS, hot: int = HOT_SYMBOLS) -> Codebook:
    """The codebook of the top ``pct`` percent of the side's symbols."""
    spark = side.arcs.sparkSession
    k = top_count(side.n_symbols, pct)
    ranked = stash(ranked if ranked is not None else ranked_symbols(side), "ranked")
    rest = ranked.where(F.col("rk") > k).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    top = ranked.where(F.col("rk") <= k)
    if k <= driver_symbols:
        rows = sorted(tuple(r) for r in top.select("rk", "id", "freq").collect())
        codes = tree_codes([r[2] for r in rows]) if rows else []
        table = spark.createDataFrame([(r[1], r[2], c, len(c)) for r, c in zip(rows, codes, strict=True)], "symbol long, freq long, code string, len int")
        return Codebook(table, k, pct, width_of(rest), rest, [(r[1], c) for r, c in zip(rows, codes, strict=True)])
    # one row a frequency comes to the driver: at most about the square root of twice the number of arcs
    histogram = [tuple(r) for r in top.groupBy("freq").agg(F.count("*").alias("n")).collect()]
    runs = canonical(length_runs(histogram))
    by_length: dict[int, tuple[int, int]] = {}
    for _, length, first, n in runs:
        low, have = by_length.get(length, (first, 0))
        by_length[length] = (min(low, first), have + n)
    lengths, base, passed = [(x, *by_length[x]) for x in sorted(by_length)], {}, 0
    for length, low, n in lengths:
        base[length], passed = passed - low, passed + n
    spans, total = [], 0
    for f, length, first, n in runs:
        spans.append((f, total + 1, total + n, length, first, base[length]))
        total += n
    spans_df = spark.createDataFrame(spans, "f long, lo long, hi long, len int, first long, base long")
    hit = top.join(spans_df, (top["freq"] == spans_df["f"]) & (top["rk"] >= spans_df["lo"]) & (top["rk"] <= spans_df["hi"]))
    code = F.expr("lpad(bin(first + (rk - lo)), len, '0')")
    table = stash(hit.select(F.col("id").alias("symbol"), "freq", code.alias("code"), "len", F.expr("base + first + (rk - lo)").alias("no")), "codebook")
    return Codebook(table, k, pct, width_of(rest), rest, None, lengths, hot)


def sweep(side: Side, pcts: list[float]) -> DataFrame:
    """(pct, k, fallback_bits, bits_hi, bits_lo) of each pct, from the ranking alone: nothing is encoded.

    Huffman costs come from histograms of frequencies, so neither symbols nor arcs reach the driver.
    """
    spark = side.arcs.sparkSession
    ranked = stash(ranked_symbols(side), "ranked")
    out = []
    for pct in pcts:
        k = top_count(side.n_symbols, pct)
        rest, low = ranked.where(F.col("rk") > k).agg(F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("freq"), F.lit(0))).first()
        histogram = [tuple(r) for r in ranked.where(F.col("rk") <= k).groupBy("freq").agg(F.count("*")).collect()]
        high = sum(f * length * n for f, length, n in length_runs(histogram)) if histogram else 0
        out.append((float(pct), k, width_of(rest), high, low * width_of(rest)))
    return spark.createDataFrame(out, "pct double, k long, fallback_bits int, bits_hi long, bits_lo long")


def best_allocation(side: Side, pcts: list[float]) -> DataFrame:
    """The row of ``sweep`` with the fewest bytes of streams and tree, with total_bytes."""
    size = F.ceil(F.col("bits_hi") / 8) + F.ceil(F.col("bits_lo") / 8) + F.when(F.col("k") > 0, (2 * F.col("k") - 1) * 24).otherwise(0)
    return sweep(side, pcts).withColumn("total_bytes", size.cast("long")).orderBy("total_bytes", "pct").limit(1)
