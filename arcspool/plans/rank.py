"""Ranks over sorted data without a window that needs a whole key, or the whole table, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspool.plans.stash import stash


def salted(*columns: str) -> Column:
    """A negative key that depends on ``columns``: it meets no id and spreads rows that needn't meet anything."""
    return -1 - F.pmod(F.xxhash64(*columns), F.lit(1 << 20))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with a 0-based rank ``name`` (long) among the rows of equal ``keys`` (none: of all) in ``order``.

    Rows are dealt into ranges of (keys, order), so that the rows of a hot key
    spread over partitions; each partition ranks its own and adds the rows of the
    same key in the partitions before it. ``order`` must be total for the ranks to
    be the same each time.
    """
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_pid", F.spark_partition_id())
    dealt = stash(dealt, "ranges")
    cells = dealt.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*keys, "_pid", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_pid").orderBy(*order)) - 1)
    return own.join(cells, [*keys, "_pid"]).withColumn(name, (F.col("_ahead") + F.col("_own")).cast("long")).drop("_pid", "_own", "_ahead")
