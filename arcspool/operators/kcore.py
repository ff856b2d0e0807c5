"""k-core by peeling: a node's budget is its number of arcs; each arc from a removed node takes one from its target's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.operators.iterate import kept_arcs, write_counted
from arcspool.plans.stash import drop

#: Rounds that are planned, run and written as one job.
BATCH = 1


class _Peel:
    """The state (id, budget, gone, core) over rising k; gone is the round in which a node went, 0 while it stays."""

    def __init__(self, graph, batch: int = BATCH):
        self.arcs, nodes, self.n = kept_arcs(graph)
        self.state = nodes.select("id", F.col("degree").alias("budget"), F.lit(0).alias("gone"), F.lit(0).alias("core"))
        self.k, self.turn, self.batch = 0, 1, batch

    def _mark(self, df: DataFrame) -> DataFrame:
        falls = (F.col("gone") == 0) & (F.col("budget") < self.k)
        return df.select("id", "budget", F.when(falls, self.turn).otherwise(F.col("gone")).alias("gone"), "core")

    def to(self, k: int) -> DataFrame:
        """Peel for ``k``, not less than before; cores are nested, so the state goes on from the last k."""
        if k < self.k:
            raise ValueError("k must not fall")
        self.k = k
        state, old = self._mark(self.state), self.state
        while True:
            for _ in range(self.batch):
                fresh = state.where(F.col("gone") == self.turn).select("id")
                taken = self.arcs.of(fresh, "id").groupBy(F.col("nbr").alias("id")).agg(F.count("*").alias("taken"))
                self.turn += 1
                state = self._mark(state.join(taken, "id", "left").select("id", (F.col("budget") - F.coalesce("taken", F.lit(0))).alias("budget"), "gone", "core"))
            state, seen = write_counted(state, "core", fresh=F.sum((F.col("gone") == self.turn).cast("long")))
            drop(old)
            old = state
            if not seen["fresh"]:
                break
        self.turn += 1  # nodes that fall for the next k go in a round of their own
        self.state = state.select("id", "budget", "gone", F.when(F.col("gone") == 0, k).otherwise(F.col("core")).alias("core"))
        self.state.stash_path = state.stash_path
        return self.state.select("id", (F.col("gone") == 0).alias("in_core"))


def k_core(graph, k: int) -> DataFrame:
    """(id, in_core) of every node. The core is the complement of the least set R with: u is in R if its arcs, less those into it from R, are fewer than k."""
    return _Peel(graph).to(k)


def core_numbers(graph, k_max: int = 5) -> DataFrame:
    """(id, core): the largest k up to ``k_max`` whose core has the node, 0 if none."""
    peel = _Peel(graph)
    for k in range(1, k_max + 1):
        peel.to(k)
    return peel.state.select("id", "core")
