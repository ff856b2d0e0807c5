"""PageRank by pushing shares along arcs for a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.operators.iterate import kept_arcs, write_counted
from arcspool.plans.stash import drop


def pagerank(graph, iters: int = 20, alpha: float = 0.85) -> DataFrame:
    """(id, pr) of every node. Parallel arcs count each; arcs to ids outside 0 to n-1 lose their share; nodes without arcs spread theirs evenly.

    A round is one job. Shares meet their targets in one aggregate over the pushed
    shares and the nodes themselves, so hubs combine map-side and no second join
    is needed; the sum over nodes without arcs is observed while writing.
    """
    own, nodes, n = kept_arcs(graph, whole=True)
    idle = F.sum(F.when(F.col("degree") == 0, F.col("pr")).otherwise(0.0))
    pr, seen = write_counted(nodes.select("id", "degree", F.lit(1.0 / n).alias("pr")), "pr", idle=idle)
    for _ in range(iters):
        out = pr.where("degree > 0").select("id", (F.col("pr") / F.col("degree")).alias("share"))
        pushed = own.of(out, "id").select(F.col("nbr").alias("id"), F.lit(None).cast("long").alias("degree"), "share")
        base = pr.select("id", "degree", F.lit(0.0).alias("share"))
        summed = pushed.unionByName(base).groupBy("id").agg(F.sum("share").alias("s"), F.max("degree").alias("degree"))
        # targets outside the node table have no degree of their own
        summed = summed.where("degree is not null")
        nxt = summed.select("id", "degree", (F.lit((1 - alpha) / n) + F.lit(alpha) * (F.col("s") + F.lit((seen["idle"] or 0.0) / n))).alias("pr"))
        nxt, seen = write_counted(nxt, "pr", idle=idle)
        drop(pr)
        pr = nxt
    return pr.select("id", "pr")
