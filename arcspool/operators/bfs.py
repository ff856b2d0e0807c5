"""Breadth-first search, several levels a job, from several sources in one loop."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.operators.iterate import kept_arcs, write_counted
from arcspool.plans.stash import drop

#: Levels that are planned, run and written as one job.
BATCH = 2


def bfs(graph, sources: Iterable[int], inf: int | None = None, batch: int = BATCH) -> DataFrame:
    """(src, id, dist) for every node and source; ``dist`` is null, or ``inf`` if given, where the source doesn't reach.

    ``graph`` is a Hypergraph or an Encoded. A level joins the frontier with the
    arcs (broadcast by Spark only where it is small) and merges what it reaches
    into the nodes seen so far, which keep their partitioning from level to level;
    ``batch`` levels are one job, so a node that was seen is shuffled once a job.
    """
    own, nodes, n = kept_arcs(graph)
    sources = list(dict.fromkeys(int(s) for s in sources))
    if not sources or any(not 0 <= s < n for s in sources):
        raise ValueError(f"sources must be nodes from 0 to {n - 1}")
    spark = nodes.sparkSession
    named = F.array(*[F.lit(s).cast("long") for s in sources])
    seen = spark.range(1).select(F.explode(named).alias("src")).select("src", F.col("src").alias("id"), F.lit(0).alias("dist"))
    level, old = 0, None
    while level < n:
        for _ in range(batch):
            front = seen.where(F.col("dist") == level).select("src", "id")
            step = own.of(front, "id").select("src", F.col("nbr").alias("id"), F.lit(level + 1).alias("found")).distinct()
            seen = seen.join(step, ["src", "id"], "full").select("src", "id", F.coalesce("dist", "found").alias("dist"))
            level += 1
        seen, count = write_counted(seen, "levels", last=F.max("dist"))
        if old is not None:
            drop(old)
        old = seen
        if count["last"] < level:
            break
    grid = nodes.select(F.explode(named).alias("src"), "id")
    dist = F.col("dist") if inf is None else F.coalesce("dist", F.lit(inf))
    return grid.join(seen, ["src", "id"], "left").select("src", "id", dist.cast("int").alias("dist"))


def bfs_levels(found: DataFrame) -> DataFrame:
    """(src, dist, n_nodes): the number of nodes at each distance."""
    return found.where("dist is not null").groupBy("src", "dist").agg(F.count("*").alias("n_nodes"))
