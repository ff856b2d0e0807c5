"""What the iterative algorithms share: arcs bucketed by row, and rounds that are written and counted in one job."""

from __future__ import annotations

import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from arcspool.operators.model import SEGMENT
from arcspool.plans.stash import drop, shared_dir, shuffle_partitions, stash


class KeptArcs:
    """Arcs (row_id, part, nbr) within 0 to n-1 in a bucketed table, so that no round shuffles or sorts them again.

    The arcs of a row with more than ``segment`` are spread over parts by a hash
    of the neighbour, so a hub doesn't make one long task; ``keyed`` repeats a
    hub's row of a frontier for each of its parts.
    """

    def __init__(self, arcs: DataFrame, nodes: DataFrame, n: int, segment: int = SEGMENT):
        spark = arcs.sparkSession
        hubs, seen = write_counted(nodes.where(F.col("degree") > segment).select(F.col("id").alias("hub"), F.ceil(F.col("degree") / segment).cast("int").alias("parts")), "hubs", n=F.count(F.lit(1)))
        self.hubs = hubs if seen["n"] else None
        arcs = arcs.where(F.col("nbr").between(0, n - 1)).select("row_id", "nbr")
        part = F.lit(0)
        if self.hubs is not None:
            arcs = arcs.join(self.hubs, arcs["row_id"] == self.hubs["hub"], "left")
            part = F.coalesce(F.pmod(F.xxhash64("nbr"), F.col("parts")).cast("int"), F.lit(0))
        buckets = shuffle_partitions(spark)
        self.name = f"arcs_{uuid.uuid4().hex}"
        rows = arcs.select("row_id", part.alias("part"), "nbr").repartition(buckets, "row_id", "part")
        path = f"{shared_dir(spark)}/tables/{self.name}"
        rows.write.bucketBy(buckets, "row_id", "part").sortBy("row_id", "part").option("path", path).saveAsTable(self.name, format="parquet")
        self.table = spark.table(self.name).persist(StorageLevel.MEMORY_AND_DISK)  # lost blocks come from the table again
        self.table.stash_path = path
        weakref.finalize(self, _drop_table, spark, self.name, self.table)

    def keyed(self, df: DataFrame, row_id: str) -> DataFrame:
        """``df`` with row_id and part to join with the arcs."""
        df = df.withColumnRenamed(row_id, "row_id")
        if self.hubs is None:
            return df.withColumn("part", F.lit(0))
        return df.join(self.hubs, df["row_id"] == self.hubs["hub"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("hub", "parts")

    def of(self, df: DataFrame, row_id: str) -> DataFrame:
        """``df`` joined with the arcs of its rows."""
        return self.table.join(self.keyed(df, row_id), ["row_id", "part"]).drop("part")


def _drop_table(spark, name: str, table: DataFrame) -> None:
    try:
        table.unpersist()
        spark.sql(f"drop table if exists {name}")
        drop(table)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def kept_arcs(graph, whole: bool = False):
    """(arcs, nodes, n) of a Hypergraph or an Encoded; made once, used by every algorithm, dropped with the graph.

    An Encoded gives its own blocks, of which each round decodes the rows it asks
    for; with ``whole``, for algorithms whose every round asks for all rows, the
    arcs are decoded once and kept as those of a Hypergraph.
    """
    if not whole and hasattr(graph, "of"):
        arcs, nodes, n = graph, graph.side.nodes, graph.side.n
        if n <= 0:
            raise ValueError("the hypergraph has no nodes")
        if getattr(graph, "_nodes", None) is None:
            graph._nodes = stash(nodes, "nodes")
        return arcs, graph._nodes, n
    if getattr(graph, "_kept", None) is None:
        arcs, nodes, n = graph.merged()
        if n <= 0:
            raise ValueError("the hypergraph has no nodes")
        nodes = stash(nodes, "nodes")
        graph._kept = KeptArcs(arcs, nodes, n), nodes, n
    return graph._kept


def write_counted(df: DataFrame, tag: str, **measures: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` and take ``measures`` of it in the same job."""
    seen = Observation()
    out = stash(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), tag)
    return out, seen.get
