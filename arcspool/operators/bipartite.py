"""The algorithms on the bipartite incidence graph, by their own names: vertices and hyperedges are different nodes here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.operators.bfs import bfs
from arcspool.operators.components import connected_components
from arcspool.operators.iterate import KeptArcs, write_counted
from arcspool.operators.model import Hypergraph
from arcspool.plans.stash import drop, stash


class _Incidence:
    """Both directions of the incidences as bucketed arcs: vertex v is node 2v, hyperedge e is node 2e + 1. Made once for a graph and dropped with it."""

    def __init__(self, graph: Hypergraph):
        v, e = F.col("vertex") * 2, F.col("edge") * 2 + 1
        both = graph.arcs.select(F.explode(F.array(F.struct(v.alias("row_id"), e.alias("nbr")), F.struct(e.alias("row_id"), v.alias("nbr")))).alias("x")).select("x.*")
        self.sizes = stash(both.groupBy(F.col("row_id").alias("id")).agg(F.count("*").alias("degree")), "sizes")
        self.vertices = stash(graph.vertices.select((F.col("id") * 2).alias("id")), "nodes")
        self.arcs = KeptArcs(both, self.sizes, 1 << 62)
        self._kept = self.arcs, self.vertices, 1 << 62  # what ``kept_arcs`` gives to the algorithms


def _incidence(graph: Hypergraph) -> _Incidence:
    if getattr(graph, "_incidence", None) is None:
        graph._incidence = _Incidence(graph)
    return graph._incidence


def bipartite_bfs(graph: Hypergraph, source: int) -> DataFrame:
    """(id, dist) of every vertex: hops from vertex to vertex through a shared hyperedge, null if out of reach."""
    if not 0 <= source < graph.n_vertices:
        raise ValueError(f"no vertex {source}")
    half = lambda c: F.shiftright(c, 1).alias(c)  # noqa: E731  a hop is two arcs
    return bfs(_incidence(graph), [2 * source]).select(half("id"), half("dist"))


def components(graph: Hypergraph) -> DataFrame:
    """(kind, id, component): vertices and hyperedges of one component have its smallest vertex; a hyperedge without vertices has null, a vertex without hyperedges itself."""
    nv = graph.n_vertices
    linked = connected_components(graph.arcs.select(F.col("vertex").alias("a"), (F.col("edge") + nv).alias("b")))
    nodes = graph.vertices.select("id").unionByName(graph.edges.select((F.col("id") + nv).alias("id")))
    own = F.when(F.col("id") < nv, F.col("id"))
    found = nodes.join(linked.withColumnRenamed("node", "id"), "id", "left")
    kind = F.when(F.col("id") < nv, "vertex").otherwise("hyperedge")
    return found.select(kind.alias("kind"), F.when(F.col("id") < nv, F.col("id")).otherwise(F.col("id") - nv).alias("id"), F.coalesce("comp", own).alias("component"))


def bipartite_pagerank(graph: Hypergraph, iters: int = 20, alpha: float = 0.85) -> DataFrame:
    """(id, pr) of every vertex: shares go to a vertex's hyperedges and from those to their vertices; vertices without hyperedges spread theirs evenly."""
    nv = graph.n_vertices
    if nv <= 0:
        raise ValueError("the hypergraph has no vertices")
    held = _incidence(graph)
    idle = F.sum(F.when(F.col("degree") == 0, F.col("pr")).otherwise(0.0))
    edges = held.sizes.where("id % 2 = 1")

    def push(nodes: DataFrame, value: str, to: DataFrame) -> DataFrame:
        """(id, degree, s) of ``to``: the shares that ``nodes`` send along their arcs, in one aggregate with the receivers."""
        out = nodes.where("degree > 0").select("id", (F.col(value) / F.col("degree")).alias("share"))
        sent = held.arcs.of(out, "id").select(F.col("nbr").alias("id"), F.lit(None).cast("long").alias("degree"), "share")
        both = sent.unionByName(to.select("id", "degree", F.lit(0.0).alias("share")))
        return both.groupBy("id").agg(F.max("degree").alias("degree"), F.sum("share").alias("s")).where("degree is not null")

    first = held.vertices.join(held.sizes, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(1.0 / nv).alias("pr"))
    pr, seen = write_counted(first, "pr", idle=idle)
    for _ in range(iters):
        back = push(push(pr, "pr", edges), "s", pr)
        value = F.lit((1 - alpha) / nv) + F.lit(alpha) * (F.col("s") + F.lit((seen["idle"] or 0.0) / nv))
        nxt, seen = write_counted(back.select("id", "degree", value.alias("pr")), "pr", idle=idle)
        drop(pr)
        pr = nxt
    return pr.select(F.shiftright("id", 1).alias("id"), "pr")


def bipartite_k_core(graph: Hypergraph, k: int) -> DataFrame:
    """(id, in_core) of every vertex: vertices in fewer than ``k`` live hyperedges go, hyperedges with fewer than two live vertices die, until neither happens."""
    arcs = stash(graph.arcs.select("edge", "vertex").distinct(), "arcs")
    n = None
    while True:
        live = arcs.groupBy("edge").agg(F.count("*").alias("n")).where("n >= 2").select("edge")
        arcs2 = arcs.join(live, "edge", "left_semi")
        stay = arcs2.groupBy("vertex").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("vertex")
        nxt, count = write_counted(arcs2.join(stay, "vertex", "left_semi"), "arcs", n=F.count(F.lit(1)))
        drop(arcs)
        arcs = nxt
        if count["n"] == n:
            break
        n = count["n"]
    core = arcs.select(F.col("vertex").alias("id")).distinct().withColumn("c", F.lit(True))
    if k <= 0:
        return graph.vertices.select("id", F.lit(True).alias("in_core"))
    return graph.vertices.join(core, "id", "left").select("id", F.coalesce("c", F.lit(False)).alias("in_core"))
