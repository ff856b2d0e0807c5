"""The data model: a hypergraph as tables, and the merged view that the algorithms run on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspool.plans.rank import rank_within

#: Neighbours of a row beyond so many are numbered as further segments of it, so that no row makes one long task.
SEGMENT = 1 << 16


@dataclass
class Side:
    """Rows of one side: ``arcs`` (row_id, pos, nbr), ``nodes`` (id, degree), row and symbol counts."""

    arcs: DataFrame
    nodes: DataFrame
    n: int
    symbols: DataFrame
    n_symbols: int
    name: str


@dataclass
class Hypergraph:
    """``arcs`` (edge, vertex[, edge_pos, vertex_pos]) with the id domains ``edges`` and ``vertices`` (id).

    Ids are dense longs from 0. Incidences form a multiset and are never made distinct.
    """

    arcs: DataFrame
    edges: DataFrame
    vertices: DataFrame
    n_edges: int
    n_vertices: int
    _sides: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_incidence(cls, df: DataFrame, edge: str, vertex: str, edges: DataFrame | None = None, vertices: DataFrame | None = None, order: list[Column] | None = None) -> Hypergraph:
        """From a table with a row for each incidence.

        Incidences with a null end are ignored. ``edges`` and ``vertices`` (first column: id) give ids without incidences
        too; by default the domain is 0 to the largest id. ``order`` orders a
        row's neighbours (default: by id).
        """
        arcs = df.select(F.col(edge).cast("long").alias("edge"), F.col(vertex).cast("long").alias("vertex"), *[c.alias(f"o{i}") for i, c in enumerate(order or [])]).where("edge is not null and vertex is not null")
        spark = df.sparkSession

        def domain(given, name):
            if given is not None:
                return given.select(F.col(given.columns[0]).cast("long").alias("id"))
            top = arcs.agg(F.coalesce(F.max(name), F.lit(-1))).first()[0]
            return spark.range(top + 1).select("id")

        e, v = domain(edges, "edge"), domain(vertices, "vertex")
        return cls(arcs, e, v, e.count(), v.count())

    def order(self) -> list[str]:
        return [c for c in self.arcs.columns if c[0] == "o" and c[1:].isdigit()]

    def choose(self, side: str = "auto") -> str:
        """``hyperedge`` if there are no more vertices than hyperedges, else ``vertex``."""
        if side == "auto":
            return "hyperedge" if self.n_vertices <= self.n_edges else "vertex"
        if side not in ("hyperedge", "vertex"):
            raise ValueError(f"no such side: {side}")
        return side

    def side(self, side: str = "auto", positions: bool = True) -> Side:
        """The rows of a side; ``positions`` numbers each row's neighbours (pos), without it pos is 0."""
        name = self.choose(side)
        if (name, positions) not in self._sides:
            row, nbr, rows, symbols = ("edge", "vertex", self.edges, self.vertices) if name == "hyperedge" else ("vertex", "edge", self.vertices, self.edges)
            arcs = self.arcs.withColumnsRenamed({row: "row_id", nbr: "nbr"})
            given = f"{row}_pos"
            if not positions:
                arcs = arcs.withColumn("pos", F.lit(0).cast("long"))
            elif given in arcs.columns:
                arcs = arcs.withColumn("pos", F.col(given).cast("long"))
            else:
                arcs = rank_within(arcs, ["row_id"], [*[F.col(c) for c in self.order()], F.col("nbr")], "pos")
            arcs = arcs.select("row_id", "pos", "nbr")
            nodes = degrees(arcs, "row_id", rows)
            n, m = (self.n_edges, self.n_vertices) if name == "hyperedge" else (self.n_vertices, self.n_edges)
            self._sides[name, positions] = Side(arcs, nodes, n, degrees(arcs, "nbr", symbols).withColumnRenamed("degree", "freq"), m, name)
        return self._sides[name, positions]

    def merged(self) -> tuple[DataFrame, DataFrame, int]:
        """(arcs, nodes, n) of the automatic side: its neighbour ids are read as ids of the same nodes 0 to n-1."""
        s = self.side(positions=False)
        return s.arcs, s.nodes, s.n

    def encode(self, pct: float, block_size: int = 1024, side: str = "auto"):
        from arcspool.operators.encode import encode

        return encode(self.side(side), pct, block_size)


def degrees(arcs: DataFrame, by: str, domain: DataFrame) -> DataFrame:
    """(id, degree) of every id of ``domain``, with 0 for those without an arc."""
    found = arcs.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("degree"))
    return domain.join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
