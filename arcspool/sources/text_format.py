"""The adjacency-hypergraph text format: a tag, four counts, then offsets and neighbours of both sides, as white-space-separated tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcspool.operators.model import Hypergraph
from arcspool.plans.stash import stash

TAG = "AdjacencyHypergraph"
#: Tokens that one task places together; neighbours of a row that go on one line.
CELL = 1 << 16
LINE = 1 << 12


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(at, token): every token with its place in the file. Lines keep the work parallel; places are summed by split and line.

    A folder's files follow each other by the number of a ``part-`` name (others first), then by path, whatever order Spark reads them in.
    """
    lines = spark.read.text(path).select(
        F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) as long)").alias("part"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        F.expr(r"filter(split(value, '\\s+'), x -> x != '')").alias("tokens"),
    )
    lines = stash(lines.where(F.size("tokens") > 0), "lines")
    totals = lines.groupBy("part", "file", "start").agg(F.sum(F.size("tokens")).alias("n"))  # a row for each split of a file
    order = Window.orderBy("part", "file", "start")
    totals = totals.select("file", "start", F.row_number().over(order).alias("split"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("split").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(F.broadcast(totals), ["file", "start"]).select("split", "ahead", "line", "tokens")
    placed = placed.withColumn("own", F.coalesce(F.sum(F.size("tokens")).over(inner), F.lit(0)))
    return placed.select((F.col("ahead") + F.col("own")).alias("base"), F.posexplode("tokens").alias("i", "token")).select((F.col("base") + F.col("i")).alias("at"), "token")


def _side(tokens: DataFrame, start: int, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, pos, nbr) and (id, degree) from ``n`` offsets at token ``start`` and the ``m`` neighbours behind them."""
    number = F.col("token").cast("long")
    offsets = tokens.where(F.col("at").between(start, start + n - 1)).select((F.col("at") - start).alias("id"), number.alias("o"))
    nxt = offsets.select((F.col("id") - 1).alias("id"), F.col("o").alias("stop"))
    rows = offsets.join(nxt, "id", "left").select("id", "o", (F.coalesce("stop", F.lit(m)) - F.col("o")).alias("degree"))
    # a mark where a row begins, and at the start of each further cell that it reaches into; a token is of the last mark before it
    cells = F.explode(F.expr(f"sequence(o div {CELL}, (o + degree - 1) div {CELL})")).alias("cell")
    marks = rows.where("degree > 0").select(F.col("id").alias("row_id"), "o", cells)
    marks = marks.select("cell", F.greatest("o", F.col("cell") * CELL).alias("e"), F.struct("row_id", "o").alias("mark"), F.lit(None).cast("long").alias("nbr"))
    nbrs = tokens.where(F.col("at").between(start + n, start + n + m - 1)).select((F.col("at") - start - n).alias("e"), number.alias("nbr"))
    nbrs = nbrs.select(F.expr(f"e div {CELL}").alias("cell"), "e", F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), "nbr")
    order = Window.partitionBy("cell").orderBy("e", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.unionByName(nbrs).withColumn("of", F.last("mark", ignorenulls=True).over(order)).where("mark is null and of is not null")
    return placed.select(F.col("of.row_id").alias("row_id"), (F.col("e") - F.col("of.o")).alias("pos"), "nbr"), rows.select("id", "degree")


def read_adjacency_hypergraph(spark: SparkSession, path: str) -> Hypergraph:
    """Read a file of the format. A wrong tag raises ValueError; a missing file, Spark's own error.

    Both sides of the file are read; the incidences are those of the hyperedges'
    lists with their places, and the vertices' lists give the places on that side.
    """
    tokens = stash(_tokens(spark, path), "tokens")
    head = {r.at: r.token for r in tokens.where("at < 5").collect()}
    if head.get(0) != TAG:
        raise ValueError(f"not a {TAG} file: {path}")
    nv, mv, nh, mh = (int(head[i]) for i in range(1, 5))
    by_vertex, _ = _side(tokens, 5, nv, mv)
    by_edge, _ = _side(tokens, 5 + nv + mv, nh, mh)
    arcs = by_edge.select(F.col("row_id").alias("edge"), F.col("nbr").alias("vertex"), F.col("pos").alias("edge_pos"))
    graph = Hypergraph(arcs, spark.range(nh).select("id"), spark.range(nv).select("id"), nh, nv)
    if graph.choose() == "vertex":
        graph.arcs = by_vertex.select(F.col("nbr").alias("edge"), F.col("row_id").alias("vertex"), F.col("pos").alias("vertex_pos"))
    return graph


def write_adjacency_hypergraph(graph: Hypergraph, path: str) -> None:
    """Write ``graph`` in the format, as a folder of text parts whose order is the file's: a line or, for a long row, more for each row of a side."""
    spark = graph.arcs.sparkSession
    frames, m = [], graph.arcs.count()
    head = " ".join(map(str, (TAG, graph.n_vertices, m, graph.n_edges, m)))
    frames.append(spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("line"), F.lit(head).alias("value")))
    for k, name in enumerate(("vertex", "hyperedge")):
        s = graph.side(name)
        cell = F.expr("id div 4096")
        nodes = s.nodes.withColumn("cell", cell)
        ahead = nodes.groupBy("cell").agg(F.sum("degree").alias("d"))
        ahead = ahead.select("cell", F.coalesce(F.sum("d").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
        own = F.coalesce(F.sum("degree").over(Window.partitionBy("cell").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = nodes.withColumn("own", own).join(ahead, "cell")
        frames.append(offsets.select(F.lit(2 * k + 1).alias("part"), "id", F.lit(0).cast("long").alias("line"), (F.col("own") + F.col("ahead")).cast("string").alias("value")))
        listed = s.arcs.groupBy("row_id", F.expr(f"pos div {LINE}").alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nbr"))), lambda x: x["nbr"].cast("string")), " ").alias("value"))
        frames.append(listed.select(F.lit(2 * k + 2).alias("part"), F.col("row_id").alias("id"), "line", "value"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out.repartitionByRange("part", "id", "line").sortWithinPartitions("part", "id", "line").select("value").write.text(path)
