"""Registered queries of the core engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspool import oracles
from arcspool.operators import bipartite, codebook
from arcspool.operators.bfs import bfs, bfs_levels
from arcspool.operators.decode import sum_check
from arcspool.operators.encode import split_arcs
from arcspool.operators.kcore import core_numbers, k_core
from arcspool.operators.pagerank import pagerank
from arcspool.plans.stash import shared_dir
from arcspool.sources import tables
from arcspool.sources.text_format import read_adjacency_hypergraph, write_adjacency_hypergraph

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ROUND = 10
PCT = 20.0
SWEEP = [0.0, 0.25, 0.5, 1.0, 1.27, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes with the highest PageRank."""
    ranks = pagerank(tables.order_part(spark, sf_dir))
    return ranks.select("id", F.round("pr", ROUND).alias("pr")).orderBy(F.desc("pr"), "id").limit(10)


g1, g2, g3 = tables.order_part, tables.doc_token, tables.user_event


def rounded(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("pr", ROUND).alias("pr"))


# model
for _g, _name, _graph in (("", "G1", g1), ("doc_token_", "G2", g2), ("user_event_", "G3", g3)):
    register(f"{_g}degree_hyperedge", oracles.degree(_name, "edge"))(lambda s, d, g=_graph: g(s, d).side("hyperedge", positions=False).nodes)
    register(f"{_g}degree_vertex", oracles.degree(_name, "vertex"))(lambda s, d, g=_graph: g(s, d).side("vertex", positions=False).nodes)
    register(f"{_g}side_choice", oracles.side_choice(_name))(
        lambda s, d, g=_graph: (lambda h: s.range(1).select(F.lit(h.n_vertices).cast("long").alias("nv"), F.lit(h.n_edges).cast("long").alias("nh"), F.lit(h.choose() == "hyperedge").alias("encode_h"), F.lit(h.merged()[2]).cast("long").alias("n")))(g(s, d)))
    register(f"{_g}symbol_freq", oracles.symbol_freq(_name))(lambda s, d, g=_graph: g(s, d).side(positions=False).symbols)
    register(f"{_g}topk_symbols", oracles.topk(_name, PCT))(
        lambda s, d, g=_graph: (lambda x: codebook.ranked_symbols(x).where(F.col("rk") <= codebook.top_count(x.n_symbols, PCT)))(g(s, d).side(positions=False)))
    register(f"{_g}fallback_bits", oracles.fallback_bits(_name, PCT))(
        lambda s, d, g=_graph: (lambda b: s.range(1).select(F.lit(b.k).cast("long").alias("k"), F.lit(b.max_sym).cast("long").alias("max_sym"), F.lit(b.fallback_bits).cast("long").alias("fallback_bits")))(codebook.build(g(s, d).side(positions=False), PCT)))


@register("huffman_cost", oracles.huffman_cost("G1", PCT))
def huffman_cost(s, d):
    side = g1(s, d).side(positions=False)
    book = codebook.build(side, PCT)
    return book.table.agg(F.sum(F.col("freq") * F.col("len")).cast("long").alias("bits_hi"))


@register("codebook_kraft", "select 1.0::double as kraft")
def codebook_kraft(s, d):
    book = codebook.build(g1(s, d).side(positions=False), PCT)
    return book.table.agg(F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"))


@register("codebook_canonical_cost", oracles.huffman_cost("G1", PCT))
def codebook_canonical_cost(s, d):
    book = codebook.build(g1(s, d).side(positions=False), PCT, driver_symbols=0)
    return book.table.agg(F.sum(F.col("freq") * F.col("len")).cast("long").alias("bits_hi"))


# encode
@register("encode_split", oracles.encode_split("G1", PCT))
def encode_split(s, d):
    side = g1(s, d).side(positions=False)
    book = codebook.build(side, PCT)
    each = split_arcs(side, book).groupBy("row_id").agg(F.count("code").alias("huff_count"), (F.count("*") - F.count("code")).alias("low_count"))
    return each.select("row_id", "huff_count", "low_count", (F.col("low_count") * book.fallback_bits).alias("low_bits"))


@register("entry_meta", oracles.entry_meta("G1", PCT))
def entry_meta(s, d):
    return g1(s, d).encode(PCT).entries().select("row_id", "degree", "huff_count")


@register("entry_totals", oracles.entry_totals("G1", PCT))
def entry_totals(s, d):
    return g1(s, d).encode(PCT).entries().agg(F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in ("degree", "huff_count", "bit_count")])


@register("block_bytes", oracles.block_bytes("G1", PCT))
def block_bytes(s, d):
    """Of every block the part of its bytes that doesn't depend on how equal frequencies share code lengths."""
    e = g1(s, d).encode(PCT).blocks
    return e.select("block_id", "bits_lo", F.octet_length("lo").cast("long").alias("lo_bytes"), F.size("row_ids").cast("long").alias("n_rows"), F.aggregate("degrees", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_arcs"))


@register("entry_bits")
def entry_bits(s, d):
    return g1(s, d).encode(PCT).entries()


@register("block_index", oracles.block_index("G1", PCT))
def block_index(s, d):
    return g1(s, d).encode(PCT).index().select("block_id", "lo_start_bit")


@register("codec_bytes")
def codec_bytes(s, d):
    e = g1(s, d).encode(PCT).blocks
    return e.select("block_id", "segment", F.hex("hi").alias("hi"), F.hex("lo").alias("lo"), "bits_hi", "bits_lo")


@register("codec_stats", oracles.codec_stats("G1", PCT))
def codec_stats(s, d):
    return g1(s, d).encode(PCT).stats().select("k", "fallback_bits", "bits_hi", "bits_lo", "tree_bytes", "content_bytes", "content_kb", "tree_kb", "total_kb")


# decode
for _name, _pct in (("0", 0.0), ("1_27", 1.27), ("20", 20.0), ("50", 50.0), ("100", 100.0), ("over_100", 250.0)):
    register(f"codec_roundtrip_{_name}", oracles.ARCS)(lambda s, d, p=_pct: g1(s, d).encode(p).decode().select("row_id", "nbr"))


@register("codec_roundtrip_1sym", oracles.ARCS)
def codec_roundtrip_1sym(s, d):
    g = g1(s, d)
    return g.encode(100.0 / g.n_vertices).decode().select("row_id", "nbr")


@register("codec_roundtrip_canonical", oracles.ARCS)
def codec_roundtrip_canonical(s, d):
    from arcspool.operators.encode import encode

    side = g1(s, d).side()
    return encode(side, PCT, book=codebook.build(side, PCT, driver_symbols=0, hot=100)).decode().select("row_id", "nbr")


@register("codec_roundtrip_vertex_side", oracles.ARCS_BACK)
def codec_roundtrip_vertex_side(s, d):
    return g1(s, d).encode(PCT, side="vertex").decode().select("row_id", "nbr")


@register("doc_token_roundtrip", oracles.doc_token_roundtrip())
def doc_token_roundtrip(s, d):
    return g2(s, d).encode(1.27).decode().select("row_id", "nbr")


@register("decode_range", oracles.ARCS + " where l_orderkey between 1024 and 3071")
def decode_range(s, d):
    return g1(s, d).encode(PCT, block_size=512).decode(blocks=(2, 6)).select("row_id", "nbr")


@register("decode_point", oracles.ARCS + " where l_orderkey in (0, 5, 1000, 1499)")
def decode_point(s, d):
    return g1(s, d).encode(PCT).decode(rows=[0, 5, 1000, 1499]).select("row_id", "nbr")


@register("decode_order", oracles.decode_order(PCT))
def decode_order(s, d):
    return g1(s, d).encode(PCT).decode()


@register("sum_check", oracles.SUM_CHECK)
def codec_sum_check(s, d):
    g = g1(s, d)
    return sum_check(g.encode(PCT).decode(), g.side(positions=False).arcs)


@register("codec_parquet_roundtrip", oracles.ARCS)
def codec_parquet_roundtrip(s, d):
    """The encoded form written as Parquet, read again by itself, and decoded."""
    import uuid

    from arcspool.operators.encode import Encoded

    path = f"{shared_dir(s)}/encoded/{uuid.uuid4().hex}"
    g1(s, d).encode(PCT).write(path)
    return Encoded.read(s, path).decode().select("row_id", "nbr")


@register("text_roundtrip", oracles.ARCS)
def text_roundtrip(s, d):
    """The hypergraph written in the text format and read again."""
    import uuid

    path = f"{shared_dir(s)}/text/{uuid.uuid4().hex}"
    write_adjacency_hypergraph(g1(s, d), path)
    return read_adjacency_hypergraph(s, path).side().arcs.select("row_id", "nbr")


# algorithms
for _src in range(5):
    register(f"bfs_src{_src}", oracles.bfs("G1", [_src]))(lambda s, d, k=_src: bfs(g1(s, d), [k]).select("id", "dist"))


@register("bfs_multi", oracles.bfs("G1", range(5), keep_src=True))
def bfs_multi(s, d):
    return bfs(g1(s, d), range(5))


@register("bfs_levels", oracles.bfs_levels("G1", 0))
def bfs_level_counts(s, d):
    return bfs_levels(bfs(g1(s, d), [0])).select("dist", "n_nodes")


@register("bfs_encoded_src0", oracles.bfs("G1", [0]))
def bfs_encoded_src0(s, d):
    return bfs(g1(s, d).encode(PCT), [0]).select("id", "dist")


@register("doc_token_bfs_src0", oracles.bfs("G2", [0]))
def doc_token_bfs_src0(s, d):
    return bfs(g2(s, d), [0]).select("id", "dist")


for _k in range(1, 6):
    register(f"kcore_k{_k}", oracles.kcore("G1", _k))(lambda s, d, k=_k: k_core(g1(s, d), k))


@register("kcore_size", oracles.kcore_size("G1", 3))
def kcore_size(s, d):
    return k_core(g1(s, d), 3).agg(F.sum(F.col("in_core").cast("long")).alias("remain"))


@register("kcore_encoded_k3", oracles.kcore("G1", 3))
def kcore_encoded_k3(s, d):
    return k_core(g1(s, d).encode(PCT), 3)


@register("doc_token_kcore_k3", oracles.kcore("G2", 3))
def doc_token_kcore_k3(s, d):
    return k_core(g2(s, d), 3)


@register("core_number", oracles.core_number("G1", 5))
def core_number(s, d):
    return core_numbers(g1(s, d), 5)


@register("pagerank_1", oracles.pagerank("G1", 1))
def pagerank_1(s, d):
    return rounded(pagerank(g1(s, d), 1))


@register("pagerank_20", oracles.pagerank("G1", 20))
def pagerank_20(s, d):
    return rounded(pagerank(g1(s, d)))


@register("pagerank_encoded_20", oracles.pagerank("G1", 20))
def pagerank_encoded_20(s, d):
    return rounded(pagerank(g1(s, d).encode(PCT)))


@register("doc_token_pagerank_20", oracles.pagerank("G2", 20))
def doc_token_pagerank_20(s, d):
    return rounded(pagerank(g2(s, d)))


@register("pagerank_mass", "select 1.0::double as mass")
def pagerank_mass(s, d):
    return pagerank(g1(s, d), 5).agg(F.round(F.sum("pr"), 9).alias("mass"))


@register("pagerank_dangling", oracles.pagerank_dangling("G1"))
def pagerank_dangling(s, d):
    _, nodes, n = g1(s, d).merged()
    return nodes.agg(F.round(F.sum(F.when(F.col("degree") == 0, 1.0 / n).otherwise(0.0)), ROUND).alias("dangling"))


# sizes over pct
@register("pct_sweep", oracles.pct_sweep("G1", SWEEP))
def pct_sweep(s, d):
    return codebook.sweep(g1(s, d).side(positions=False), SWEEP)


@register("pct_sweep_bits_hi", oracles.huffman_cost("G1", 5.0))
def pct_sweep_bits_hi(s, d):
    return codebook.sweep(g1(s, d).side(positions=False), [5.0]).select("bits_hi")


@register("best_allocation")
def best_allocation(s, d):
    return codebook.best_allocation(g2(s, d).side("hyperedge", positions=False), SWEEP)


@register("best_allocation_orders", oracles.best_allocation("G1", SWEEP))
def best_allocation_orders(s, d):
    return codebook.best_allocation(g1(s, d).side(positions=False), SWEEP)


# the bipartite graph
@register("bipartite_bfs", oracles.bipartite_bfs("G1", 0))
def bipartite_bfs(s, d):
    return bipartite.bipartite_bfs(g1(s, d), 0)


@register("bipartite_components", oracles.bipartite_components("G1"))
def bipartite_components(s, d):
    return bipartite.components(g1(s, d))


@register("bipartite_pagerank", oracles.bipartite_pagerank("G1", 5))
def bipartite_pagerank(s, d):
    return rounded(bipartite.bipartite_pagerank(g1(s, d), 5))


@register("bipartite_kcore", oracles.bipartite_kcore("G1", 29))
def bipartite_kcore(s, d):
    return bipartite.bipartite_k_core(g1(s, d), 29)
