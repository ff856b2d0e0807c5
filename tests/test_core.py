"""Fixture T, invariants and edge cases of the hypergraph engine."""

import pytest
from pyspark.sql import functions as F

from arcspool.functions import bits
from arcspool.functions.huffman import canonical, length_runs, tree_codes
from arcspool.operators import bipartite, codebook
from arcspool.operators.bfs import bfs
from arcspool.operators.components import connected_components
from arcspool.operators.encode import encode
from arcspool.operators.iterate import KeptArcs
from arcspool.operators.kcore import core_numbers, k_core
from arcspool.operators.model import Hypergraph
from arcspool.operators.pagerank import pagerank
from arcspool.plans.rank import rank_within
from arcspool.plans.sieve import Sieve
from arcspool.sources.text_format import read_adjacency_hypergraph, write_adjacency_hypergraph

T = """AdjacencyHypergraph
5
11
6
11
0 4 6 9 10
0 1 2 3 0 3 0 1 3 2 4
0 3 5 7 10 11
0 1 2 0 2 0 3 1 2 0 4
"""


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("t") / "t.hyp"
    path.write_text(T)
    return read_adjacency_hypergraph(spark, f"file://{path}")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def lists(df):
    out = {}
    for r, _, n in rows(df, "row_id", "pos", "nbr"):
        out.setdefault(r, []).append(n)
    return out


def test_text_format(spark, t, tmp_path):
    assert (t.n_vertices, t.n_edges, t.choose()) == (5, 6, "hyperedge")
    assert lists(t.side().arcs) == {0: [0, 1, 2], 1: [0, 2], 2: [0, 3], 3: [1, 2, 0], 4: [4]}
    assert rows(t.side("vertex").nodes, "id", "degree") == [(0, 4), (1, 2), (2, 3), (3, 1), (4, 1)]
    write_adjacency_hypergraph(t, f"file://{tmp_path}/out")
    again = read_adjacency_hypergraph(spark, f"file://{tmp_path}/out")
    assert lists(again.side().arcs) == lists(t.side().arcs) and again.n_edges == 6
    bad = tmp_path / "bad.hyp"
    bad.write_text("Other 1 1 1 1")
    with pytest.raises(ValueError):
        read_adjacency_hypergraph(spark, f"file://{bad}")
    with pytest.raises(Exception, match="(?i)not.*exist|PATH"):
        read_adjacency_hypergraph(spark, f"file://{tmp_path}/missing")


@pytest.mark.parametrize(("pct", "k", "fb", "hi", "lo"), [(40, 2, 3, 7, 12), (60, 3, 3, 14, 6), (100, 5, 1, 24, 0), (0, 0, 3, 0, 33)])
def test_sizes(t, pct, k, fb, hi, lo):
    s = t.encode(pct).stats().first()
    assert (s.k, s.fallback_bits, s.bits_hi, s.bits_lo) == (k, fb, hi, lo)
    assert s.tree_bytes == ((2 * k - 1) * 24 if k else 0) and s.content_bytes == 6 * 4 + -(-hi // 8) + -(-lo // 8)
    assert rows(codebook.sweep(t.side(), [pct]), "k", "fallback_bits", "bits_hi", "bits_lo") == [(k, fb, hi, lo)]


def test_bytes_and_order(t):
    e = t.encode(40)
    assert dict(e.book.codes) == {2: "0", 0: "1"}
    b = e.blocks.collect()
    assert [(r.hi.hex(), r.lo.hex()) for r in b] == [("55", "3403")]
    assert lists(e.decode()) == {0: [0, 2, 1], 1: [0, 2], 2: [0, 3], 3: [2, 0, 1], 4: [4]}
    assert rows(e.entries(), "row_id", "degree", "huff_count", "bit_count") == [(0, 3, 2, 2), (1, 2, 2, 2), (2, 2, 1, 1), (3, 3, 2, 2), (4, 1, 0, 0), (5, 0, 0, 0)]
    assert rows(t.encode(40, block_size=4).index(), "block_id", "hi_start_bit", "lo_start_bit") == [(0, 0, 0), (1, 7, 9)]
    assert lists(e.decode(rows=[3, 5])) == {3: [2, 0, 1]}
    assert dict(t.encode(60).book.codes) == {0: "0", 1: "10", 2: "11"}


@pytest.mark.parametrize("pct", [0, 20, 40, 100, 250, -5])
def test_roundtrip(t, pct):
    want = rows(t.side().arcs, "row_id", "nbr")
    for side in (t.side(),):
        assert rows(encode(side, pct, 4).decode(), "row_id", "nbr") == want
        assert rows(encode(side, pct, 4, codebook.build(side, pct, driver_symbols=-1)).decode(), "row_id", "nbr") == want
    assert rows(t.encode(pct, side="vertex").decode(), "nbr", "row_id") == want


def test_bfs(t):
    assert rows(bfs(t, [0, 3, 4]), "src", "id", "dist") == sorted([(0, 0, 0), (0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, None), (0, 5, None), (3, 3, 0), (3, 0, 1), (3, 1, 1), (3, 2, 1), (3, 4, None), (3, 5, None), (4, 4, 0), *[(4, i, None) for i in (0, 1, 2, 3, 5)]], key=lambda r: (r[0], r[1]))
    assert rows(bfs(t.encode(100), [0], inf=536870911), "id", "dist")[4:] == [(4, 536870911), (5, 536870911)]
    with pytest.raises(ValueError):
        bfs(t, [6])


def test_kcore(t):
    masks = {1: [1, 1, 1, 1, 1, 0], 2: [1, 1, 1, 1, 0, 0], 3: [0] * 6, 4: [0] * 6}
    for k, m in masks.items():
        assert rows(k_core(t, k), "id", "in_core") == [(i, bool(x)) for i, x in enumerate(m)]
    assert rows(core_numbers(t, 5), "id", "core") == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 1), (5, 0)]
    assert rows(k_core(t.encode(0), 2), "id", "in_core") == [(i, bool(x)) for i, x in enumerate(masks[2])]


def test_pagerank(t):
    want = {1: [.284722222, .143055556, .213888889, .119444444, .190277778, .048611111], 20: [.29993382, .147705175, .210479874, .11858016, .194174757, .029126214]}
    for n, w in want.items():
        got = [r[1] for r in rows(pagerank(t, n), "id", "pr")]
        assert got == pytest.approx(w, abs=1e-9) and sum(got) == pytest.approx(1, abs=1e-9)
    assert [r[1] for r in rows(pagerank(t.encode(40)), "id", "pr")] == pytest.approx(want[20], abs=1e-9)


def graph(spark, arcs, ne=None, nv=None):
    df = spark.createDataFrame(arcs, "e long, v long")
    return Hypergraph.from_incidence(df, "e", "v", spark.range(ne) if ne is not None else None, spark.range(nv) if nv is not None else None)


def test_edge_cases(spark):
    empty = graph(spark, [])
    assert (empty.n_edges, empty.n_vertices) == (0, 0) and empty.encode(20).decode().count() == 0
    for f in (pagerank, lambda g: bfs(g, [0]), lambda g: k_core(g, 1)):
        with pytest.raises(ValueError):
            f(empty)
    more = graph(spark, [(0, 0), (0, 0), (0, 3), (1, 2)], nv=5)
    assert more.choose() == "vertex" and rows(more.side().arcs, "row_id", "nbr") == [(0, 0), (0, 0), (2, 1), (3, 0)]
    out = graph(spark, [(0, 1), (0, 9), (1, 0)], ne=3, nv=2)
    mass = pagerank(out, 1).agg(F.sum("pr")).first()[0]
    assert mass == pytest.approx(1 - 0.85 / 6)  # the share of the arc that leads out is lost
    assert rows(bfs(out, [0]), "id", "dist") == [(0, 0), (1, 1), (2, None)]
    one = graph(spark, [(0, 0), (1, 0), (2, 0)])
    e = one.encode(100)
    assert e.book.codes == [(0, "0")] and e.stats().first().bits_hi == 3 and rows(e.decode(), "row_id", "nbr") == [(0, 0), (1, 0), (2, 0)]


def test_wide_row(spark):
    wide = graph(spark, [(0, i % 50) for i in range(70_000)] + [(i, i % 50) for i in range(1, 60)])
    e = wide.encode(50)
    assert rows(e.entries().where("row_id = 0"), "degree")[0] == (70_000,)
    assert e.decode().groupBy("row_id", "nbr").count().exceptAll(wide.side().arcs.groupBy("row_id", "nbr").count()).isEmpty()
    assert e.stats().first().content_bytes > 59 * 6  # four-byte degrees


def test_hub_parts(spark):
    g = graph(spark, [(0, i % 40) for i in range(500)] + [(i, 0) for i in range(1, 41)])
    arcs, nodes, n = g.merged()
    kept = KeptArcs(arcs, nodes, n, segment=16)
    met = kept.of(nodes.select("id"), "id")
    assert kept.table.select("part").distinct().count() > 5 and met.count() == 540
    assert rows(met, "row_id", "nbr") == rows(arcs, "row_id", "nbr")


def test_huffman():
    assert tree_codes([]) == [] and tree_codes([0]) == ["0"]
    for freqs in ([9, 5, 5, 3, 1, 1, 1, 0, 0], [1] * 13, [2**i for i in range(20, 0, -1)], [0, 0, 0]):
        codes = tree_codes(freqs)
        assert sum(2.0 ** -len(c) for c in codes) == 1
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)
        runs = length_runs([(f, freqs.count(f)) for f in set(freqs)])
        assert sum(f * d * n for f, d, n in runs) == sum(f * len(c) for f, c in zip(freqs, codes, strict=True))
        assert sum(n for _, _, n in runs) == len(freqs) and sum(n * 2.0**-d for _, d, n in runs) == 1
        made = [format(first + i, f"0{d}b") for _, d, first, n in canonical(runs) for i in range(n)]
        assert len(set(made)) == len(freqs) and not any(a != b and b.startswith(a) for a in made for b in made)


def test_long_codes():
    codes = tree_codes([2**i for i in range(40, 0, -1)])
    import numpy as np

    order = [5, 39, 38, 0, 0, 20, 39]
    stream = np.array([int(b) for k in order for b in codes[k]], np.uint8)
    assert bits.PrefixDecoder(codes).read(stream, len(order)).tolist() == order


def test_bits():
    import numpy as np

    data, n = bits.put(np.array([1, 0, 3, 1000]), np.array([1, 3, 2, 10]))
    assert n == 16 and "".join(map(str, bits.unpack(data, n))) == "1" + "000" + "11" + "1111101000"
    assert bits.put(np.array([], int), np.array([], int)) == (b"", 0)
    assert bits.fixed(bits.unpack(data, 16)[6:], 10).tolist() == [1000]


def test_rank_within(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(6)
    got = rank_within(df, ["k"], [F.col("v").desc()], "r").collect()
    for k in range(3):
        mine = sorted((r.r, -r.v) for r in got if r.k == k)
        assert [r for r, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    assert sorted(r.r for r in rank_within(df, [], [F.col("v")], "r").collect()) == list(range(500))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 5), (None, 3)] + [(300, 300 + i) for i in range(1, 60)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "comp"))
    assert got == {**{i: 0 for i in [*range(41), 200]}, 100: 100, 101: 100, **{i: 300 for i in range(300, 360)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sieve(spark):
    import numpy as np

    keys = np.arange(-5000, 5000, 3, dtype=np.int64) * 7919
    s = Sieve.build(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 18)
    assert s.test(keys).all() and s.test(keys + 1).mean() < 0.01
    assert not Sieve.build(spark.createDataFrame([(None,)], "k long"), "k", 10).test(keys).any()


def test_bipartite(t):
    assert rows(bipartite.bipartite_bfs(t, 0), "id", "dist") == [(0, 0), (1, 1), (2, 1), (3, 1), (4, None)]
    assert rows(bipartite.components(t).where("kind = 'vertex'"), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]
    assert rows(bipartite.components(t).where("kind = 'hyperedge'").fillna(-1), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, -1)]
    assert sum(r[1] for r in rows(bipartite.bipartite_pagerank(t), "id", "pr")) == pytest.approx(1, abs=1e-9)
    assert rows(bipartite.bipartite_k_core(t, 2), "id", "in_core") == [(0, True), (1, True), (2, True), (3, False), (4, False)]


def test_bipartite_hubs_and_repeats(spark, monkeypatch):
    """Hubs over many parts, repeated incidences and empty domains against plain Python."""
    import random

    from arcspool.operators import bipartite as B
    from arcspool.operators.iterate import KeptArcs

    monkeypatch.setattr(B, "KeptArcs", lambda arcs, nodes, n: KeptArcs(arcs, nodes, n, segment=8))
    rnd = random.Random(6)
    inc = [(rnd.randrange(12), rnd.randrange(60)) for _ in range(90)] + [(11, v) for v in range(0, 30)] + [(11, 5)] * 3 + [(e, 7) for e in range(12)]
    inc = [(e, v) for e, v in inc if v % 10 != 9]  # vertices without hyperedges
    h = Hypergraph.from_incidence(spark.createDataFrame(inc, "e long, v long"), "e", "v", vertices=spark.range(60).toDF("id"))
    dist, front = {3: 0}, {3}
    while front:
        front = {w for e, v in inc if v in front for f, w in inc if f == e} - set(dist)
        dist |= dict.fromkeys(front, max(dist.values()) + 1)
    assert rows(B.bipartite_bfs(h, 3), "id", "dist") == [(v, dist.get(v)) for v in range(60)]
    pr = [1 / 60] * 60
    deg, size = [sum(v == w for _, w in inc) for v in range(60)], [sum(e == f for f, _ in inc) for e in range(12)]
    for _ in range(3):
        at, idle, nxt = [0.0] * 12, sum(p for p, d in zip(pr, deg, strict=True) if not d), [0.0] * 60
        for e, v in inc:
            at[e] += pr[v] / deg[v] / size[e]
        for e, v in inc:
            nxt[v] += at[e]
        pr = [0.15 / 60 + 0.85 * (x + idle / 60) for x in nxt]
    assert [p for _, p in rows(B.bipartite_pagerank(h, 3), "id", "pr")] == pytest.approx(pr, abs=1e-12)


def test_bipartite_kcore_and_its_sql(spark):
    """The operator and its SQL against plain Python, at cores that are whole, partial and empty."""
    from collections import Counter

    import duckdb

    from arcspool import oracles, queries

    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    inc = set(con.execute("select l_orderkey, l_partkey from lineitem").fetchall())
    for k in (10, 25, 28, 35, 60):
        a, b = None, inc
        while a != b:
            a = b
            size = Counter(e for e, _ in a)
            b = {x for x in a if size[x[0]] > 1}
            degree = Counter(v for _, v in b)
            b = {x for x in b if degree[x[1]] >= k}
        want = {v for _, v in a}
        assert {r[0] for r in con.execute(oracles.bipartite_kcore("G1", k)).fetchall() if r[1]} == want
        if k in (25, 28):
            assert {r.id for r in bipartite.bipartite_k_core(queries.g1(spark, "/root/testdata/sf0.001"), k).collect() if r.in_core} == want


def test_text_format_over_many_splits(spark, tmp_path):
    import random

    rnd = random.Random(4)
    edges = [[rnd.randrange(300) for _ in range(rnd.randrange(6))] for _ in range(700)]
    back = [[] for _ in range(300)]
    for e, vs in enumerate(edges):
        for v in vs:
            back[v].append(e)

    def side(ls):
        offs, at = [], 0
        for x in ls:
            offs.append(at)
            at += len(x)
        return [str(o) for o in offs] + [str(v) for x in ls for v in x]

    m = sum(map(len, edges))
    tokens = ["AdjacencyHypergraph", "300", str(m), "700", str(m), *side(back), *side(edges)]
    text, k = "", 0
    while k < len(tokens):
        n = rnd.randrange(1, 9)
        text += rnd.choice(["", "  ", "\n"]) + " ".join(tokens[k : k + n]) + rnd.choice(["\n", "\n\n", " \n"])
        k += n
    (tmp_path / "big.hyp").write_text(text)
    key = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(key)
    spark.conf.set(key, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        g = read_adjacency_hypergraph(spark, f"file://{tmp_path}/big.hyp")
    finally:
        spark.conf.set(key, kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert lists(g.side().arcs) == {e: vs for e, vs in enumerate(edges) if vs}


def random_graph(spark, edges=60, vertices=40, arcs=900, seed=4, **more):
    import random

    rnd = random.Random(seed)
    data = [(min(int(rnd.expovariate(0.12)), edges - 1), min(int(rnd.expovariate(0.2)), vertices - 1)) for _ in range(arcs)]
    e, v = (spark.range(n).select("id") for n in (edges, vertices))
    return data, Hypergraph.from_incidence(spark.createDataFrame(data, "edge long, vertex long"), "edge", "vertex", e, v, **more)


def test_dense_blocks_are_cut(spark, monkeypatch):
    """Rows that are many, not long, fill several segments; every form of decoding puts them together again."""
    from arcspool.operators import encode as E

    data, g = random_graph(spark)
    want = [(r, n) for r, n in sorted(data)]
    for segment in (1 << 16, 8):  # with and without hubs of several parts
        monkeypatch.setattr(E, "BLOCK_ARCS", 64)
        monkeypatch.setattr(E, "SEGMENT", segment)
        e = encode(g.side(), 30.0, block_size=16)
        sizes = [sum(r.degrees) for r in e.blocks.collect()]
        assert max(sizes) <= 64 and len(sizes) > 900 / 64 and sum(sizes) == 900
        assert rows(e.decode(), "row_id", "nbr") == want
        back = lists(e.decode())
        assert {r: sorted(n) for r, n in back.items()} == {r: sorted(n for q, n in data if q == r) for r, _ in data}
        pos = {}
        for r in e.decode().collect():
            pos.setdefault(r.row_id, []).append(r.pos)
        assert all(sorted(p) == list(range(len(p))) for p in pos.values())
        assert rows(e.decode(rows=[0, 3, 17]), "row_id", "nbr") == [x for x in want if x[0] in (0, 3, 17)]
        assert rows(e.entries(), "row_id", "degree") == [(i, sum(r == i for r, _ in data)) for i in range(60)]


@pytest.mark.parametrize("hot", [0, 3, 1 << 17])
def test_canonical_codes_by_number(spark, hot):
    data, g = random_graph(spark)
    side = g.side()
    for pct in (10.0, 60.0, 100.0):
        e = encode(side, pct, block_size=16, book=codebook.build(side, pct, driver_symbols=0, hot=hot))
        assert rows(e.decode(), "row_id", "nbr") == sorted(data)
        assert rows(e.decode(rows=[1, 2, 59]), "row_id", "nbr") == sorted(x for x in data if x[0] in (1, 2, 59))
        table = e.book.table.orderBy("no").collect()
        assert [r.no for r in table] == list(range(len(table))) and [(r.len, r.code) for r in table] == sorted((r.len, r.code) for r in table)


def test_canonical_decoder_over_many_pieces(monkeypatch):
    import random

    import numpy as np

    rnd = random.Random(1)
    spans = [(1, 0, 1), (3, 4, 2), (5, 24, 8)]
    codes = [format(first + i, f"0{n}b") for n, first, count in spans for i in range(count)]
    want = [rnd.randrange(len(codes)) for _ in range(2000)]
    stream = np.array([int(b) for k in want for b in codes[k]], np.uint8)
    for size in (7, 64, 1 << 20):
        monkeypatch.setattr(bits.CanonicalDecoder, "AT_ONCE", size)
        assert bits.CanonicalDecoder(spans).read(stream, 2000).tolist() == want
    packed = np.packbits(stream, bitorder="little").tobytes()
    assert bits.window(packed, 13, 50).tolist() == stream[13:63].tolist() and not len(bits.window(packed, 9, 0))


def test_only_the_frontier_is_decoded(spark):
    """Blocks without a row that is asked for may hold anything; and of other rows in a block no bit is read."""
    data = [(0, 1), (1, 20), (20, 21), (21, 20), (40, 41), (41, 59), (59, 40)]
    e = Hypergraph.from_incidence(spark.createDataFrame(data, "edge long, vertex long"), "edge", "vertex", spark.range(60).select("id"), spark.range(60).select("id")).encode(10.0, block_size=8)
    want = rows(bfs(e, [0]), "id", "dist")
    assert [d for i, d in want if i in (0, 1, 20, 21, 40)] == [0, 1, 2, 3, None]
    spoilt = F.col("block_id") >= 5
    e.blocks = e.blocks.withColumns({c: F.when(spoilt, F.lit(None)).otherwise(F.col(c)) for c in ("hi", "lo", "degrees")})
    assert rows(bfs(e, [0]), "id", "dist") == want
    assert rows(e.of(spark.createDataFrame([(1, "a"), (1, "b"), (20, "c")], "x long, y string"), "x"), "y", "nbr") == [("a", 20), ("b", 20), ("c", 21)]
    with pytest.raises(Exception):  # noqa: B017  whatever the decoder says
        bfs(e, [40]).collect()


@pytest.mark.parametrize("driver_symbols", [0, 1 << 17])
def test_encoded_form_is_read_by_itself(spark, tmp_path, driver_symbols):
    from arcspool.operators.encode import Encoded

    data, g = random_graph(spark)
    side = g.side()
    book = codebook.build(side, 30.0, driver_symbols=driver_symbols, hot=4)
    encode(side, 30.0, 16, book).write(f"file://{tmp_path}/e")
    e = Encoded.read(spark, f"file://{tmp_path}/e")
    assert rows(e.decode(), "row_id", "nbr") == sorted(data)
    assert rows(bfs(e, [0]), "id", "dist") == rows(bfs(g, [0]), "id", "dist")
    assert rows(k_core(e, 3), "id", "in_core") == rows(k_core(g, 3), "id", "in_core")
    assert [(i, round(p, 12)) for i, p in rows(pagerank(e, 4), "id", "pr")] == [(i, round(p, 12)) for i, p in rows(pagerank(g, 4), "id", "pr")]


def test_text_format_of_hubs(spark, tmp_path, monkeypatch):
    """Rows over several cells and lines keep their neighbours and places."""
    from arcspool.sources import text_format as X

    monkeypatch.setattr(X, "CELL", 16)
    monkeypatch.setattr(X, "LINE", 5)
    data, g = random_graph(spark)
    write_adjacency_hypergraph(g, f"file://{tmp_path}/out")
    again = read_adjacency_hypergraph(spark, f"file://{tmp_path}/out")
    assert lists(again.side().arcs) == lists(g.side().arcs)
    assert rows(again.side().nodes, "id", "degree") == rows(g.side().nodes, "id", "degree")


def test_text_format_over_many_files(spark, tmp_path):
    """The files of a folder are read in the order of their part numbers, whatever their sizes."""
    _, g = random_graph(spark)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        write_adjacency_hypergraph(g, f"file://{tmp_path}/out")
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "out").glob("part-*"))) > 2
    again = read_adjacency_hypergraph(spark, f"file://{tmp_path}/out")
    assert lists(again.side().arcs) == lists(g.side().arcs)
    assert rows(again.side("vertex").nodes, "id", "degree") == rows(g.side("vertex").nodes, "id", "degree")
    (tmp_path / "own").mkdir()
    for name, text in {"a": "AdjacencyHypergraph", "part-99999": "2 3", "part-100000": "2 3\n0 2\n" + "0\n1\n" + " " * 99, "part-100001": "1", "part-100002-x": "0 1 0\n0\n1"}.items():
        (tmp_path / "own" / name).write_text(text)
    assert lists(read_adjacency_hypergraph(spark, f"file://{tmp_path}/own").side().arcs) == {0: [0], 1: [0, 1]}


def test_null_ends_are_ignored(spark):
    df = spark.createDataFrame([(0, 1), (None, 1), (2, None), (2, 0), (None, None)], "edge long, vertex long")
    g = Hypergraph.from_incidence(df, "edge", "vertex")
    for positions in (True, False):
        s = Hypergraph.from_incidence(df, "edge", "vertex").side(positions=positions)
        assert rows(s.arcs, "row_id", "nbr") == [(0, 1), (2, 0)] and rows(s.nodes, "id", "degree") == [(0, 1), (1, 0), (2, 1)]
    assert rows(g.encode(50.0).decode(), "row_id", "nbr") == [(0, 1), (2, 0)]


def test_batches_of_levels_and_rounds(spark):
    from arcspool.operators.kcore import _Peel

    _, g = random_graph(spark, arcs=150)
    want = rows(bfs(g, [0, 5], batch=1), "src", "id", "dist")
    assert rows(bfs(g, [5, 0], batch=3), "src", "id", "dist") == want
    for k in (2, 4):
        assert rows(_Peel(g, batch=1).to(k), "id", "in_core") == rows(_Peel(g, batch=3).to(k), "id", "in_core")
