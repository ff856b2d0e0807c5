"""SimHash near-dedup over BK-trees.

Fingerprint: XXH64 (seed 42) of each 3-word shingle; a bit is 1 if it is set in
over half of them. Equal fingerprints are merged first, so copies never meet in
pairs. Two fingerprints that differ in at most ``radius`` of 64 bits agree on one
of ``radius + 1`` blocks of bits; each block value is a shard, and a shard's
fingerprints form a BK-tree: children hang on their parent by their Hamming
distance to it, and a query follows only edges within the radius of its own
distance. Shard trees are sent to the tasks that hold their queries by a shuffle
on the shard key rather than by one broadcast, since all trees together grow with
the data. A shard of more than ``shard_rows`` fingerprints is split by the same
argument over the bits outside its block, down to two further levels, so one
common block value doesn't make one long task.

A shard sends on one edge from each linked fingerprint to its local root, not all
pairs; connected components of these edges give the classes.

Defined results: null text counts as empty, and a text without words has
fingerprint zero, linked like any other; rows with a null id take part, but ids
of classes come from ids that are not null (null only if a class has none);
repeated rows get a result row each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.llm.exprs import free_name
from arcspool.operators.components import connected_components
from arcspool.plans.stash import shuffle_partitions, small_batches, stash

SEED = 42
SHINGLE = 3
RADIUS = 2
SHARD_ROWS = 4096
_FEW = 1 << 16


def simhash(raw: bytes, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text; A-Z are lower-cased."""
    ws = raw.lower().split()
    if not ws:
        return 0
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(ws) - k + 1)
    hashed = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), n
    last = ends[k - 1 :].tolist() if len(ws) >= k else [len(line)]
    for at in range(0, n, _FEW):  # bounded memory for very long texts
        h = np.array([hashed(line[a:b], SEED) for a, b in zip(starts[at : at + _FEW], last[at : at + _FEW], strict=False)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


class BKForest:
    """BK-trees over many shards at once; nodes are array positions, edges sorted (parent, distance) slots."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        """``shard``: dense shard numbers; ``fps``: uint64, distinct within a shard."""
        self.fps, n = fps, len(fps)
        self.root = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        slots, kids = [], []
        rest, where = np.arange(n), shard.astype(np.int64)  # where: shard, later the slot below which a fingerprint falls
        top = True
        while len(rest):
            order = np.argsort(where, kind="stable")
            rest, where = rest[order], where[order]
            first = np.r_[True, where[1:] != where[:-1]]
            node = rest[first]
            if top:
                self.root[where[first]] = node
            else:
                slots.append(where[first])
                kids.append(node)
            parent = np.repeat(node, np.diff(np.r_[np.flatnonzero(first), len(rest)]))
            rest, parent = rest[~first], parent[~first]
            where, top = parent * 65 + np.bitwise_count(fps[rest] ^ fps[parent]).astype(np.int64), False
        slots, kids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, kids))
        order = np.argsort(slots)
        self.slots, self.kids = slots[order], kids[order]

    def near(self, queries: np.ndarray, shard: np.ndarray, radius: int):
        """Yield (query positions, node positions) within ``radius``, level by level, in bounded batches."""
        for at in range(0, len(queries), _FEW):
            work = [(np.arange(at, min(at + _FEW, len(queries))), self.root[shard[at : at + _FEW]])]
            while work:
                q, node = work.pop()
                if len(q) > 4 * _FEW:
                    work += [(q[i : i + 4 * _FEW], node[i : i + 4 * _FEW]) for i in range(0, len(q), 4 * _FEW)]
                    continue
                d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                nq, nn = [], []
                for e in range(-radius, radius + 1):
                    slot = node * 65 + (d + e)
                    ok = (d + e > 0) & (d + e < 65)
                    at_slot = np.minimum(np.searchsorted(self.slots, slot), max(0, len(self.slots) - 1))
                    if len(self.slots):
                        ok &= self.slots[at_slot] == slot
                        nq.append(q[ok])
                        nn.append(self.kids[at_slot[ok]])
                if nq and sum(map(len, nq)):
                    work.append((np.concatenate(nq), np.concatenate(nn)))


def _roots(n: int, pairs) -> np.ndarray:
    """The smallest linked position of each of ``n`` positions, through any chain of ``pairs``."""
    up = np.arange(n)
    held = []
    for a, b in pairs:
        keep = a != b
        if keep.any():
            held.append((a[keep], b[keep]))
    changed = True
    while changed:
        before = up.copy()
        for a, b in held:
            low = np.minimum(up[a], up[b])
            np.minimum.at(up, a, low)
            np.minimum.at(up, b, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        changed = not np.array_equal(before, up)
    return up


def _shard_edges(radius: int):
    """Batches of (key, fp) sorted by key to edges (a, b) of each shard; a shard may go over several batches."""

    def solve(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        first = np.r_[True, key[1:] != key[:-1]]
        shard = np.cumsum(first) - 1
        many = np.bincount(shard)[shard] > 1
        fps, shard = fps[many].view(np.uint64), np.unique(shard[many], return_inverse=True)[1]
        a = b = np.zeros(0, np.int64)
        if len(fps):
            tree = BKForest(shard, fps)
            up = _roots(len(fps), tree.near(fps, shard, radius))
            linked = np.flatnonzero(up != np.arange(len(fps)))
            a, b = fps[linked].view(np.int64), fps[up[linked]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        keys, fps, size = [], [], 0
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            keys.append(k)
            fps.append(f)
            size += len(k)
            if size >= _FEW and k[-1] != keys[0][0]:
                k, f = np.concatenate(keys), np.concatenate(fps)
                cut = np.searchsorted(k, k[-1])  # the last shard may go on
                if cut:
                    yield solve(k[:cut], f[:cut])
                keys, fps, size = [k[cut:]], [f[cut:]], len(k) - cut
        if size:
            yield solve(np.concatenate(keys), np.concatenate(fps))

    return run


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(offset, bits) of ``parts`` blocks that cover ``width`` bits."""
    edge = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _sharded(fps: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(key, fp): each fingerprint once for each block of bits; crowded block values are refined by blocks of the bits outside."""
    parts = radius + 1

    def keyed(bits: str, width: int, tag: str, prefix: str) -> str:
        each = ", ".join(f"xxhash64({prefix}'{tag}{i}', shiftright({bits}, {o}) & {(1 << w) - 1}L)" for i, (o, w) in enumerate(_blocks(width, parts)))
        return f"array({each})"

    def without(bits: str, width: int, i: int) -> str:
        o, w = _blocks(width, parts)[i]
        return f"(({bits} & {(1 << o) - 1}L) | shiftleft(shiftright({bits}, {o + w}) & {(1 << (width - o - w)) - 1 if o + w < width else 0}L, {o}))"

    def level(df: DataFrame, width: int, tag: str, prefix: str) -> DataFrame:
        """(fp, key, bits): a key for each block, and the bits outside that block."""
        rest = "array(" + ", ".join(without("bits", width, i) for i in range(parts)) + ")"
        each = df.selectExpr("fp", f"explode(arrays_zip({keyed('bits', width, tag, prefix)}, {rest})) as x")
        return each.selectExpr("fp", "x['0'] as key", "x['1'] as bits")

    out, now, width = None, level(fps.selectExpr("fp", "fp as bits"), 64, "a", ""), 64
    for tag in "bc":
        width -= min(w for _, w in _blocks(width, parts))
        hot = now.groupBy("key").count().where(F.col("count") > shard_rows).select("key")
        marked = now.join(hot.withColumn("hot", F.lit(True)), "key", "left")
        calm = marked.where("hot is null").select("key", "fp")
        out = calm if out is None else out.unionByName(calm)
        busy = marked.where("hot").select("fp", "bits", F.col("key").alias("up"))
        now = level(busy, width, tag, "up, ")
    return out.unionByName(now.select("key", "fp"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's bits as a signed long. With ``hashed`` also th, a hash of the raw text."""
    src = df.select(F.col(id_col).alias("id"), *[F.xxhash64(text_col).alias("th")] * hashed, F.col(text_col).cast("string").alias("text"))
    names = [c for c in src.columns if c != "text"]
    kinds = dict(src.dtypes)

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(x.as_py() or b"") for x in batch.column(len(names)).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fp.view(np.int64))], names=[*names, "fp"])

    return src.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "fp long"]))


def link_classes(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, comp) of the distinct long fingerprints ``fps.fp`` that link to another; comp names the class."""
    spark = fps.sparkSession
    keyed = _sharded(fps, radius, shard_rows)
    parts = max(shuffle_partitions(spark), 8)
    edges = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_shard_edges(radius), "a long, b long")
    return connected_components(edges).select(F.col("node").alias("fp"), "comp")


def near_dups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row: its fingerprint and the smallest id that links reach, itself included."""
    small_batches(df.sparkSession)
    rows = stash(fingerprints(df, id_col, text_col), "simhash")
    nodes = stash(rows.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    comp = stash(link_classes(nodes.select("fp"), radius), "comp")
    named = nodes.join(comp, "fp")
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    classes = nodes.join(named.join(lows, "comp").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    classes = stash(classes, "classes")  # written, so that the join below may split a fingerprint that many rows share
    return rows.join(classes, "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` that stay, with its columns: of each class the one of the smallest id (null only if the class has no other), of rows with one id that of one text; rows repeated whole stay together."""
    small_batches(df.sparkSession)
    rows = stash(fingerprints(df, id_col, text_col, hashed=True), "simhash")
    nodes = stash(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("low")), "nodes")
    named = nodes.join(stash(link_classes(nodes.select("fp"), radius), "comp"), "fp", "left")
    th, kid, kth = (free_name(df.columns, x) for x in ("row_th", "keep_id", "keep_th"))
    # a class goes by its smallest fingerprint, as classes may have equal ids; a text is in one class only
    first = named.groupBy(F.coalesce("comp", "fp").alias("comp")).agg(F.min("low").alias("low"))
    stay = stash(first.select(F.col("low.id").alias(kid), F.col("low.th").alias(kth)), "stay")
    hit = df.withColumn(th, F.xxhash64(text_col))
    return hit.join(stay, hit[id_col].eqNullSafe(stay[kid]) & (hit[th] == stay[kth]), "left_semi").drop(th)
