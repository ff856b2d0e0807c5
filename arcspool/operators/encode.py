"""The hybrid code: Huffman codes for frequent neighbours, fixed width for the others, in self-contained blocks of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcspool.functions import bits
from arcspool.operators.codebook import Codebook, build
from arcspool.operators.model import SEGMENT, Side
from arcspool.plans.rank import salted
from arcspool.plans.stash import shuffle_partitions, small_batches, stash

#: A block's arcs beyond so many go to further segments of it, whether its rows are long or many.
BLOCK_ARCS = 1 << 20

#: ``first_pos``: of each row, the place of its first neighbour in the segment.
BLOCKS = "block_id long, segment long, hi binary, lo binary, row_ids array<long>, first_pos array<long>, degrees array<long>, huff_counts array<long>, bit_counts array<long>, bits_hi long, bits_lo long"


def split_arcs(side: Side, book: Codebook) -> DataFrame:
    """(row_id, pos, nbr, code, len): arcs with their code, null where the neighbour isn't in the codebook."""
    table, arcs = book.table.select("symbol", "code", "len"), side.arcs
    if book.codes is not None:  # of a checked size
        table = F.broadcast(table)
        return arcs.join(table, arcs["nbr"] == table["symbol"], "left").drop("symbol")
    # the most frequent symbols are hot keys: they are met by a broadcast of a fixed size, and then spread
    hot = F.broadcast(book.table.where(F.col("no") < book.hot).select("symbol", "code", "len"))
    met = arcs.join(hot, arcs["nbr"] == hot["symbol"], "left").withColumn("key", F.when(F.col("code").isNull(), F.col("nbr")).otherwise(salted("row_id", "pos")))
    cold = book.table.where(F.col("no") >= book.hot).select(F.col("symbol").alias("key"), F.col("code").alias("code2"), F.col("len").alias("len2"))
    return met.join(cold, "key", "left").select("row_id", "pos", "nbr", F.coalesce("code", "code2").alias("code"), F.coalesce("len", "len2").alias("len"))


def _encode_block(width: int):
    def one(key, rows: pa.Table) -> pa.RecordBatch:
        row, nbr = rows.column("row_id").to_numpy(), rows.column("nbr").to_numpy()
        length = rows.column("len").fill_null(0).to_numpy().astype(np.int64)
        value = np.array([int(c, 2) if c else 0 for c in rows.column("code").to_pylist()], object if len(length) and length.max() > 62 else np.int64)
        high = length > 0
        if length.max(initial=0) > 62:
            text = "".join(c for c in rows.column("code").to_pylist() if c)
            hi, n_hi = np.packbits(np.frombuffer(text.encode(), np.uint8) - 48, bitorder="little").tobytes(), len(text)
        else:
            hi, n_hi = bits.put(value[high], length[high])
        lo, n_lo = bits.put(nbr[~high], np.full(int((~high).sum()), width, np.int64))
        ids, first = np.unique(row, return_index=True)
        edge = np.r_[first, len(row)]
        return pa.RecordBatch.from_pylist([{
            "block_id": key[0], "segment": key[1], "hi": hi, "lo": lo, "row_ids": ids.tolist(), "first_pos": rows.column("pos").to_numpy()[first].tolist(), "degrees": np.diff(edge).tolist(),
            "huff_counts": np.add.reduceat(high.astype(np.int64), first).tolist(), "bit_counts": np.add.reduceat(length, first).tolist(), "bits_hi": n_hi, "bits_lo": n_lo}])

    def run(batches):
        held, key = [], None
        for batch in batches:
            while batch.num_rows:
                k = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
                if held and k != key:
                    yield one(key, pa.Table.from_batches(held).combine_chunks())
                    held = []
                same = (batch.column(0).to_numpy() == k[0]) & (batch.column(1).to_numpy() == k[1])
                n = len(same) if same.all() else int(np.argmin(same))
                held.append(batch.slice(0, n))
                batch, key = batch.slice(n), k
        if held:
            yield one(key, pa.Table.from_batches(held).combine_chunks())

    return run


@dataclass
class Encoded:
    """The encoded side: ``blocks``, the codebook, and the counts that decoding and the algorithms need."""

    blocks: DataFrame
    book: Codebook
    side: Side
    block_size: int
    _decoded: DataFrame | None = field(default=None, repr=False)
    _nodes: DataFrame | None = field(default=None, repr=False)

    def of(self, df: DataFrame, row_id: str) -> DataFrame:
        """``df`` joined with the arcs (row_id, nbr) of its rows, within 0 to n-1; other rows aren't decoded."""
        from arcspool.operators.decode import decode_of

        df = df.withColumnRenamed(row_id, "row_id")
        found = decode_of(self, df.select("row_id")).where(F.col("nbr").between(0, self.side.n - 1))
        return found.select("row_id", "nbr").join(df, "row_id")

    def decode(self, rows: list[int] | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
        from arcspool.operators.decode import decode

        return decode(self, rows, blocks)

    def merged(self) -> tuple[DataFrame, DataFrame, int]:
        """As of a Hypergraph, from the decoded blocks: decoded once, then reused."""
        if self._decoded is None:
            self._decoded = stash(self.decode().select("row_id", F.lit(0).cast("long").alias("pos"), "nbr"), "decoded")
        return self._decoded, self.side.nodes, self.side.n

    def write(self, path: str) -> None:
        """Blocks, ordered by number, the codebook and the parameters as Parquet below ``path``."""
        spark, b = self.blocks.sparkSession, self.book
        params = [(self.side.n, self.side.n_symbols, self.side.name, self.block_size, b.k, float(b.pct), b.fallback_bits, b.max_sym, b.codes is None, b.hot)]
        spark.createDataFrame(params, PARAMS).write.parquet(f"{path}/params")
        self.blocks.repartitionByRange("block_id", "segment").sortWithinPartitions("block_id", "segment").write.parquet(f"{path}/blocks")
        self.book.table.write.parquet(f"{path}/codebook")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Encoded:
        """What ``write`` has written below ``path``: all that decoding and the algorithms need."""
        p = spark.read.parquet(f"{path}/params").first()
        blocks, table = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/codebook")
        codes = spans = None
        if p.canonical:
            spans = [tuple(r) for r in table.groupBy("len").agg(F.min(F.conv("code", 2, 10).cast("long")), F.count("*")).orderBy("len").collect()]
        else:  # of the size that was checked when it was built
            codes = [tuple(r) for r in table.select("symbol", "code").collect()]
        each = blocks.select(F.explode(F.arrays_zip("row_ids", "degrees")).alias("e")).groupBy(F.col("e.row_ids").alias("id")).agg(F.sum("e.degrees").alias("degree"))
        nodes = spark.range(p.n).select("id").join(each, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
        side = Side(None, nodes, p.n, None, p.n_symbols, p.name)
        return cls(blocks, Codebook(table, p.k, p.pct, p.fallback_bits, p.max_sym, codes, spans, p.hot), side, p.block_size)

    def entries(self) -> DataFrame:
        """(row_id, degree, huff_count, bit_count) of every row."""
        each = self.blocks.select(F.explode(F.arrays_zip("row_ids", "degrees", "huff_counts", "bit_counts")).alias("e")).select("e.*")
        each = each.groupBy(F.col("row_ids").alias("id")).agg(*[F.sum(c).cast("long").alias(n) for c, n in (("degrees", "d"), ("huff_counts", "huff_count"), ("bit_counts", "bit_count"))])
        nodes = self.side.nodes
        return nodes.join(each, "id", "left").select(F.col("id").alias("row_id"), "degree", F.coalesce("huff_count", F.lit(0)).alias("huff_count"), F.coalesce("bit_count", F.lit(0)).alias("bit_count"))

    def index(self) -> DataFrame:
        """(block_id, hi_start_bit, lo_start_bit) of every block: the bits ahead of it in streams that run through all blocks."""
        spark = self.blocks.sparkSession
        own = self.blocks.groupBy("block_id").agg(F.sum("bits_hi").alias("h"), F.sum("bits_lo").alias("l"))
        every = spark.range(-(-self.side.n // self.block_size)).select(F.col("id").alias("block_id")).join(own, "block_id", "left")
        # two levels: thousands of blocks make a cell, and only the cells' sums meet in one window
        cell = F.expr("block_id div 4096")
        cells = every.groupBy(cell.alias("cell")).agg(F.sum("h").alias("h"), F.sum("l").alias("l"))
        over = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select("cell", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}0") for c in "hl"])
        inner = Window.partitionBy("cell").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
        out = every.withColumn("cell", cell).select("cell", "block_id", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(c) for c in "hl"]).join(cells, "cell")
        return out.select("block_id", (F.col("h") + F.col("h0")).cast("long").alias("hi_start_bit"), (F.col("l") + F.col("l0")).cast("long").alias("lo_start_bit"))

    def stats(self) -> DataFrame:
        """One row: k, fallback_bits, bits_hi, bits_lo, max_degree, max_bit_count, tree_bytes, content_bytes and the KB report."""
        e = self.entries().agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.max("bit_count"), F.lit(0)).alias("max_bit_count"))
        b = self.blocks.agg(F.coalesce(F.sum("bits_hi"), F.lit(0)).alias("bits_hi"), F.coalesce(F.sum("bits_lo"), F.lit(0)).alias("bits_lo"))
        k, one = self.book.k, F.lit(1)
        t = e.withColumn("_k", one).join(b.withColumn("_k", one), "_k").drop("_k")
        wide = lambda c: F.when(F.col(c) < 65536, 2).otherwise(4)
        content = F.lit(self.side.n) * (wide("max_degree") + wide("max_bit_count")) + F.ceil(F.col("bits_hi") / 8) + F.ceil(F.col("bits_lo") / 8)
        t = t.select(F.lit(k).cast("long").alias("k"), F.lit(self.book.fallback_bits).alias("fallback_bits"), "bits_hi", "bits_lo", "max_degree", "max_bit_count",
                     F.lit((2 * k - 1) * 24 if k else 0).cast("long").alias("tree_bytes"), content.cast("long").alias("content_bytes"))
        kb = lambda c: F.floor(c / 1024).cast("long")
        return t.select("*", kb(F.col("content_bytes")).alias("content_kb"), kb(F.col("tree_bytes")).alias("tree_kb"), kb(F.col("content_bytes") + F.col("tree_bytes")).alias("total_kb"))


PARAMS = "n long, n_symbols long, name string, block_size long, k long, pct double, fallback_bits int, max_sym long, canonical boolean, hot long"


def _segments(side: Side, keyed: DataFrame, block_size: int) -> DataFrame:
    """``keyed`` with the number of the segment of its block: of an arc's place among all of the block's arcs."""
    own = F.col("pos")
    rows = side.nodes.withColumn("block_id", F.expr(f"id div {int(block_size)}"))
    dense = rows.groupBy("block_id").agg(F.sum("degree").alias("arcs")).where(F.col("arcs") > BLOCK_ARCS)
    if not dense.isEmpty():  # elsewhere every arc is in the first segment
        over = Window.partitionBy("block_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        ahead = rows.join(dense, "block_id", "left_semi").select(F.col("id").alias("row_id"), F.coalesce(F.sum("degree").over(over), F.lit(0)).alias("ahead"))
        hubs = ahead.join(side.nodes.where(F.col("degree") > SEGMENT).select(F.col("id").alias("row_id")), "row_id", "left_semi")
        other = ahead.join(hubs, "row_id", "left_anti").withColumn("salt", F.lit(0))
        # a hub's row is met from as many salts as it has parts
        spread = hubs.join(side.nodes.withColumnRenamed("id", "row_id"), "row_id").select("row_id", "ahead", F.explode(F.expr(f"sequence(0, cast(degree div {SEGMENT} as int))")).alias("salt"))
        keyed = keyed.withColumn("salt", F.expr(f"cast(pos div {SEGMENT} as int)")).join(other.unionByName(spread), ["row_id", "salt"], "left").drop("salt")
        own = F.coalesce("ahead", F.lit(0)) + F.col("pos")
    return keyed.withColumn("segment", F.floor(own / F.lit(BLOCK_ARCS)).cast("long")).drop("ahead")


def encode(side: Side, pct: float, block_size: int = 1024, book: Codebook | None = None) -> Encoded:
    """Encode a side with the codebook of its top ``pct`` percent of symbols (or a given one)."""
    spark = side.arcs.sparkSession
    book = book or build(side, pct)
    keyed = split_arcs(side, book).withColumn("block_id", F.expr(f"row_id div {int(block_size)}"))
    keyed = _segments(side, keyed, block_size).select("block_id", "segment", "row_id", "pos", "nbr", "code", "len")
    small_batches(spark)
    dealt = keyed.repartition(shuffle_partitions(spark), "block_id", "segment").sortWithinPartitions("block_id", "segment", "row_id", "pos")
    return Encoded(stash(dealt.mapInArrow(_encode_block(book.fallback_bits), BLOCKS), "blocks"), book, side, block_size)
