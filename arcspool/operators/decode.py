"""Decoding of blocks: all, a range, or the rows asked for; a row's Huffman symbols come first, then the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.functions import bits
from arcspool.plans.rank import salted
from arcspool.plans.stash import small_batches


def _decoder(reader, symbols: np.ndarray, width: int, some: bool):
    """Blocks to (row_id, pos, nbr, no): ``no`` is the number of a symbol beyond ``symbols``, whose neighbour is null.

    With ``some``, only the rows of the column ``wanted`` are read, each from its
    own first bit; the bytes of other rows aren't looked at.
    """

    def run(batches):
        table = reader()
        for batch in batches:
            for b in batch.to_pylist():
                ids, deg, huff, first = (np.array(b[c], np.int64) for c in ("row_ids", "degrees", "huff_counts", "first_pos"))
                if some:
                    size, low = np.array(b["bit_counts"], np.int64), (deg - huff) * width
                    rows = np.flatnonzero(np.isin(ids, b["wanted"]))
                    starts = [(np.cumsum(x) - x)[rows].tolist() for x in (size, low)]
                    high, low = (np.concatenate([np.zeros(0, np.uint8), *(bits.window(b[c], s, n) for s, n in zip(at, x[rows].tolist(), strict=True))]) for c, at, x in zip(("hi", "lo"), starts, (size, low), strict=True))
                    ids, deg, huff, first = ids[rows], deg[rows], huff[rows], first[rows]
                else:
                    high, low = bits.unpack(b["hi"], b["bits_hi"]), bits.unpack(b["lo"], b["bits_lo"])
                number, low = table.read(high, int(huff.sum())), bits.fixed(low, width)
                row = np.repeat(np.arange(len(deg)), deg)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(deg) - deg, deg)
                coded = pos < np.repeat(huff, deg)
                no = np.full(len(row), -1, np.int64)
                no[coded] = number
                nbr = np.zeros(len(row), np.int64)
                nbr[~coded] = low
                known = coded & (no < len(symbols))
                nbr[known] = symbols[no[known]]
                later = coded & ~known
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(pos + first[row]), pa.array(nbr, mask=later), pa.array(no, mask=~later)], names=["row_id", "pos", "nbr", "no"])

    return run


def _decoded(encoded, frame: DataFrame, some: bool) -> DataFrame:
    book = encoded.book
    small_batches(frame.sparkSession)
    if book.codes is not None:
        codes, reader = [c for _, c in book.codes], bits.PrefixDecoder
        symbols = np.array([s for s, _ in book.codes], np.int64)
        make = lambda: reader(codes)
    else:
        spans, reader = book.spans, bits.CanonicalDecoder
        symbols = np.array([r[0] for r in book.table.where(F.col("no") < book.hot).orderBy("no").select("symbol").collect()], np.int64)
        make = lambda: reader(spans)
    out = frame.mapInArrow(_decoder(make, symbols, book.fallback_bits, some), "row_id long, pos long, nbr long, no long")
    if book.codes is not None or book.k <= book.hot:
        return out.select("row_id", "pos", "nbr")
    # rows that have their neighbour get keys that meet nothing, spread over all tasks
    cold = book.table.where(F.col("no") >= book.hot).select(F.col("no").alias("key"), "symbol")
    met = out.withColumn("key", F.coalesce("no", salted("row_id", "pos"))).join(cold, "key", "left")
    return met.select("row_id", "pos", F.coalesce("nbr", "symbol").alias("nbr"))


def decode(encoded, rows: list[int] | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(row_id, pos, nbr), pos being the place in the decoded row. ``blocks`` = (first, end) and ``rows`` prune the scan to their blocks."""
    frame = encoded.blocks
    if blocks is not None:
        frame = frame.where(F.col("block_id").between(blocks[0], blocks[1] - 1))
    if rows is None:
        return _decoded(encoded, frame, False)
    wanted = sorted({int(r) for r in rows})
    frame = frame.where(F.col("block_id").isin(sorted({r // encoded.block_size for r in wanted})))
    return _decoded(encoded, frame.withColumn("wanted", F.array(*[F.lit(r).cast("long") for r in wanted]).cast("array<long>")), True)


def decode_of(encoded, ids: DataFrame) -> DataFrame:
    """As ``decode`` of the rows whose numbers are in the first column of ``ids``: only their blocks are taken, and in them only their bits."""
    row = F.col(ids.columns[0])
    wanted = ids.select(row.alias("row")).distinct().groupBy(F.expr(f"row div {int(encoded.block_size)}").alias("block_id")).agg(F.collect_list("row").alias("wanted"))
    return _decoded(encoded, encoded.blocks.join(wanted, "block_id"), True)


def sum_check(decoded: DataFrame, original: DataFrame) -> DataFrame:
    """One row: decoded_sum, original_sum and their difference; 0 where decoding has lost nothing."""
    d = decoded.agg(F.coalesce(F.sum("nbr"), F.lit(0)).alias("decoded_sum")).withColumn("_k", F.lit(1))
    o = original.agg(F.coalesce(F.sum("nbr"), F.lit(0)).alias("original_sum")).withColumn("_k", F.lit(1))
    return d.join(o, "_k").select("decoded_sum", "original_sum", (F.col("decoded_sum") - F.col("original_sum")).alias("diff"))
