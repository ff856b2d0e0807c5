"""A Bloom filter of fixed size over 64-bit keys, built by an aggregate and broadcast.

It only spares rows a shuffle: whatever passes is still checked exactly, so a
filter that fills up costs traffic and never changes a result. Its size is a
parameter and doesn't grow with the data (2**24 bits: 2 MB).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MUL = (-7046029254386353131, -4417276706812531889)


def _mixed(keys: np.ndarray, mul: int) -> np.ndarray:
    x = keys.astype(np.int64).view(np.uint64) * np.uint64(mul & (2**64 - 1))
    x ^= x >> np.uint64(29)
    return x * np.uint64(_MUL[0] & (2**64 - 1))


class Sieve:
    """Membership of int64 keys with false positives; ``log_bits`` fixes the size."""

    def __init__(self, words: np.ndarray, log_bits: int):
        self.words, self.log_bits = words, log_bits

    @classmethod
    def build(cls, df: DataFrame, key: str, log_bits: int = 24) -> Sieve:
        """Set two bits for each non-null key of ``df``; each task sends at most one row a 64-bit word it has touched."""
        schema = "w int, b long"

        def bits(batches):
            import pyarrow as pa

            for batch in batches:
                keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.unique(np.concatenate([_mixed(keys, m) >> np.uint64(64 - log_bits) for m in _MUL])) if len(keys) else np.zeros(0, np.uint64)
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                one = np.uint64(1) << (at & np.uint64(63))
                value = np.bitwise_or.reduceat(one, first) if len(at) else one
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], names=["w", "b"])

        rows = df.select(F.col(key).cast("long")).mapInArrow(bits, schema).groupBy("w").agg(F.bit_or("b").alias("b"))
        words = np.zeros(1 << (log_bits - 6), np.int64)
        got = rows.toArrow()
        words[got.column("w").to_numpy()] = got.column("b").to_numpy()
        return cls(words.view(np.uint64), log_bits)

    def __contains__(self, key: int) -> bool:
        return bool(self.test(np.array([key], np.int64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for m in _MUL:
            at = _mixed(keys, m) >> np.uint64(64 - self.log_bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out
