"""Packing of bit streams: bit i of a stream is bit i % 8, from the low end, of byte i // 8."""

from __future__ import annotations

import numpy as np


def put(values: np.ndarray, widths: np.ndarray) -> tuple[bytes, int]:
    """Each value in its width, highest bit first, one after another; the bytes and the number of bits."""
    total = int(widths.sum()) if len(widths) else 0
    if not total:
        return b"", 0
    left = np.repeat(np.cumsum(widths), widths) - 1 - np.arange(total)
    bits = (np.repeat(values, widths) >> left) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), total


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n, bitorder="little") if n else np.zeros(0, np.uint8)


def window(data: bytes, start: int, n: int) -> np.ndarray:
    """The ``n`` bits from bit ``start`` on; only their bytes are looked at."""
    if not n:
        return np.zeros(0, np.uint8)
    first = start >> 3
    part = np.frombuffer(data, np.uint8, count=((start + n + 7) >> 3) - first, offset=first)
    return np.unpackbits(part, bitorder="little")[start & 7 : (start & 7) + n]


def fixed(bits: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits each, highest bit first."""
    return bits.reshape(-1, width).astype(np.int64) @ (np.int64(1) << np.arange(width - 1, -1, -1, dtype=np.int64))


class PrefixDecoder:
    """Decodes a stream of prefix codes: a table by the next 12 bits, the rest by a dictionary of (length, value)."""

    PEEK = 12

    def __init__(self, codes: list[str]):
        size = 1 << self.PEEK
        self.entry = np.full(size, -1, np.int64)
        self.length = np.zeros(size, np.int64)
        self.long: dict[str, int] = {}
        self.most = max(map(len, codes), default=0)
        for k, c in enumerate(codes):
            if len(c) <= self.PEEK:
                free = self.PEEK - len(c)
                at = int(c, 2) << free
                self.entry[at : at + (1 << free)], self.length[at : at + (1 << free)] = k, len(c)
            else:
                self.long[c] = k

    def read(self, bits: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` symbols' numbers."""
        out = np.zeros(n, np.int64)
        if not n:
            return out
        padded = np.r_[bits, np.zeros(self.PEEK, np.uint8)].astype(np.int64)
        word = np.zeros(len(bits), np.int64)
        for i in range(self.PEEK):
            word = word * 2 + padded[i : i + len(bits)]
        entry, length = self.entry[word].tolist(), self.length[word].tolist()
        at, text = 0, None
        for i in range(n):
            k, size = entry[at], length[at]
            if k < 0:
                text = text or "".join(map(str, bits.tolist()))
                size = self.PEEK + 1
                while (k := self.long.get(text[at : at + size], -1)) < 0:
                    size += 1
                    if size > self.most:
                        raise ValueError("the stream isn't in this code")
            out[i] = k
            at += size
        return out


class CanonicalDecoder:
    """Decodes a stream of canonical codes to numbers that count up with (length, code)."""

    AT_ONCE = 1 << 20

    def __init__(self, spans: list[tuple[int, int, int]]):
        """``spans``: (length, first code, number of codes) by rising length; lengths up to 62."""
        self.length, self.first, n = np.array(spans or [(1, 0, 0)], np.int64).T
        self.most, self.base = int(self.length[-1]), np.cumsum(n) - n
        self.stop = (self.first + n) << (self.most - self.length)

    def read(self, bits: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` symbols' numbers."""
        out, have, start = np.zeros(n, np.int64), 0, 0
        while have < n:
            part = bits[start : start + self.AT_ONCE + self.most]
            size = min(len(part), self.AT_ONCE)
            padded = np.r_[part, np.zeros(self.most, np.uint8)].astype(np.int64)
            word = np.zeros(size, np.int64)
            for i in range(self.most):
                word = word * 2 + padded[i : i + size]
            k = np.searchsorted(self.stop, word, "right")
            if size == 0 or k.min() >= len(self.length):
                raise ValueError("the stream isn't in this code")
            k = np.minimum(k, len(self.length) - 1)  # only where no symbol starts
            step, at, found = self.length[k].tolist(), 0, []
            while at < size and have + len(found) < n:
                found.append(at)
                at += step[at]
            found = np.array(found, np.int64)
            kk = k[found]
            out[have : have + len(found)] = self.base[kk] + (word[found] >> (self.most - self.length[kk])) - self.first[kk]
            have, start = have + len(found), start + at
        return out
