"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte that a string of ``LENGTH`` bytes covers which also starts earlier
(in a document with a smaller id, or earlier in the same one) is removed;
strings are judged on the input.

Candidates. Each start of a 100-byte string picks its anchor: of the 32-byte
substrings inside, the one whose hash is smallest (leftmost of equals). Equal
strings pick equal anchors at equal offsets, so they meet under the anchor's
hash. One pass counts the anchors' hashes; a Bloom filter of bounded size holds
those that occur twice, and a second pass sends only their segments (the run of
starts that share an anchor, some 130 bytes). Segments equal to an earlier one of
the same batch stay at home: all their starts are repeats already.

Decision. The segments of an anchor are merge-sorted as suffixes. Prefix
polynomial hashes and a binary search give the common extension of two suffixes,
so a comparison takes a logarithmic number of steps; strings that come out equal
are verified byte by byte, and a group in which a hash deceived is grouped by its
bytes. Of equal strings the first in the order of documents and starts stays.

Skew. An anchor of more than ``HOT`` occurrences is sent as single strings under
the hash of the whole string: the strings across a passage's edges, which all
differ, spread over all tasks, and an inner string becomes about one row a task,
as a task remembers the strings that a batch held twice (up to ``HELD``, then
afresh) and knows each later one in precedence for a repeat. Such a key's rows are decided as a
stream by comparing bytes, so a key is never held whole.

Defined results: null text counts as empty; documents without an id come last;
rows with the same id and different texts are ordered by a hash of the text, and
rows repeated whole are one document whose result each of them gets; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.plans.sieve import Sieve
from arcspool.plans.stash import shuffle_partitions, small_batches, stash

LENGTH = 100
GRAM = 32
HOT = 4096
BLOCK = 1 << 19
ROWS = 12_000
HELD = 1 << 16
MAX_LOG_BITS = 30

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """base**i and base**-i modulo 2**64, as long as anyone has asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INV))
        return self.up, self.down


_POWERS = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with hash(x, l) = (P[x + l] - P[x]) * base**-x."""
    up, _ = _POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), whatever their place."""
    return _mix((prefix[end] - prefix[start]) * _POWERS.to(len(prefix))[1][start])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def anchors(data: np.ndarray, ends: list[int]):
    """Runs of starts that share an anchor: (first start, number, anchor, hash) arrays, and the prefix hashes.

    ``data``: documents one after another; ``ends``: where each ends. No string crosses an end.
    """
    n = len(data) - LENGTH + 1
    prefix = prefix_hashes(data)
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), prefix
    down = _POWERS.to(len(data) + 1)[1]
    h = _mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(data) - GRAM + 1])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(n + 1, bool)
    ok[n] = False
    for e in ends:
        ok[max(0, e - LENGTH + 1) : e] = False
    new = np.r_[True, at[1:] != at[:-1]] | np.r_[True, ~ok[: n - 1]]
    first = np.flatnonzero(new & ok[:n])
    stop = np.flatnonzero(np.r_[new, True] | ~ok)  # a run ends before the next of these
    count = stop[np.searchsorted(stop, first, "right")] - first
    return first, count, at[first], h[at[first]], prefix


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int]]]:
    """Texts joined into blocks of about BLOCK bytes: (data, ends, rows, shifts); a longer text comes in overlapping pieces."""
    parts, ends, rows, shifts, size = [], [], [], [], 0

    def made():
        return np.frombuffer(b"".join(parts), np.uint8), ends, rows, shifts

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for s in range(0, max(1, len(t) - LENGTH + 1), BLOCK):
            piece = t[s : s + BLOCK + LENGTH - 1]
            if size and size + len(piece) > BLOCK:
                yield made()
                parts, ends, rows, shifts, size = [], [], [], [], 0
            parts.append(piece)
            size += len(piece)
            ends.append(size)
            rows.append(i)
            shifts.append(s - (size - len(piece)))
    if parts:
        yield made()


def compare(data: np.ndarray, prefix: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 for the LENGTH-byte strings at ``x`` and ``y``: the common extension by binary search over hashes, then one byte."""
    down = _POWERS.to(len(prefix))[1]
    px, py, dx, dy = prefix[x], prefix[y], down[x], down[y]
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), LENGTH, np.int64)
    for _ in range(LENGTH.bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (prefix[x + mid] - px) * dx == (prefix[y + mid] - py) * dy
        lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(lo, mid - 1))
    at = np.minimum(lo, LENGTH - 1)
    sign = np.sign(data[x + at].astype(np.int16) - data[y + at].astype(np.int16))
    return np.where(lo >= LENGTH, 0, sign)


def suffix_mergesort(data: np.ndarray, prefix: np.ndarray, x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``x`` (sorted by ``group``) with each group stably merge-sorted by its LENGTH-byte strings, all groups level by level."""
    n = len(x)
    first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] if n else begin
    x, w = x.copy(), 1
    while n and w < size.max():
        e = np.flatnonzero(size > w)
        q = e - begin[e]
        base = begin[e] + q // (2 * w) * (2 * w)
        right = (q // w) % 2 == 1
        lo = np.where(right, base, np.minimum(base + w, begin[e] + size[e]))
        from_ = lo.copy()
        hi = np.where(right, base + w, np.minimum(base + 2 * w, begin[e] + size[e]))
        busy = np.flatnonzero(lo < hi)
        while len(busy):
            mid = (lo[busy] + hi[busy]) >> 1
            c = compare(data, prefix, x[mid], x[e[busy]])
            after = (c < 0) | ((c == 0) & right[busy])
            lo[busy], hi[busy] = np.where(after, mid + 1, lo[busy]), np.where(after, hi[busy], mid)
            busy = busy[lo[busy] < hi[busy]]
        out = x.copy()
        out[base + (q - np.where(right, w, 0)) % (2 * w) + (lo - from_)] = x[e]
        x, w = out, 2 * w
    return x


def repeats(segs: list[bytes], count: np.ndarray, offset: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each segment (in order of precedence, of an ascending ``group``) a mask over its starts: the string occurs earlier in the group.

    ``offset``: of the anchor from the first start. Strings at different offsets from their anchors aren't equal.
    """
    data = np.frombuffer(b"".join(segs), np.uint8)
    prefix = prefix_hashes(data)
    begin = np.r_[0, np.cumsum([len(s) for s in segs])[:-1]]
    row = np.repeat(np.arange(len(segs)), count)
    j = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    x, sub = begin[row] + j, group[row] * 256 + (j - offset[row] + 128)
    order = np.argsort(sub, kind="stable")
    sub = sub[order]
    edge = np.r_[True, sub[1:] != sub[:-1]]
    many = np.bincount(np.cumsum(edge) - 1)[np.cumsum(edge) - 1] > 1
    order, sub = order[many], sub[many]
    start_of = np.zeros(len(data) + 1, np.int64)
    start_of[x] = np.arange(len(x))
    done = suffix_mergesort(data, prefix, x[order], sub)
    mask = np.zeros(len(x), bool)
    if len(done):
        near = sub[1:] == sub[:-1]
        same = np.zeros(len(done), bool)
        at = np.flatnonzero(near) + 1
        same[at] = compare(data, prefix, done[at - 1], done[at]) == 0
        strings = np.ndarray((len(data) - LENGTH + 1,), f"S{LENGTH}", data, strides=(1,)).view(f"V{LENGTH}")
        at, false = np.flatnonzero(same), []
        for k in range(0, len(at), ROWS):
            a = at[k : k + ROWS]
            false.append(a[strings[done[a - 1]] != strings[done[a]]])
        mask[start_of[done[same]]] = True
        for g in np.unique(sub[np.concatenate(false)]) if false else ():  # hashes deceived: by the bytes themselves
            seen = set()
            for s in np.sort(start_of[done[sub == g]]):
                word = data[x[s] : x[s] + LENGTH].tobytes()
                mask[s] = word in seen
                seen.add(word)
    return np.split(mask, np.cumsum(count)[:-1])


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))


def _raw(column) -> list[bytes]:
    return [x.as_py() or b"" for x in column.cast(pa.binary())]


def _anchor_counts(src: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for data, ends, _, _ in _blocks(_raw(batch.column(0))):
                h, n = np.unique(anchors(data, ends)[3].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    return src.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def _segments(src: DataFrame, twice: Sieve, hot: Sieve) -> DataFrame:
    """Rows to be judged (seg) and ranges of bytes that are repeats already (seg null: n bytes from pos)."""
    held = src.sparkSession.sparkContext.broadcast((twice.words, twice.log_bits, hot.words, hot.log_bits))
    kind = dict(src.dtypes)["id"]

    def run(batches):
        v = held.value
        often, very = Sieve(v[0], v[1]), Sieve(v[2], v[3])
        task, rows_out = TaskContext.get().partitionId(), 0
        known: dict = {}  # single strings that came twice, with the first in precedence of those sent

        def note(s: bytes, place: tuple) -> None:
            if len(known) >= HELD and s not in known:
                known.clear()
            known[s] = place

        for batch in batches:
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = _raw(batch.column(2))
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, ths[i]))
            seen: dict = {}

            def place(i: int, p: int, ids=ids, ths=ths) -> tuple:
                return ids[i] is None, ids[i] if ids[i] is not None else 0, ths[i], p

            key, row, pos, num, off, seg = [], [], [], [], [], []
            for data, ends, rows, shifts in _blocks([texts[i] for i in order]):
                first, count, at, h, prefix = anchors(data, ends)
                pick = often.test(h.view(np.int64))
                first, count, at, h = first[pick], count[pick], at[pick], h[pick]
                doc = np.searchsorted(ends, first, "right")
                wide = very.test(h.view(np.int64))
                alone = np.zeros(len(first), bool)
                if wide.any():  # single strings under their own hash
                    reps = np.repeat(np.flatnonzero(wide), count[wide])
                    s = np.concatenate([np.arange(a, a + c) for a, c in zip(first[wide].tolist(), count[wide].tolist(), strict=True)])
                    down = _POWERS.to(len(prefix))[1]
                    hs = _mix((prefix[s + LENGTH] - prefix[s]) * down[s] + np.uint64(1))
                    one = np.ones(len(s), np.int64)
                    first, count, at, h, doc = (np.r_[a[~wide], b] for a, b in ((first, s), (count, one), (at, s), (h, hs), (doc, doc[reps])))
                    back = np.argsort(first, kind="stable")
                    alone = np.r_[np.zeros(len(first) - len(s), bool), one > 0]
                    first, count, at, h, doc, alone = (a[back] for a in (first, count, at, h, doc, alone))
                raw = data.tobytes()
                for f, c, a, k, d, single in zip(first.tolist(), count.tolist(), (at - first).tolist(), h.view(np.int64).tolist(), doc.tolist(), alone.tolist(), strict=True):
                    s = raw[f : f + c + LENGTH - 1]
                    i, p = order[rows[d]], f + shifts[d]
                    was = seen.setdefault((a, s), (i, p))
                    new = was == (i, p)
                    if not new and was[1] == p and ths[was[0]] == ths[i] and ids[was[0]] == ids[i]:
                        continue  # the same row again
                    if single and new and s in known:
                        here = place(i, p)
                        if here == known[s]:
                            continue
                        new = here < known[s]
                        if new:
                            note(s, here)
                    elif single and not new and s not in known:
                        note(s, place(*was))
                    if new:
                        key.append(k)
                        seg.append(s)
                    else:
                        c += LENGTH - 1
                        if seg and seg[-1] is None and row[-1] == i and pos[-1] + num[-1] >= p:
                            num[-1] = max(num[-1], p + c - pos[-1])
                            continue
                        key.append(_spread(ths[i], task, rows_out + len(key)))  # needn't meet anything
                        seg.append(None)
                    row.append(i)
                    pos.append(p)
                    num.append(c)
                    off.append(-1 - a if single else a)
            rows_out += len(key)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int64()), pa.array(num, pa.int32()), pa.array(off, pa.int32()), pa.array(seg, pa.binary())],
                names=["key", "id", "th", "pos", "n", "off", "seg"])

    return src.mapInArrow(run, f"key long, id {kind}, th long, pos long, n int, off int, seg binary")


def _spread(th: int, task: int, n: int) -> int:
    """A key for row ``n`` of a task, so that the ranges of a text's copies don't share one."""
    x = ((th ^ (task << 32) ^ n) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    return x - 2**64 if x >> 63 else x


def _judge(batches):
    """Rows sorted by key and precedence to ranges (id, th, s, e) of repeated bytes."""

    def solve(t: pa.Table, known: tuple) -> tuple[pa.RecordBatch, tuple]:
        """``known``: the key that the rows before ended in, and its strings; the same is returned for the last key here."""
        keys = t.column("key").to_numpy()
        pos, num, off = (t.column(c).to_pylist() for c in ("pos", "n", "off"))
        ids, ths, segs = (t.column(c).to_pylist() for c in ("id", "th", "seg"))
        row, s, e, lone, group, g = [], [], [], [], [], 0
        last, seen = known
        for i, k in enumerate(keys.tolist()):
            if segs[i] is None:
                row.append(i)
                s.append(pos[i])
                e.append(pos[i] + num[i])
                continue
            if k != last:
                seen, last, g = {}, k, g + 1
            here = (pos[i], ths[i], ids[i])
            was = seen.setdefault((off[i], segs[i]), here)
            if was is here:
                lone.append(i)
                group.append(g)
            elif was != here:
                row.append(i)
                s.append(pos[i])
                e.append(pos[i] + num[i] + LENGTH - 1)
        group = np.array(group, np.int64)
        many = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else group
        if len(many):
            pick = [lone[k] for k in many.tolist()]
            found = repeats([segs[i] for i in pick], np.array([num[i] for i in pick]), np.array([off[i] if off[i] >= 0 else -1 - off[i] for i in pick]), group[many])
            for i, mask in zip(pick, found, strict=True):
                for a, b in _runs(mask):
                    row.append(i)
                    s.append(pos[i] + a)
                    e.append(pos[i] + b + LENGTH - 1)
        at = pa.array(row, pa.int64())
        return pa.RecordBatch.from_arrays([t.column("id").combine_chunks().take(at), t.column("th").combine_chunks().take(at), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["id", "th", "s", "e"]), (last, seen)

    held, size, known = [], 0, (None, {})
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if not cut and max((o for o, x in zip(t.column("off").to_pylist(), t.column("seg").is_valid().to_pylist(), strict=True) if x), default=-1) < 0:
            cut = size  # single strings of one key: what was seen of them is all that the rows to come need
        if cut:
            made, known = solve(t.slice(0, cut), known)
            yield made
            held, size = t.slice(cut).to_batches(), size - cut
    if size:
        yield solve(pa.Table.from_batches(held).combine_chunks(), known)[0]


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, th, spans): ranges of bytes to remove, for each document that has any; ``th`` is the text's xxhash64."""
    spark = df.sparkSession
    small_batches(spark)
    src = _source(df, id_col, text_col)
    twice = stash(_anchor_counts(src), "anchors")
    many, rows = twice.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(MAX_LOG_BITS, max(16, math.ceil(math.log2(16 * max(1, many)))))
    sieve, very = Sieve.build(twice, "h", bits), Sieve.build(twice.where(F.col("n") > hot), "h", 20)
    parts = max(shuffle_partitions(spark), rows // 200_000)
    found = _segments(src, sieve, very).repartition(parts, "key").sortWithinPartitions("key", F.col("id").isNull(), "id", "th", "pos")
    ranges = found.mapInArrow(_judge, f"id {dict(src.dtypes)['id']}, th long, s long, e long")
    spans = ranges.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    return stash(spans, "spans")


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept) for every row: merged ranges of removed bytes (array of start, stop) and the bytes that stay.

    Only texts of documents that may have spans are shuffled, to meet them; a Bloom filter tells.
    """
    spans = repeated_spans(df, id_col, text_col, hot)
    src = _source(df, id_col, text_col)
    kind = dict(src.dtypes)["id"]
    has = Sieve.build(spans, "th", 24)
    held = src.sparkSession.sparkContext.broadcast((has.words, has.log_bits))
    schema = f"id {kind}, n_bytes long, spans array<array<long>>, kept binary"
    pair = pa.list_(pa.list_(pa.int64()))

    def split(dirty: bool):
        def run(batches):
            sieve = Sieve(*held.value)
            for batch in batches:
                yield batch.filter(pa.array(sieve.test(batch.column(1).to_numpy()) == dirty))

        return run

    def whole(batches):
        for batch in batches:
            raw = _raw(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([[]] * len(raw), pair), pa.array(raw, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    def cut(batches):
        for batch in batches:
            raw, gone = _raw(batch.column(1)), []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                spans = _merged([(x["s"], x["e"]) for x in spans or []])
                gone.append(spans)
                edges = [0, *(y for x in spans for y in x), len(raw[k])]
                raw[k] = (len(raw[k]), b"".join(raw[k][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in raw], pa.int64()), pa.array(gone, pair), pa.array([x[1] for x in raw], pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    columns = f"id {kind}, th long, text string"
    clean = src.mapInArrow(split(False), columns).mapInArrow(whole, schema)
    other = spans.select(F.col("id").alias("sid"), F.col("th").alias("sth"), "spans")
    dirty = src.mapInArrow(split(True), columns)
    met = dirty.join(other, dirty["id"].eqNullSafe(other["sid"]) & (dirty["th"] == other["sth"]), "left").select("id", "text", "spans")
    return clean.unionByName(met.mapInArrow(cut, schema))


def digest(made: DataFrame) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats``."""
    return made.select("id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
