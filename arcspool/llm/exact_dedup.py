"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its normalised bytes modulo two primes.
Parts of a text are hashed on their own and combined by shifting with the length
of what follows, ``H(ab) = H(a) * r**len(b) + H(b)``; a ``Part`` also says whether
it begins and ends in white space, so that parts cut anywhere combine to the
fingerprint of the whole. A document of more than ``HUGE`` bytes is cut in the JVM
into rows of ``PIECE`` bytes, which are hashed by different tasks and combined in
order; a Python worker never holds more of it than an Arrow batch of such rows.
Documents with equal fingerprints and lengths are then compared chunk by chunk:
for each chunk number of a fingerprint the smallest and the largest chunk are
equal only if all are. Min and max combine map-side, so a fingerprint that a third
of all documents share sends one row a chunk and task. Huge documents are
normalised as a stream for that and for their SHA-256.

Plan: one pass over the texts writes a small table of fingerprints; a Bloom
filter sized by the number of repeated ones holds those; a second pass sends only
texts that pass it. Where fingerprints collide (texts differ), the group is keyed
by the texts' SHA-256 too.

Defined results: null text counts as empty; rows with a null id are kept only if
the whole group has no id; of repeated rows (same id, equal text) one stays; an
empty table gives no rows. Other columns are ignored here, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.llm.exprs import free_name
from arcspool.plans.sieve import Sieve
from arcspool.plans.stash import drop, shuffle_partitions, small_batches, stash

#: Primes under 2**31 and bases of the two fingerprints: fixed values.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1640531527)
CHUNK = 4096
COMPARED = 1 << 16
#: Documents of more bytes are cut into rows of so many.
HUGE, PIECE = 1 << 22, 1 << 20
MAX_LOG_BITS = 30
_AT_ONCE = 256 * CHUNK

_WS = b" \t\n\x0b\f\r"


def _powers() -> np.ndarray:
    out = np.ones((2, CHUNK + 1), np.uint64)
    for k in range(2):
        for i in range(CHUNK):
            out[k, i + 1] = int(out[k, i]) * BASES[k] % PRIMES[k]
    return out


_POW = _powers()
_DESC = np.ascontiguousarray(_POW[:, CHUNK - 1 :: -1])  # r**(CHUNK-1) ... r**0


def normalised(raw: bytes) -> bytes:
    """``raw`` with each run of white space turned into one space."""
    body = b" ".join(raw.split())
    if not body:
        return b" " if raw else b""
    return (b" " if raw[0] in _WS else b"") + body + (b" " if raw[-1] in _WS else b"")


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """The fingerprint of a concatenation from those of its parts."""
    return tuple((left[k] * pow(BASES[k], right_len, PRIMES[k]) + right[k]) % PRIMES[k] for k in range(2))


def _plain(data: bytes) -> tuple[int, int]:
    """Both residues of up to ``_AT_ONCE`` bytes; whole chunks are hashed together."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    b += np.uint64(1)
    whole, h = len(b) // CHUNK, (0, 0)
    if whole:
        each = [(b[: whole * CHUNK].reshape(whole, CHUNK) @ _DESC[k]) % np.uint64(PRIMES[k]) for k in range(2)]
        for i in range(whole):
            h = tuple((h[k] * int(_POW[k, CHUNK]) + int(each[k][i])) % PRIMES[k] for k in range(2))
    rest = b[whole * CHUNK :]
    if len(rest):
        n = len(rest)
        tail = [int(rest @ _DESC[k, CHUNK - n :]) % PRIMES[k] for k in range(2)]
        h = tuple((h[k] * int(_POW[k, n]) + tail[k]) % PRIMES[k] for k in range(2))
    return h


def fingerprint(data: bytes) -> tuple[int, int]:
    """Both residues of ``data``."""
    h = _plain(data[:_AT_ONCE])
    for at in range(_AT_ONCE, len(data), _AT_ONCE):
        piece = data[at : at + _AT_ONCE]
        h = combine(h, _plain(piece), len(piece))
    return h


class Part(NamedTuple):
    """A stretch of a text: fingerprint and length of its normalised inside, and whether it begins and ends in white space."""

    h0: int = 0
    h1: int = 0
    n: int = 0
    lead: bool = False
    trail: bool = False

    @classmethod
    def of(cls, raw: bytes) -> Part:
        body = b" ".join(raw.split())
        return cls(*fingerprint(body), len(body), raw[:1].isspace(), raw[-1:].isspace())

    def __add__(self, other: Part) -> Part:
        """The part that both make, one after the other."""
        if not self.n:
            return other._replace(lead=self.lead or other.lead, trail=other.trail or (self.lead and not other.n))
        if not other.n:
            return self._replace(trail=self.trail or other.lead)
        h, gap = (self.h0, self.h1), self.trail or other.lead
        if gap:
            h = combine(h, _SPACE, 1)
        return Part(*combine(h, (other.h0, other.h1), other.n), self.n + gap + other.n, self.lead, other.trail)

    def whole(self) -> tuple[tuple[int, int], int]:
        """Fingerprint and length of the normalised text that the part is all of."""
        if not self.n:
            return (_SPACE, 1) if self.lead else ((0, 0), 0)
        h, n = (self.h0, self.h1), self.n
        if self.lead:
            h, n = combine(_SPACE, h, n), n + 1
        if self.trail:
            h, n = combine(h, _SPACE, 1), n + 1
        return h, n


_SPACE = fingerprint(b" ")


class Normaliser:
    """The normalised text as a stream: what each stretch adds to it."""

    def __init__(self):
        self.in_space = False

    def feed(self, raw: bytes) -> bytes:
        if not raw:
            return b""
        body, lead, trail = b" ".join(raw.split()), raw[:1].isspace(), raw[-1:].isspace()
        out = (b" " if lead and not self.in_space else b"") + body + (b" " if trail and body else b"")
        self.in_space = trail
        return out


def key_of(h: tuple[int, int]) -> int:
    return h[0] << 31 | h[1]


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def _pieces(df: DataFrame) -> DataFrame:
    """``df`` with its binary column ``text`` cut into rows: no, the last number, piece."""
    last = F.expr(f"cast(greatest(0L, octet_length(text) - 1L) div {PIECE} as int)")
    cut = F.expr(f"transform(sequence(0, last), i -> substring(text, i * {PIECE} + 1, {PIECE}))")
    rest = [c for c in df.columns if c != "text"]
    each = df.withColumn("last", last).select(*rest, "last", cut.alias("cut"))  # no row behind the explode holds the text
    return each.select(*rest, "last", F.posexplode("cut").alias("no", "piece"))


def _sha_of_pieces(batches):
    """Pieces in order to (rid, text_sha256), a document as a stream."""
    text, sha = Normaliser(), hashlib.sha256()
    for batch in batches:
        rid, out = [], []
        for r, no, last, piece in zip(*(batch.column(c).to_pylist() for c in ("rid", "no", "last", "piece")), strict=True):
            if no == 0:
                text, sha = Normaliser(), hashlib.sha256()
            sha.update(text.feed(piece))
            if no == last:
                rid.append(r)
                out.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(out, pa.string())], names=["rid", "text_sha256"])


def _hash_pieces(batches):
    for batch in batches:
        parts = [Part.of(x.as_py()) for x in batch.column("piece")]
        cols = [pa.array([p[k] for p in parts], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("no"), *cols], names=["rid", "no", *Part._fields])


def _combine_parts(batches):
    """Parts in order of (rid, no) to (rid, fp, n_bytes)."""

    def made(done):
        found = [(r, *p.whole()) for r, p in done]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([key_of(x[1]) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["rid", "fp", "n_bytes"])

    now, part = None, Part()
    for batch in batches:
        done = []
        rows = batch.to_pydict()
        for r, *p in zip(rows["rid"], *(rows[c] for c in Part._fields), strict=True):
            if r != now:
                if now is not None:
                    done.append((now, part))
                now, part = r, Part()
            part = part + Part(*p)
        yield made(done)
    if now is not None:
        yield made([(now, part)])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, th, fp, n_bytes, text_sha256) of every row; ``th`` hashes the raw text, ``rid`` numbers the rows."""
    text = F.col(text_col).cast("string")
    src = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), text.alias("text"))
    huge = F.coalesce(F.octet_length("text") > HUGE, F.lit(False))
    small = src.select("rid", "id", "th", huge.alias("huge"), F.when(~huge, F.col("text")).alias("text"))
    schema = f"rid long, id {dict(src.dtypes)['id']}, th long, fp long, n_bytes long, text_sha256 string"

    def run(batches):
        for batch in batches:
            fp, size, sha = [], [], []
            for raw, later in zip(_texts(batch.column(4)), batch.column(3).to_pylist(), strict=True):
                t = normalised(raw)
                fp.append(None if later else key_of(fingerprint(t)))
                size.append(len(t))
                sha.append(hashlib.sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(fp, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], names=["rid", "id", "th", "fp", "n_bytes", "text_sha256"])

    made = stash(small.mapInArrow(run, schema), "fp")
    made.has_huge = not made.where("fp is null").isEmpty()
    if not made.has_huge:
        return made
    cut = _pieces(src.where(huge).select((-1 - F.col("rid")).alias("rid"), "id", "th", F.col("text").cast("binary").alias("text")))
    cut = stash(cut.select("rid", "id", "th", "no", "last", "piece"), "pieces")  # numbered once
    parts = max(shuffle_partitions(df.sparkSession), 8)
    hashed = cut.select("rid", "no", "piece").repartition(parts, "rid", "no").mapInArrow(_hash_pieces, "rid long, no int, h0 long, h1 long, n long, lead boolean, trail boolean")
    whole = hashed.repartition(parts, "rid").sortWithinPartitions("rid", "no").mapInArrow(_combine_parts, "rid long, fp long, n_bytes long")
    sha = cut.select("rid", "no", "last", "piece").repartition(parts, "rid").sortWithinPartitions("rid", "no").mapInArrow(_sha_of_pieces, "rid long, text_sha256 string")
    more = cut.where("no = 0").select("rid", "id", "th").join(whole, "rid").join(sha, "rid").select("rid", "id", "th", "fp", "n_bytes", "text_sha256")
    out = stash(made.where("fp is not null").unionByName(more), "fp")
    drop(made, cut)
    out.has_huge = True
    return out


_CHUNKS = "fp long, n_bytes long, no long, chunk binary"


def _chunk_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["fp", "n_bytes", "no", "chunk"])


def _chunks_of_pieces(batches):
    """Pieces in order, with their document's key, to chunks of its normalised text."""
    text, held, at = Normaliser(), b"", 0
    for batch in batches:
        rows = []
        for fp, n, no, last, piece in zip(*(batch.column(c).to_pylist() for c in ("fp", "n_bytes", "no", "last", "piece")), strict=True):
            if no == 0:
                text, held, at = Normaliser(), b"", 0
            held += text.feed(piece)
            while len(held) >= COMPARED or (no == last and held):
                rows.append((fp, n, at, held[:COMPARED]))
                held, at = held[COMPARED:], at + 1
        yield _chunk_rows(rows)


def _collided(df: DataFrame, text_col: str, repeated: Sieve, table: DataFrame | None = None) -> DataFrame:
    """(fp, n_bytes) of fingerprints whose texts differ in some chunk; ``table``: the fingerprints, for huge documents."""
    held = df.sparkSession.sparkContext.broadcast((repeated.words, repeated.log_bits))
    text = F.col(text_col).cast("string")
    huge = F.coalesce(F.octet_length(text) > HUGE, F.lit(False))

    def run(batches):
        sieve = Sieve(*held.value)
        for batch in batches:
            rows, seen = [], {}
            for raw in _texts(batch.column(0)):
                t = normalised(raw)
                k = (key_of(fingerprint(t)), len(t))
                if k[0] in sieve and seen.get(k) != t:  # a copy of what this batch has sent adds nothing
                    seen.setdefault(k, t)
                    rows += [(*k, i, t[i * COMPARED : (i + 1) * COMPARED]) for i in range(max(1, -(-len(t) // COMPARED)))]
            yield _chunk_rows(rows)

    chunks = df.where(~huge).select(text.alias("text")).mapInArrow(run, _CHUNKS)
    if table is not None:
        again = table.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).where("n > 1 and n_bytes > 0").drop("n")
        many = table.where("rid < 0").select("fp", "n_bytes", F.col("th").alias("key")).distinct().join(again, ["fp", "n_bytes"])
        big = df.where(huge).select(F.xxhash64(text_col).alias("key"), text.cast("binary").alias("text")).join(many, "key").select("fp", "n_bytes", "text")
        chunks = chunks.unionByName(_pieces(big).mapInArrow(_chunks_of_pieces, _CHUNKS))
    return chunks.groupBy("fp", "n_bytes", "no").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo != hi").select("fp", "n_bytes").distinct()


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, keep_id, group_size, kept, text_sha256) for every row of ``df``."""
    small_batches(df.sparkSession)
    table = fingerprints(df, id_col, text_col)
    repeated = table.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).where("n > 1")
    many = repeated.count()
    sieve = Sieve.build(repeated, "fp", min(MAX_LOG_BITS, max(16, math.ceil(math.log2(16 * max(1, many))))))
    found = _collided(df, text_col, sieve, table if getattr(table, "has_huge", False) else None)
    bad = stash(found, "collided")
    key = ["fp", "n_bytes", "sub"]
    if bad.isEmpty():
        table = table.withColumn("sub", F.lit(""))
    else:
        table = table.join(bad.withColumn("bad", F.lit(True)), ["fp", "n_bytes"], "left").withColumn("sub", F.when(F.col("bad"), F.col("text_sha256")).otherwise("")).drop("bad")
    first = table.groupBy(*key).agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("rid").alias("rid"))).alias("keep"), F.count("*").alias("group_size"))
    return table.join(first, key).select("id", "th", F.col("keep.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its columns: one row of each group of equal texts."""
    made = stash(exact_dedup(df, id_col, text_col), "copies")
    th, kid, kth = (free_name(df.columns, x) for x in ("row_th", "keep_id", "keep_th"))
    stay = made.where("kept").select(F.col("id").alias(kid), F.col("th").alias(kth))
    hit = df.withColumn(th, F.xxhash64(text_col))
    out = hit.join(stay, hit[id_col].eqNullSafe(stay[kid]) & (hit[th] == stay[kth]), "left_semi")
    if not made.groupBy("id", "th").count().where("count > 1").isEmpty():  # rows repeated whole
        out = out.dropDuplicates([id_col, th])
    return out.drop(th)
