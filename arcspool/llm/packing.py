"""Packing into sequences: first-fit decreasing over a tournament tree, in randomised groups.

A document's token ids are followed by one end id. It is cut from its start into
pieces of ``capacity`` tokens, the last one shorter. Pieces of full length are
sequences of their own; the others go, longest first, each into the first bin
that has room. A tournament tree over the bins' free room finds that bin in
logarithmic time. Documents are dealt to groups at random (by a hash of the row's
number) of about ``group_docs`` documents, so a group's memory doesn't grow with
the table; each is packed by itself and leaves one bin or two that aren't full.
Where the order of the documents is to reach the sequences (``place``), a group is
a stretch of ``group_docs`` places instead, and sequence ids rise with the groups.

Only (id, start, length, checksum) of a piece is shuffled; texts and ids never are.

Defined results: null text counts as empty (its only id is the end id); repeated
rows and null ids are packed like any other row; an empty table gives no rows;
columns beyond id, text and place are ignored, whatever their names.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcspool.llm.exprs import free_name
from arcspool.plans.stash import shuffle_partitions, small_batches, stash

CAPACITY = 4096
END_ID = 2
GROUP_DOCS = 16384
#: Words whose ids a worker keeps in each of two generations.
CACHED_WORDS = 600_000


class BinTree:
    """A tournament tree over bins' free room: each inner node has the most room of its leaves."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Put ``length`` into the first bin with room; its number and the room it had."""
        room, size = self.room, self.size
        if room[1] < length:
            raise ValueError("no bin has room")
        i = 1
        while i < size:
            i *= 2
            if room[i] < length:
                i += 1
        had = room[i]
        room[i] = had - length
        at = i >> 1
        while at:
            a, b = room[2 * at], room[2 * at + 1]
            most = a if a > b else b
            if room[at] == most:
                break
            room[at] = most
            at >>= 1
        return i - size, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; every length is from 1 to ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    tree = BinTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        b, had = tree.place(n)
        bins[k], offsets[k] = b, capacity - had
    return bins, offsets


class WordIds:
    """Token ids as little-endian uint32 bytes, from a cache by white-space-separated word.

    The tokenizer turns white space into a split and drops it, and no token goes
    over one, so a text's ids are those of its words in order. Only ASCII white
    space splits here; a word may hold any other. As the tokenizer lower-cases,
    words of ASCII alone may be lowered first, unless the text might hold a special
    token; others may compose otherwise in capitals and are left as they are. A full
    stop or comma after an ASCII letter is a token of its own, so a word with one
    needs only the ids of its stem. The cache has two generations of
    ``CACHED_WORDS``, so that words in use stay and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode, self.cache, self.old = Tokenizer.from_file(path).encode, {}, {}
        self.marks = {m: self._ids(m) for m in (b".", b",")}

    def _ids(self, word: bytes) -> bytes:
        return array("I", self.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _known(self, word: bytes) -> bytes:
        ids = self.cache.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                mark = self.marks.get(word[-1:]) if word[-2:-1].isalpha() else None
                ids = self._known(word[:-1]) + mark if mark else self._ids(word)
            if len(word) < 64:
                if len(self.cache) >= CACHED_WORDS:
                    self.old, self.cache = self.cache, {}
                self.cache[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        raw = text.encode()
        found = self.cache.get
        if b"<|" in raw:
            words = raw.split()
        elif text.isascii():
            words = raw.lower().split()
        else:
            words = [w.lower() if w.isascii() else w for w in raw.split()]
        return b"".join([found(w) or self._known(w) for w in words])


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's one cache for a tokenizer, kept over tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def file_places(df: DataFrame, name: str) -> DataFrame:
    """A scan of Parquet files with the rows' places, in the order in which they were written, in the long column ``name``; anything else is written first."""
    try:
        df.select("_metadata.row_index").schema  # noqa: B018  resolves only for a scan
    except AnalysisException:
        df = stash(df, "ordered")
    part, row = free_name(df.columns, "part"), free_name(df.columns, "row")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    rows = df.select("*", F.struct(number.alias("n"), F.col("_metadata.file_name").alias("file")).alias(part), F.col("_metadata.row_index").alias(row))
    files = rows.groupBy(F.col(part).alias("of")).agg(F.count("*").alias("n"))  # a row for each file
    files = files.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name))
    files = F.broadcast(files)  # no more than the driver lists for the scan
    return rows.join(files, rows[part] == files["of"]).withColumn(name, (F.col(name) + F.col(row)).cast("long")).drop(part, row, "of")


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, place: str | None = None) -> DataFrame:
    """(place, id, start, length, ids_crc32, doc_tokens) of every piece of every row; ``place`` is the column of that name, else a random-looking long."""
    at = F.col(place).cast("long") if place else F.xxhash64(F.monotonically_increasing_id())
    src = df.select(at.alias("place"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"place long, id {dict(src.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = word_ids(tokenizer)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, x in enumerate(batch.column(2)):
                raw = memoryview(ids_of(x.as_py() or "") + end)
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    m = min(capacity, n - s)
                    row.append(k)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + m)]))
                    total.append(n)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(v, pa.int64()) for v in (start, length, crc, total))], names=["place", "id", "start", "length", "ids_crc32", "doc_tokens"])

    return src.mapInArrow(run, schema)


def _group_packer(capacity: int):
    def run(batches):
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.take(pc.sort_indices(t, sort_keys=[("place", "ascending"), ("start", "ascending")]))
            length = t.column("length").to_numpy()
            bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            part = np.flatnonzero(length < capacity)
            bins[part], offset[part] = first_fit_decreasing(length[part], capacity)
            full = np.flatnonzero(length == capacity)
            bins[full] = (bins[part].max() + 1 if len(part) else 0) + np.arange(len(full))
            seq = (t.column("grp").to_numpy() << 32) + bins
            out = t.drop_columns(["grp", "place"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            while batch.num_rows:
                grp = batch.column(0).to_numpy()
                if held and held[0].column(0)[0].as_py() != grp[0]:
                    yield packed()
                    held = []
                n = int(np.searchsorted(grp, grp[0], "right"))
                held.append(batch.slice(0, n))
                batch = batch.slice(n)
        if held:
            yield packed()

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, place: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every row in exactly one piece.

    ``place``: a long column of ``df`` with the documents' places from 0, if groups are to follow an order.
    """
    spark = df.sparkSession
    small_batches(spark)
    cut = stash(pieces(df, tokenizer, id_col, text_col, capacity, end_id, place), "pieces")
    groups = max(1, round(cut.where("start = 0").count() / group_docs))
    grp = F.expr(f"place div {int(group_docs)}") if place else F.pmod("place", F.lit(groups))
    dealt = cut.select(grp.cast("long").alias("grp"), "*").repartition(min(groups, 8 * shuffle_partitions(spark)), "grp").sortWithinPartitions("grp")
    kinds = dict(cut.dtypes)
    return dealt.mapInArrow(_group_packer(capacity), f"id {kinds['id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
