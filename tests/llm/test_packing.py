import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from arcspool.llm import packing as P
from arcspool.llm.queries import op10_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity=4096):
    tok = Tokenizer.from_file(PATH)
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for d, rs in by.items():
        ids = [*tok.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
        total += at
    return total / (capacity * len(seqs))


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(op10_packing(spark, sf).collect(), docs) > 0.9


def test_edges(spark):
    texts = {1: None, 2: "", 3: "<|endoftext|> It's  A\x0btest of 12 ́x é   don't<|startoftext|>", 4: "word " * 9000, 5: " \n", 6: "x" * 300}
    df = spark.createDataFrame([(*k, 0) for k in texts.items()], "doc_id long, text string, start int")
    rows = P.pack(df, PATH).withColumnRenamed("id", "doc_id").collect()
    check(rows, texts)
    assert P.pack(df.limit(0), PATH).count() == 0
    twice = P.pack(df.union(df), PATH).collect()
    assert len(twice) == 2 * len(rows)


def test_first_fit_decreasing():
    rnd = np.random.default_rng(1)
    n = rnd.integers(1, 101, 300)
    bins, off = P.first_fit_decreasing(n, 100)
    room, want = [], {}
    for k in np.argsort(-n, kind="stable"):
        b = next((i for i, x in enumerate(room) if x >= n[k]), None)
        if b is None:
            b = len(room)
            room.append(100)
        want[k] = (b, 100 - room[b])
        room[b] -= n[k]
    assert [(bins[k], off[k]) for k in range(300)] == [want[k] for k in range(300)]


def test_decomposed_capitals():
    ids, tok = P.WordIds(PATH), Tokenizer.from_file(PATH)
    for text in ["J\u030c", "H\u0331 T\u0308 W\u030a", "aJ\u030cb, Plain É E\u0301 ÜBER Word. PLAIN,", "ALL ascii Here."]:
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text), "<u4").tolist() == want


def test_groups_are_whole_documents_in_order(spark):
    """With places, a group's sequences hold a stretch of documents; without, the groups still hold whole documents."""
    texts = {i: "word " * (5000 if i % 37 == 0 else i % 50) for i in range(400)}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, place string").repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")
    placed = P.file_places(df, "_place")
    assert [r.doc_id for r in placed.orderBy("_place").collect()] == [r["_place"] for r in placed.orderBy("doc_id").collect()] == list(range(400))
    rows = P.pack(placed, PATH, group_docs=60, place="_place").withColumnRenamed("id", "doc_id").collect()
    check(rows, texts)
    assert all(r.doc_id // 60 == r.sequence_id >> 32 for r in rows)
    rows = P.pack(df, PATH, group_docs=60).withColumnRenamed("id", "doc_id").collect()
    check(rows, texts)
    assert len({r.sequence_id >> 32 for r in rows}) > 4
    assert all(len({r.sequence_id >> 32 for r in rows if r.doc_id == d}) == 1 for d in (0, 37, 74))
    assert P.pack(P.file_places(df.limit(0), "_place"), PATH, place="_place").count() == 0
