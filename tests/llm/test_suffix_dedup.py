import hashlib
import random

import numpy as np

from arcspool.llm import suffix_dedup as S
from arcspool.llm.queries import op9_suffix_dedup


def brute(docs, n=100):
    """docs: (id, text) in order of precedence."""
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            else:
                seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert results(op9_suffix_dedup(spark, sf)) == brute(docs)


def made(seed):
    rnd = random.Random(seed)
    word = lambda n, abc="abé \n": "".join(rnd.choice(abc) for _ in range(n))
    passages = [word(n, "abcdefgh ") for n in (60, 90, 99, 110, 250, 700)] + ["a" * 300, "xy" * 200]
    docs = []
    for i in range(60):
        t = ""
        for _ in range(rnd.randrange(5)):
            t += word(rnd.randrange(60), "abcdefgh ") + rnd.choice(passages)
        docs.append((i, t))
    docs += [(60, ""), (61, None), (62, "z" * 99), (63, "z" * 100), (64, "z" * 101), (65, docs[3][1]), (66, "é" * 51)]
    return docs


def test_random_documents(spark):
    docs = made(3)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for hot in (4096, 5):
        assert results(S.digest(S.remove_repeats(df, hot=hot))) == brute(docs)


def test_mergesort():
    rnd = np.random.default_rng(0)
    data = rnd.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1300] = data[2000:2300]
    x, group = np.arange(0, 3900, 3), np.sort(rnd.integers(0, 9, 1300))
    got = S.suffix_mergesort(data, S.prefix_hashes(data), x, group)
    want = sorted(range(1300), key=lambda i: (group[i], data[x[i] : x[i] + 100].tobytes(), i))
    assert got.tolist() == x[want].tolist()


def test_hash_collisions_are_caught(monkeypatch):
    monkeypatch.setattr(S, "compare", lambda data, prefix, x, y: np.zeros(len(x), np.int64))
    rnd = random.Random(1)
    texts = [bytes(rnd.randrange(97, 123) for _ in range(100)) for _ in range(6)]
    segs = [texts[k] for k in (0, 1, 0, 2, 1, 1)]
    got = S.repeats(segs, np.ones(6, np.int64), np.zeros(6, np.int64), np.zeros(6, np.int64))
    assert [m[0] for m in got] == [False, False, True, False, True, True]


def test_edges(spark):
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = [(1, t, 0), (1, t, 0), (None, t, 1), (2, t + "!", 2), (2, "other" + t, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r.id is None, r.id or 0, len(r.kept), r.n_bytes) for r in S.remove_repeats(df).collect()))
    n = len(t)
    assert got == [(False, 1, n, n), (False, 1, n, n), (False, 2, 1, n + 1), (False, 2, 5, n + 5), (True, 0, 0, n)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_passage_in_every_batch(spark):
    """A passage that every document holds, ids against the order of rows, and copies of one text, over many batches and tasks."""
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage, copy = word(180), word(400)
    docs = [(i, copy if i % 3 == 0 else word(rnd.randrange(40)) + passage + word(rnd.randrange(40))) for i in range(400)]
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(3).sortWithinPartitions("text")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        for hot in (4096, 50):
            assert results(S.digest(S.remove_repeats(df, hot=hot))) == brute(docs)
    finally:
        spark.conf.set(key, was)


def test_hot_key_is_judged_as_a_stream(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "ROWS", 10)
    a, b = b"x" * 100, b"y" * 100
    rows = [(7, i // 2, 5, 0, 1, -1, a if i % 10 else b) for i in range(60)]  # every row twice
    rows += [(8, 1, 5, 3, 1, 0, a), (8, 2, 5, 9, 1, 0, a)]
    names = ["key", "id", "th", "pos", "n", "off", "seg"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4], strict=True), kinds, strict=True)], names=names) for i in range(0, len(rows), 4)]
    made = list(S._judge(batches))
    got = {(r["id"], r["s"], r["e"]) for m in made for r in m.to_pylist()}
    want, seen = set(), {}
    for k, i, _, p, _, _, x in rows:
        if seen.setdefault((k, x), i) != i:
            want.add((i, p, p + 100))
    assert got == want and len(made) > 4


def test_text_longer_than_a_block(spark):
    rnd = random.Random(4)
    once = "".join(rnd.choice("abcdefghij ") for _ in range(S.BLOCK))
    docs = [(1, once + once[:5000]), (2, "short " + once[S.BLOCK - 300 :])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert results(S.digest(S.remove_repeats(df))) == brute(docs)
