import hashlib
import re

import pytest
from pyspark.sql import functions as F

from arcspool.llm import exact_dedup as E
from arcspool.llm.queries import op6_exact_dedup


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    groups = {}
    for k, t in docs.items():
        groups.setdefault(t, []).append(k)
    want = sorted((k, min(groups[t]), len(groups[t]), k == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in docs.items())
    assert sorted(tuple(r) for r in op6_exact_dedup(spark, d).collect()) == want


@pytest.mark.parametrize("text", [b"", b"a", b" \n\t ", b" x  y\x0b\x0cz\r", b"ab " * 5000, bytes(range(1, 256)) * 200])
def test_fingerprints_compose(text):
    assert E.normalised(text) == re.sub(rb"[\x20\x09-\x0d]+", b" ", text)
    plain = [0, 0]
    for b in text:
        plain = [(plain[k] * E.BASES[k] + b + 1) % E.PRIMES[k] for k in range(2)]
    assert E.fingerprint(text) == tuple(plain)
    for cut in (0, 1, len(text) // 3, len(text)):
        a, b = text[:cut], text[cut:]
        assert E.combine(E.fingerprint(a), E.fingerprint(b), len(b)) == E.fingerprint(text)


def test_colliding_fingerprints(spark, monkeypatch):
    """With one fingerprint for all texts of a length, the comparison of chunks keeps different texts apart."""
    texts = ["aaaa", "bbbb", "aaaa", "cccc", "cc", "x" * 70000 + "1", "x" * 70000 + "2", "x" * 70000 + "1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, t, 1, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, i, 0, fp, n, sha) for i, t, fp, n, sha in rows], "rid long, id long, th long, fp long, n_bytes long, text_sha256 string")
    monkeypatch.setattr(E, "fingerprints", lambda *a: table)
    bad = spark.createDataFrame([(1, 4), (1, 70001)], "fp long, n_bytes long")
    monkeypatch.setattr(E, "_collided", lambda *a: bad)
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(df).collect()}
    assert got == {0: (0, 2, True), 1: (1, 1, True), 2: (0, 2, False), 3: (3, 1, True), 4: (4, 1, True), 5: (5, 2, True), 6: (6, 1, True), 7: (5, 2, False)}


def test_parts_cut_anywhere_make_the_whole():
    import random

    rnd = random.Random(3)
    for text in (b"", b" ", b"a", b" \n a  b\tc ", b"one two  three\n\n", b" " * 50 + b"x" * 9000 + b" \t", bytes(rnd.choice(b"ab \n") for _ in range(3000))):
        want = E.normalised(text)
        for _ in range(20):
            cuts = sorted(rnd.randrange(len(text) + 1) for _ in range(rnd.randrange(6)))
            pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            parts = [E.Part.of(p) for p in pieces]
            while len(parts) > 1:  # in any grouping
                k = rnd.randrange(len(parts) - 1)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert parts[0].whole() == (E.fingerprint(want), len(want))
            flow = E.Normaliser()
            assert b"".join(flow.feed(p) for p in pieces) == want


def test_huge_documents_as_pieces(spark, monkeypatch):
    """With pieces of a few bytes, everything goes the way of huge documents, and gives the same rows."""
    texts = [None, "", " ", "a b", " ".join(f"w{i}" for i in range(500)), "  ".join(f"w{i}" for i in range(500)), "é " * 300 + "\n", "é  " * 300, "\n" * 700, "\t" * 900 + " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(tuple(r) for r in E.exact_dedup(df).drop("th").collect())
    assert [w[1] for w in want] == [0, 0, 2, 3, 4, 4, 6, 6, 2, 2]
    for huge, piece in ((100, 37),):
        monkeypatch.setattr(E, "HUGE", huge)
        monkeypatch.setattr(E, "PIECE", piece)
        monkeypatch.setattr(E, "COMPARED", 50)
        assert sorted(tuple(r) for r in E.exact_dedup(df).drop("th").collect()) == want
        assert sorted(r.doc_id for r in E.drop_copies(df).collect()) == [0, 2, 3, 4, 6]


class Everything:
    """A sieve that passes all."""

    words, log_bits = __import__("numpy").full(1, 2**64 - 1, "uint64"), 6


@pytest.mark.parametrize("huge", [1 << 22, 100])
def test_chunks_that_differ_are_found(spark, monkeypatch, huge):
    """Texts that are made to share a key and differ in one chunk, the first, a middle or the last."""
    monkeypatch.setattr(E, "HUGE", huge)
    monkeypatch.setattr(E, "PIECE", 64)
    monkeypatch.setattr(E, "COMPARED", 16)
    base = "0123456789abcdef" * 20
    for at in (0, 150, 319):
        other = base[:at] + "#" + base[at + 1 :]
        same = [base, base, base]
        for texts, found in ((same, 0), ([base, other, base], 1)):
            df = spark.createDataFrame([(t,) for t in texts], "text string")
            if huge > 1000:
                monkeypatch.setattr(E, "fingerprint", lambda data: (7, 7))
                assert E._collided(df, "text", Everything()).count() == found
                monkeypatch.undo()
                monkeypatch.setattr(E, "HUGE", huge)
                monkeypatch.setattr(E, "COMPARED", 16)
            else:
                table = df.select(F.lit(-1).cast("long").alias("rid"), F.xxhash64("text").alias("th"), F.lit(5).cast("long").alias("fp"), F.lit(320).cast("long").alias("n_bytes"))
                assert E._collided(df, "text", Everything(), table).count() == found


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (5, "x\t\ny", "d"), (5, "x\t\ny", "d"), (None, "only", "e"), (7, " ", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = sorted(((r.id is None, r.id or 0, r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(df).collect()), key=str)
    assert [g for g in got if g[:2] == (False, 5)] in ([(False, 5, 5, 3, False), (False, 5, 5, 3, True)],)
    assert sum(r.kept for r in E.exact_dedup(df).collect()) == 4
    kept = E.drop_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "7", "None"]
    assert E.exact_dedup(df.limit(0)).count() == 0 and E.drop_copies(df.limit(0)).count() == 0
