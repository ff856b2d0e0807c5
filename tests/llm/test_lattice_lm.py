import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from arcspool.llm import lattice_lm as L
from arcspool.llm.queries import op8_lattice_lm

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def toks(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def slow_forward(word, logp):
    """log of the sum over segmentations, by the plain recursion in the linear domain."""
    b = b" " + word
    a = [1.0] + [0.0] * len(b)
    for e in range(1, len(b) + 1):
        for s in range(max(0, e - 50), e):
            if b[s:e] in logp:
                a[e] += a[s] * math.exp(logp[b[s:e]])
    return math.log(a[-1])


def every(word, pieces):
    """All segmentations."""
    if not word:
        yield []
    for e in range(1, len(word) + 1):
        if word[:e] in pieces:
            for rest in every(word[e:], pieces):
                yield [word[:e], *rest]


def test_forward_and_expected_counts():
    pieces, p = L.load_pieces(MODEL)
    logp, trie = np.log(p), L.Trie(pieces)
    ws = [b"the", "été".encode(), b"x", "語".encode(), b"ab", b"of"]
    lat = L.Lattice(trie, ws)
    index = {x: k for k, x in enumerate(pieces[:-1])}
    got, want = lat.expected(logp, np.arange(1.0, 7.0), len(pieces)), np.zeros(len(pieces))
    for c, (w, f) in enumerate(zip(ws, lat.forward(logp), strict=True), 1):
        ways = [[index[x] for x in s] for s in every(b" " + w, index)]
        probs = [math.exp(sum(logp[k] for k in s)) for s in ways]
        assert f == pytest.approx(math.log(sum(probs)))
        for s, q in zip(ways, probs, strict=True):
            for k in s:
                want[k] += c * q / sum(probs)
    assert np.allclose(got, want)


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_lattice_lm(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    count, ends = Counter(), 0
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(toks(t))
            ends += 1
    N, V = sum(count.values()) + ends, len(count) + 1
    words = spark.createDataFrame([(w.encode(), c, c) for w, c in count.items()], "word binary, c long, n long")
    lp = L.fit(words, MODEL, ends)
    logp = dict(zip(L.load_pieces(MODEL)[0][:-1], lp[:-1], strict=True))
    base = lambda c: math.log10((c + 0.5) / (N + 0.5 * (V + 1)))
    for r in rows:
        ws = toks(docs[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(w in count for w in ws) + 1, N)
        assert r.base_score == pytest.approx(sum(base(count[w]) for w in ws) + base(ends))
    for r in rows[:25]:
        ws = toks(docs[r.doc_id])
        assert r.score == pytest.approx((sum(slow_forward(w.encode(), logp) for w in ws) + lp[-1]) / math.log(10))
    first = np.log(L.load_pieces(MODEL)[1])
    held = [(w.encode(), n) for d, t in docs.items() if zlib.crc32(str(d).encode()) % 5 == 1 for w, n in Counter(toks(t)).items()]
    lat = L.Lattice(L.trie_of(MODEL)[0], [w for w, _ in held])
    n = np.array([n for _, n in held])
    once = L.fit(words, MODEL, ends, 1)
    assert (lat.forward(lp) * n).sum() > (lat.forward(once) * n).sum() > (lat.forward(first) * n).sum()  # fitting helps unseen text


def test_edges(spark):
    rows = [(1, None, 1), (None, "a b", 2), (2, "", 3), (2, "A a \x00 " + "z" * 3000, 4), (2, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = L.score(df, MODEL, hot_words=1).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 5]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert L.score(df.limit(0), MODEL).count() == 0
