import random

import numpy as np
import xxhash

from arcspool.llm import simhash as S
from arcspool.llm.queries import op2_simhash


def slow_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(fps):
    """Smallest reachable index by brute force."""
    n = len(fps)
    f = np.array(fps, np.uint64)
    up = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2):
            a, b = i, int(j)
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while up[i] != i:
            i = up[i]
        out.append(i)
    return out


def test_fingerprint():
    for t in ["", " \n", "A", "a b", "A b c", "x y z w\tv\x0bu é Ü", None, "the cat " * 500]:
        assert S.simhash((t or "").encode()) == slow_simhash(t)


def test_classes_against_brute_force(spark):
    rnd = random.Random(5)
    fps = []
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps.append(f)
        for _ in range(rnd.randrange(12)):
            f ^= 1 << rnd.randrange(64)
            fps.append(f)
    fps += [rnd.getrandbits(20) << 40 for _ in range(400)]  # crowded blocks
    fps = sorted(set(fps))
    want = classes(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    for shard_rows in (4096, 20):
        got = {r.fp % 2**64: r.comp for r in S.link_classes(df, 2, shard_rows).collect()}
        groups = {}
        for f, w in zip(fps, want, strict=True):
            groups.setdefault(w, set()).add(f)
        for g in groups.values():
            if len(g) == 1:
                assert g.pop() not in got
            else:
                assert len({got[f] for f in g}) == 1 and {f for f in got if got[f] == got[next(iter(g))]} == g


def test_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [slow_simhash(t) for _, t in docs]
    want = {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, classes(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf).collect()}
    assert got == want


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a b c d", "z"), (3, "a b c d", "z"), (3, "a b c d", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.id is None, r.id or 0, r.component_id) for r in S.near_dups(df).collect()))
    assert got == [(False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 3, 3), (True, 0, 3)]
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == [1, 3, 3]
    assert S.near_dups(df.limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    texts = ["one two three four five", "six seven eight nine ten", "a b c d e f g", "k l m n o p q", "u v w x y z"]
    a, b, c, d, e = texts
    rows = [
        (1, a), (None, a.upper()),  # a copy without an id goes ...
        (None, b),  # ... and a text of its own without an id stays
        (5, c), (3, c.upper()), (5, d), (6, d.upper()),  # 5 goes for 3 with one text and stands for its class with the other
        (7, e), (7, e.upper()),  # near copies that share an id
        (None, "q r s t"), (None, "Q R S T"),  # a class without any id
    ]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len({r.text.lower() for r in got}) == 6
    assert {(r.doc_id, r.text) for r in got if r.doc_id not in (None, 7)} == {(1, a), (3, c.upper()), (5, d)}
    assert (None, b) in {(r.doc_id, r.text) for r in got}
