import zlib

import numpy as np
import pytest

from arcspool.llm import pu_quality as P
from arcspool.llm.queries import op1_pu_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op1_pu_quality(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert set(rows) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for k, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    right = {q: np.mean([rows[r.doc_id].predicted == q for r in labels if r.quality == q]) for q in (0, 1)}
    assert right[0] > 0.8 and right[1] > 0.97


def test_risk_gradient():
    """The step that fit takes is the gradient of the bounded risk."""
    rnd = np.random.default_rng(2)
    gp, gu, pi, eps = rnd.normal(size=5), rnd.normal(size=7), 0.4, 1e-6
    a, b = P.nn_risk(gp, gu, pi)
    assert b >= 0
    s = lambda z: 1 / (1 + np.exp(-z))
    for k in range(5):
        up = gp.copy()
        up[k] += eps
        assert (sum(P.nn_risk(up, gu, pi)) - a - b) / eps == pytest.approx(-2 * pi * s(gp[k]) * (1 - s(gp[k])) / 5, rel=1e-3)
    up = gu.copy()
    up[0] += eps
    assert (sum(P.nn_risk(gp, up, pi)) - a - b) / eps == pytest.approx(s(gu[0]) * (1 - s(gu[0])) / 7, rel=1e-3)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "a b", 0.2), (2, "", 0.3), (2, "", 0.3), (3, "x " * 9000, 0.4)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    assert P.score_quality(docs, labels).count() == 5
    assert {r.score for r in P.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert P.score_quality(docs.limit(0), labels).count() == 0
