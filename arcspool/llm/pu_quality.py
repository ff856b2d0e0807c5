"""Quality classifier by positive-unlabelled learning.

A small network is fitted to minimise the non-negative unbiased risk

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),   l the sigmoid loss,

with trusted positives P (training documents labelled 1), unlabelled web text U
(training documents, whatever their label) and the class prior pi, estimated as
the share of 1 among the training labels. When the inner difference is negative,
its gradient is followed upwards, as the estimator prescribes. Features are
counts over the whole text, gathered in numpy: pairs of byte classes, and shares
of repeated words, word pairs and lines. Nothing else enters a score.

The fit uses at most about ``POSITIVES`` and ``UNLABELLED`` rows, picked by a hash of the
id; their features, some 20 MB, are all that reaches the driver. The scan of the
documents broadcasts only the picked ids.

Defined results: null text counts as empty, and an empty text is scored like any
other by its (all zero) features; a null id counts as an empty text for the fold
and is never labelled; null labels are ignored; without positives every score is
0.5; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.plans.stash import small_batches

POSITIVES = 10_000
UNLABELLED = 20_000
HIDDEN = 24
EPOCHS = 60
SEED = 7

_CLASSES = 12


def _byte_classes() -> np.ndarray:
    out = np.full(256, 10, np.uint8)
    for k, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"#*$%&", b"|<>")):
        out[list(group)] = k
    out[128:] = 11
    return out


_CLASS = _byte_classes()
N_FEATURES = _CLASSES * _CLASSES + 8


def features(raw: bytes) -> np.ndarray:
    """The features of a UTF-8 text."""
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    c = _CLASS[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(c[:-1].astype(np.int64) * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / len(c))
    ws = raw.split()
    if ws:
        n = len(ws)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        two = list(zip(ws, ws[1:], strict=False))
        out[-8:] = (
            np.log1p(n) / 10,
            sum(map(len, ws)) / n / 10,
            len(set(ws)) / n,
            len(set(two)) / max(1, len(two)),
            sum(a == b for a, b in two) / n,
            1 - len(set(lines)) / len(lines),
            np.log1p(n / len(lines)) / 10,
            1.0,
        )
    return out


class Net:
    """One hidden layer on standardised features; g is the log odds."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.parts = mean, scale, w1, b1, w2, b2

    def g(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.parts
        return np.tanh(((x - mean) / scale) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.g(x), -40, 40)))


def nn_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part before the bound) of the risk."""
    loss = lambda z: 1 / (1 + np.exp(np.clip(z, -40, 40)))
    return prior * loss(gp).mean(), loss(-gu).mean() - prior * loss(-gp).mean()


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Minimise the non-negative risk by Adam over shuffled batches; the same input gives the same net."""
    rnd = np.random.default_rng(seed)
    d = N_FEATURES
    both = np.concatenate([pos, unl]).astype(np.float64)
    mean, scale = (both.mean(0), both.std(0) + 0.05) if len(both) else (np.zeros(d), np.ones(d))
    if not len(pos) or not len(unl):
        return Net(mean, scale, np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    p, u = (pos - mean) / scale, (unl - mean) / scale
    w = [rnd.normal(0, 0.5 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    steps = max(1, -(-len(u) // 512))
    for _ in range(epochs):
        ps, us = np.array_split(rnd.permutation(len(p)), min(steps, len(p))), np.array_split(rnd.permutation(len(u)), steps)
        for k in range(steps):
            xp, xu = p[ps[k % len(ps)]], u[us[k]]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ w[0] + w[1])
            g = np.clip(h @ w[2] + w[3], -40, 40)
            s = 1 / (1 + np.exp(-g))
            slope = s * (1 - s)  # of the loss of either sign
            n, gp, gu = len(xp), g[: len(xp)], g[len(xp) :]
            _, negative = nn_risk(gp, gu, prior)
            dg = np.zeros(len(x))
            if negative >= 0:
                dg[:n] = -prior * slope[:n] / n * 2
                dg[n:] = slope[n:] / len(xu)
            else:  # ascend the negative part alone
                dg[:n] = prior * slope[:n] / n
                dg[n:] = -slope[n:] / len(xu)
            dh = np.outer(dg, w[2]) * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ dg + 1e-4 * w[2], dg.sum(keepdims=True)]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Net(mean, scale, w[0], w[1], w[2], float(w[3][0]))


def _fold(id_col, folds: int):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _features(batch_text) -> np.ndarray:
    x = [features(t.as_py() or b"") for t in batch_text]
    return np.stack(x) if x else np.zeros((0, N_FEATURES), np.float32)


def sample_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fold: int, folds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Features of trusted positives and of unlabelled documents, and the class prior, all from training rows."""
    train = labels.where((_fold(F.col(id_col), folds) != fold) & F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid"), "quality")
    ones, every = train.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("*")).first()
    prior = float(np.clip(ones / every if every else 0.5, 0.05, 0.95))
    turn = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20))
    part = lambda want, have: int(min(1.0, want / max(1, have)) * (1 << 20))
    pos = train.where((F.col("quality") == 1) & (turn("lid") < part(POSITIVES, ones))).select("lid").distinct()
    src = docs.where(_fold(F.col(id_col), folds) != fold).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    n = docs.count()
    rows = src.join(F.broadcast(pos), src["id"] == pos["lid"], "left")
    rows = rows.select(F.col("lid").isNotNull().alias("p"), (turn(F.struct("id", F.lit("u"))) < part(UNLABELLED * folds / max(1, folds - 1), n)).alias("u"), "text").where("p or u")

    def run(batches):
        for batch in batches:
            x = _features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["p", "u", "x"])

    got = rows.mapInArrow(run, "p boolean, u boolean, x binary").toArrow()
    raw = sorted(zip(got.column("x").to_pylist(), got.column("p").to_pylist(), got.column("u").to_pylist(), strict=True))
    x = np.frombuffer(b"".join(r[0] for r in raw), np.float32).reshape(-1, N_FEATURES)
    return x[[i for i, r in enumerate(raw) if r[1]]], x[[i for i, r in enumerate(raw) if r[2]]], prior


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 3) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``; labels are learnt from rows outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    net = fit(*sample_features(docs, labels, id_col, text_col, fold, folds))
    held = spark.sparkContext.broadcast(net.parts)
    src = docs.select(F.col(id_col).alias("id"), (_fold(F.col(id_col), folds) == fold).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        model = Net(*held.value)
        for batch in batches:
            s = model.score(_features(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, held_out boolean, score double, predicted int")
