"""LM scoring by subword lattice likelihood.

A text is a sequence of words, each of them a space and its lower-cased bytes,
then an end. The pieces of an existing subword vocabulary (the pieces and their
scores are given; byte pieces cover what is left) segment a word in many ways.
Its probability is the sum over all segmentations of the product of the pieces'
probabilities, by a forward recursion in log space over the lattice of pieces;
the text's is the product over its words and the end.

Piece probabilities start from the vocabulary's scores (ranks r: 1 / (r + 10))
and are fitted to the training documents by ``ROUNDS`` rounds of expectation
maximisation. As the lattice splits at spaces, both work on distinct words: the
corpus is counted once into a table of distinct words, which grows with the
input, is spread over all tasks and is never collected. Only the expected counts
of the pieces come to the driver (the vocabulary's size).

Scoring looks up each distinct word's probability and count. The ``HOT_WORDS``
most frequent words are broadcast (a fixed number); a document's other words are
joined by a shuffle, so no frequent word makes a hot key.

Defined results: null text counts as empty (one token, the end); a null id is
taken as an empty text when documents are dealt into held out and training;
repeated rows each count and get a row each; without training words every word's
count is zero; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcspool.plans.stash import drop, small_batches, stash

ROUNDS = 3
HOT_WORDS = 200_000
FLOOR = 0.1
_WORDS_AT_ONCE = 20_000


def load_pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, first probabilities) of a sentencepiece vocabulary; the word mark is a space. The last piece is the end."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        if sp.is_byte(i):
            found.setdefault(bytes([int(sp.id_to_piece(i)[1:-1], 16)]), 1e-6)
            continue
        piece = sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and sp.get_score(i) > -1e8:
            found[piece] = 1.0 / (10.0 - sp.get_score(i))
    found.setdefault(b" ", 1e-3)
    p = np.array([*found.values(), 0.01])
    return [*found, b""], p / p.sum()


class Trie:
    """Byte transitions over all pieces in sorted arrays, walked for many positions at once."""

    def __init__(self, pieces: list[bytes]):
        at, ends, self.depth = {b"": 0}, {}, 0
        for k, p in enumerate(pieces[:-1]):
            for i in range(1, len(p) + 1):
                at.setdefault(p[:i], len(at))
            ends[at[p]] = k
            self.depth = max(self.depth, len(p))
        step = sorted((at[p[:-1]] * 256 + p[-1], n) for p, n in at.items() if p)
        self.keys = np.array([k for k, _ in step], np.int64)
        self.next = np.array([n for _, n in step], np.int64)
        self.piece = np.full(len(at), -1, np.int64)
        for n, k in ends.items():
            self.piece[n] = k
        self.first = np.full(256, -1, np.int64)
        root = self.keys < 256
        self.first[self.keys[root]] = self.next[root]

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in ``data``; ``stop``: for each position, where its word ends."""
        at = np.arange(len(data))
        node, i = self.first[data], at
        starts, ends, pieces = [], [], []
        for length in range(1, self.depth + 1):
            alive = node >= 0
            at, node = at[alive], node[alive]
            p = self.piece[node]
            hit = p >= 0
            starts.append(at[hit])
            ends.append(at[hit] + length)
            pieces.append(p[hit])
            i = at + length
            more = i < stop[at]
            at, node, i = at[more], node[more], i[more]
            if not len(at):
                break
            key = node * 256 + data[i]
            j = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            node = np.where(self.keys[j] == key, self.next[j], -1)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)


class Lattice:
    """The lattices of many words at once; log probabilities of words and expected counts of pieces."""

    def __init__(self, trie: Trie, words: list[bytes]):
        size = np.array([len(w) + 1 for w in words])
        data = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
        self.begin = np.r_[0, np.cumsum(size)[:-1]]
        word = np.repeat(np.arange(len(words)), size)
        s, e, self.piece = trie.edges(data, np.repeat(self.begin + size, size))
        self.word = word[s]
        # a node for each position of a word and one for its end
        self.s, self.e = s + self.word, e + self.word
        self.begin = self.begin + np.arange(len(words))
        self.end = self.begin + size
        self.nodes = int(size.sum()) + len(words)

    @staticmethod
    def _steps(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
        """Edges in order of the step and node they are summed into, the bounds of each step, and starts of each node's edges."""
        order = np.lexsort((at, rank))
        a, r = at[order], rank[order]
        edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(a) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else edge
        return order, list(zip(edge.tolist(), [*edge[1:].tolist(), len(a)], strict=True)), first

    @staticmethod
    def _recur(value: np.ndarray, into: np.ndarray, out_of: np.ndarray, weight: np.ndarray, steps) -> None:
        order, bounds, first = steps
        into, out_of, weight = into[order], out_of[order], weight[order]
        for a, b in bounds:
            f = first[np.searchsorted(first, a) : np.searchsorted(first, b)]
            x = value[out_of[a:b]] + weight[a:b]
            top = np.maximum.reduceat(x, f - a)
            n = np.diff(np.r_[f, b])
            value[into[f]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), f - a))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        self.alpha = np.full(self.nodes, -np.inf)
        self.alpha[self.begin] = 0.0
        self.weight = logp[self.piece]
        self._recur(self.alpha, self.e, self.s, self.weight, self._steps(self.e, self.e - self.begin[self.word]))
        return self.alpha[self.end]

    def expected(self, logp: np.ndarray, count: np.ndarray, pieces: int) -> np.ndarray:
        total = self.forward(logp)
        beta = np.full(self.nodes, -np.inf)
        beta[self.end] = 0.0
        self._recur(beta, self.s, self.e, self.weight, self._steps(self.s, self.end[self.word] - self.s))
        share = np.exp(self.alpha[self.s] + self.weight + beta[self.e] - total[self.word])
        return np.bincount(self.piece, share * count[self.word], pieces)


def _word_blocks(batches) -> Iterator[pa.Table]:
    """The batches again as tables of many rows, the words of each about alike in length."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 4 * _WORDS_AT_ONCE:
            yield from _by_length(held)
            held, size = [], 0
    if size:
        yield from _by_length(held)


def _by_length(held) -> Iterator[pa.Table]:
    import pyarrow.compute as pc

    t = pa.Table.from_batches(held).combine_chunks()
    t = t.take(pc.sort_indices(pc.binary_length(t.column("word"))))
    size = np.cumsum(pc.binary_length(t.column("word")).to_numpy() + 1)
    at = 0
    while at < t.num_rows:  # at most so many words, and so many bytes unless one word has more
        room = (size[at - 1] if at else 0) + 16 * _WORDS_AT_ONCE
        n = max(1, min(_WORDS_AT_ONCE, int(np.searchsorted(size, room)) - at))
        yield t.slice(at, n)
        at += n


_TRIES: dict[str, tuple] = {}


def trie_of(model_file: str) -> tuple[Trie, int]:
    """The worker's trie of a vocabulary, kept over tasks, and the number of pieces."""
    if model_file not in _TRIES:
        pieces = load_pieces(model_file)[0]
        _TRIES[model_file] = (Trie(pieces), len(pieces))
    return _TRIES[model_file]


def _source(df: DataFrame, id_col: str, text_col: str, fold: int, folds: int) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    return df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))


def count_words(src: DataFrame) -> DataFrame:
    """(word, c, n): each distinct lower-cased word with its occurrences in training documents and in all."""

    def run(batches):
        for batch in batches:
            train, held = Counter(), Counter()
            for out, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (held if out else train).update((x.as_py() or b"").lower().split())
            words = [*train, *(w for w in held if w not in train)]
            c = [train.get(w, 0) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([a + held.get(w, 0) for a, w in zip(c, words, strict=True)], pa.int64())], names=["word", "c", "n"])

    return src.select("held_out", "text").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, model_file: str, ends: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end after ``rounds`` of expectation maximisation over ``words`` (word, c)."""
    p = load_pieces(model_file)[1]
    sc = words.sparkSession.sparkContext
    for _ in range(rounds):
        held = sc.broadcast(np.log(p))

        def run(batches, held=held):
            trie, size = trie_of(model_file)
            total = np.zeros(size)
            for t in _word_blocks(batches):
                total += Lattice(trie, t.column("word").to_pylist()).expected(held.value, t.column("c").to_numpy().astype(float), size)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "x"])

        got = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).toArrow()
        e = np.full(len(p), FLOOR)
        e[got.column("piece").to_numpy()] += got.column("x").to_numpy()
        e[-1] += ends
        p = e / e.sum()
    return np.log(p)


def score_words(words: DataFrame, model_file: str, logp: np.ndarray) -> DataFrame:
    """(word, c, n, lp): with the log10 of each word's marginal probability."""
    held = words.sparkSession.sparkContext.broadcast(logp)

    def run(batches):
        trie, _ = trie_of(model_file)
        for t in _word_blocks(batches):
            lp = Lattice(trie, t.column("word").to_pylist()).forward(held.value) / np.log(10)
            yield t.append_column("lp", pa.array(lp)).combine_chunks().to_batches()[0]

    return words.mapInArrow(run, "word binary, c long, n long, lp double")


def score(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", fold: int = 1, folds: int = 5, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Documents whose crc32(id as text) mod ``folds`` is ``fold`` are held out.
    ``base_score`` is the smoothed word-unigram log10 probability, ``score`` the lattice model's.
    """
    spark = df.sparkSession
    small_batches(spark)
    src = _source(df, id_col, text_col, fold, folds)
    kind = dict(src.dtypes)["id"]
    words = stash(count_words(src), "words")
    ends = src.where("not held_out").count()
    tokens, distinct = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, space = tokens + ends, distinct + (ends > 0)
    logp = fit(words, model_file, ends, rounds)
    scored = stash(score_words(words, model_file, logp), "scored")
    drop(words)

    low = np.log10(total + 0.5 * (space + 1))
    end_base, end_lp = float(np.log10(ends + 0.5) - low), float(logp[-1] / np.log(10))
    hot = scored.orderBy(F.desc("n"), "word").limit(hot_words).select("word", "c", "lp").toArrow()
    base = (np.log10(hot.column("c").to_numpy() + 0.5) - low).tolist()
    table = dict(zip(hot.column("word").to_pylist(), zip((hot.column("c").to_numpy() > 0).tolist(), base, hot.column("lp").to_pylist(), strict=True), strict=True))
    held = spark.sparkContext.broadcast(table)

    def run(batches):
        known_words = held.value
        for batch in batches:
            rids = batch.column(0).to_pylist()
            row, word, n, tokens, known, base, lp = [], [], [], [], [], [], []
            for k, x in enumerate(batch.column(3)):
                ws = (x.as_py() or b"").lower().split()
                a, b, c = int(ends > 0), end_base, end_lp
                for w, m in Counter(ws).items():
                    hit = known_words.get(w)
                    if hit:
                        a += m * hit[0]
                        b += m * hit[1]
                        c += m * hit[2]
                    else:
                        row.append(k)
                        word.append(w)
                        n.append(m)
                tokens.append(len(ws) + 1)
                known.append(a)
                base.append(b)
                lp.append(c)
            yield _rows(batch, range(len(rids)), [b" %d" % r for r in rids], [0] * len(rids), tokens, known, base, lp)
            if row:
                yield _rows(batch, row, word, n)

    def _rows(batch, row, word, n, *sums):
        at = pa.array(row, pa.int64())
        whole = bool(sums)
        none = lambda t: pa.nulls(len(at), t)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at) if whole else none(batch.schema.field(1).type), batch.column(2).take(at) if whole else none(pa.bool_()), pa.array(word, pa.binary()), pa.array(n, pa.int64()),
             *([pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), pa.array(sums[2], pa.float64()), pa.array(sums[3], pa.float64())] if whole else [none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())])],
            names=["rid", "id", "held_out", "word", "n", "n_tokens", "n_known", "base", "lp"])

    parts = src.mapInArrow(run, f"rid long, id {kind}, held_out boolean, word binary, n long, n_tokens long, n_known long, base double, lp double")
    seen = scored.select(F.col("word").alias("w"), "c", F.col("lp").alias("word_lp"))
    met = parts.join(seen, parts["word"] == seen["w"], "left")
    out = met.groupBy("rid").agg(
        F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.lit(0)) + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce(F.col("base"), F.col("n") * (F.log10(F.col("c") + 0.5) - float(low)))).alias("base_score"),
        F.sum(F.coalesce(F.col("lp"), F.col("n") * F.col("word_lp"))).alias("score"))
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
