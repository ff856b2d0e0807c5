"""URL filters: rules first, then the ratio of two character language models.

Rules (host suffix and path prefix) decide the urls that they fit; the longest
fitting rule wins. On all the different urls that rules decide, whole (a url counts
once, however many rows have it), two variable-order Markov models of bytes are
fitted, one on allowed and one on blocked urls: the probability of a byte after its
``ORDER`` predecessors leans on that after one fewer, and so on down to a uniform
one, in proportion ``LEAN`` to the counts. The score of a url is the difference of
the two log likelihoods divided by its length; the threshold is calibrated on each
fifth url of both classes, which the models haven't seen, for the best mean of both
classes' accuracy. Every row is scored, over its whole url.

What a byte adds to a score depends on it and its ``ORDER`` predecessors alone (a
gram). So counts, probabilities and ratios are tables with a row for each gram, from
aggregates and joins whose keys have at most 256 rows; the most frequent grams, at
most ``HOT``, are broadcast, and what others add is joined by gram. Nothing that grows
with the data is collected.

Defined results: null urls and urls without ``://`` have empty host and path, fit
no rule and score 0; if there are fewer than two urls of a class, the models are level and urls
without a rule are allowed; rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspool.llm.exprs import free_name
from arcspool.plans.rank import rank_within
from arcspool.plans.stash import drop, small_batches, stash

#: The production rules: fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: So many grams at most are broadcast with their ratios, 16 bytes each.
HOT = 1 << 17
ORDER = 5
LEAN = 4.0
#: Bytes that are looked at together.
_PIECE = 1 << 18


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    bare = F.split(F.coalesce(after, F.lit("")), r"[?#]", 2)[0]
    slash = F.locate("/", bare)
    host = F.when(slash > 0, F.substring(bare, F.lit(1), slash - 1)).otherwise(bare)
    path = F.when(slash > 0, F.substring(bare, slash, F.length(bare))).otherwise(F.lit(""))
    return lower_ascii(host), path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _pieces(urls: list[bytes]):
    """Lists of (url, the ORDER bytes ahead, bytes) of bounded size together; a url ends in a byte 1."""
    held, size = [], 0
    for k, u in enumerate(urls):
        text = bytes(ORDER) + u + b"\x01"
        for s in range(0, len(u) + 1, _PIECE):
            body = text[s + ORDER : s + ORDER + _PIECE]
            if held and size + len(body) > _PIECE:
                yield held
                held, size = [], 0
            held.append((k, text[s : s + ORDER], body))
            size += len(body)
    if held:
        yield held


def _grams(held) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its url and its gram: itself in the lowest byte, its predecessors above."""
    data = np.frombuffer(b"".join(ahead + body for _, ahead, body in held), np.uint8).astype(np.int64)
    size = np.array([len(body) for _, _, body in held])
    piece = np.repeat(np.arange(len(held)), size)
    at = np.arange(len(piece)) + (piece + 1) * ORDER
    gram = data[at]
    for k in range(1, ORDER + 1):
        gram = gram | data[at - k] << 8 * k
    return np.array([k for k, _, _ in held])[piece], gram


def _mask(k: int) -> int:
    """The bits of a byte and its ``k`` predecessors."""
    return (1 << 8 * (k + 1)) - 1


def _keys(held) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For each byte its url, and for each order the keys of its context and of both together."""
    owner, gram = _grams(held)
    return owner, [((gram & _mask(k)) >> 8, gram & _mask(k)) for k in range(ORDER + 1)]


class Counts:
    """How often each key was seen, in two sorted arrays."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.float32)

    def add(self, keys: np.ndarray) -> None:
        each, n = np.unique(keys, return_counts=True)
        both = np.concatenate([self.keys, each])
        self.keys, where = np.unique(both, return_inverse=True)
        self.n = np.bincount(where, np.concatenate([self.n, n.astype(np.float32)]), len(self.keys)).astype(np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], np.float32(0))


class MarkovModel:
    """Counts of contexts and of bytes after contexts, a pair for each order: the model of urls at hand; tests hold the tables against it."""

    def __init__(self):
        self.tables = [(Counts(), Counts()) for _ in range(ORDER + 1)]

    def add(self, urls: list[bytes]) -> MarkovModel:
        for held in _pieces(urls):
            for (context, after), keys in zip(self.tables, _keys(held)[1], strict=True):
                context.add(keys[0])
                after.add(keys[1])
        return self

    def log_likelihood(self, keys) -> np.ndarray:
        """Of each byte."""
        p = np.full(len(keys[0][0]), 1 / 256)
        for (context, after), (c, a) in zip(self.tables, keys, strict=True):
            p = (after.of(a) + LEAN * p) / (context.of(c) + LEAN)
        return np.log(p)


def normalised_ratio(good: MarkovModel, bad: MarkovModel, urls: list[bytes]) -> np.ndarray:
    out = np.zeros(len(urls))
    for held in _pieces(urls):
        owner, keys = _keys(held)
        out += np.bincount(owner, good.log_likelihood(keys) - bad.log_likelihood(keys), len(urls))
    return out / np.array([len(u) + 1 for u in urls]) if urls else out


def calibrate(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold (scores at or above it are allowed) with the best mean of both classes' accuracy."""
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(np.r_[good, bad])
    cuts = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    right = (len(good) - np.searchsorted(np.sort(good), cuts)) * len(bad) + np.searchsorted(np.sort(bad), cuts) * len(good)
    best = np.flatnonzero(right == right.max())
    return float(cuts[best[len(best) // 2]])


def fit(allowed: list[bytes], blocked: list[bytes]) -> tuple[MarkovModel, MarkovModel, float]:
    """Models on four fifths of each class (by place), the threshold on the rest."""
    seen = [[u for i, u in enumerate(x) if i % 5] for x in (allowed, blocked)]
    kept = [[u for i, u in enumerate(x) if i % 5 == 0] for x in (allowed, blocked)]
    good, bad = MarkovModel().add(seen[0]), MarkovModel().add(seen[1])
    if not seen[0] or not seen[1]:
        return MarkovModel(), MarkovModel(), 0.0
    return good, bad, calibrate(*(normalised_ratio(good, bad, x) for x in kept))


def count_grams(urls: DataFrame) -> DataFrame:
    """(gram, n, a, b) of urls (u, w): how often in those of w = 0, 1 and 2."""

    def run(batches):
        for batch in batches:
            w = batch.column(1).to_numpy(zero_copy_only=False)
            for held in _pieces(batch.column(0).to_pylist()):
                owner, gram = _grams(held)
                each, at = np.unique(gram, return_inverse=True)
                n = [np.bincount(at, w[owner] == k, len(each)).astype(np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(each), *map(pa.array, n)], names=["gram", "n", "a", "b"])

    return urls.select("u", "w").mapInArrow(run, "gram long, n long, a long, b long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in "nab"])


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(gram, n, f): what a gram adds to the log ratio of model a to model b."""
    made = None
    for k in range(ORDER + 1):
        level = grams.groupBy(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(*[F.sum(c).alias(c) for c in "nab"])
        context = Window.partitionBy(F.shiftright("key", 8))
        level = level.select("key", *"nab", *[F.sum(c).over(context).alias("all_" + c) for c in "ab"], F.col("key").bitwiseAND(F.lit(_mask(k - 1))).alias("low"))
        level = level.select("*", *[F.lit(1 / 256).alias("p_" + c) for c in "ab"]) if made is None else level.join(made, "low")
        made = level.select(F.col("key").alias("low"), *[((F.col(c) + LEAN * F.col("p_" + c)) / (F.col("all_" + c) + LEAN)).alias("p_" + c) for c in "ab"], *["n"] * (k == ORDER))
    return made.select(F.col("low").alias("gram"), "n", (F.log("p_a") - F.log("p_b")).alias("f"))


@dataclass
class Ratios:
    """Sorted grams with their ratios to broadcast, and a table (gram, f) of all others, if there are."""

    grams: np.ndarray
    f: np.ndarray
    rest: DataFrame | None = None

    @classmethod
    def of(cls, table: DataFrame) -> Ratios:
        """The most frequent grams of a written (gram, n, f) are broadcast: from a power of two on, so that a gram of the rest is in few urls."""
        size = F.length(F.bin("n"))
        least, have = 65, 0
        for e, n in sorted(table.groupBy(size).count().collect(), reverse=True):
            have += n
            if have > HOT:
                break
            least = e
        else:
            least = 0
        hot = table.where(size >= least).select("gram", "f").toArrow()
        gram, f = hot.column("gram").to_numpy(), hot.column("f").to_numpy()
        order = np.argsort(gram)
        return cls(gram[order], f[order], table.where(size < least).select("gram", "f") if least else None)

    def score(self, df: DataFrame, url_col: str, name: str) -> DataFrame:
        """``df`` with a column ``name`` for the score; urls that are null or have no ``://`` score 0."""
        held, cols = df.sparkSession.sparkContext.broadcast((self.grams, self.f)), df.columns
        rest, size, row = (free_name([*cols, name], c) for c in ("rest", "size", "row"))
        split = self.rest is not None

        def run(batches):
            grams, f = held.value
            for batch in batches:
                given = batch.column(len(cols)).to_pylist()
                urls, mine = [], []
                for i, x in enumerate(given):
                    if x is not None and b"://" in x:
                        urls.append(x)
                        mine.append(i)
                s, others = np.zeros(len(urls)), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for part in _pieces(urls):
                    owner, gram = _grams(part)
                    at = np.minimum(np.searchsorted(grams, gram), max(0, len(grams) - 1))
                    hit = grams[at] == gram if len(grams) else np.zeros(len(gram), bool)
                    s += np.bincount(owner[hit], f[at[hit]], len(urls))
                    if split:
                        others.append((owner[~hit], gram[~hit]))
                total, n = np.zeros(len(given)), np.ones(len(given), np.int64)
                total[mine], n[mine] = s, [len(u) + 1 for u in urls]
                if not split:
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(total / n)], names=[*cols, name])
                    continue
                of = np.array(mine, np.int64)[np.concatenate([o for o, _ in others])]
                ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(given)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([g for _, g in others])))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(total), pa.array(n), lists], names=[*cols, name, size, rest])

        schema = df.limit(0).withColumn(name, F.lit(0.0))
        if split:
            schema = schema.withColumn(size, F.lit(0).cast("long")).withColumn(rest, F.lit(None).cast("array<long>"))
        made = df.select("*", F.col(url_col).cast("string").cast("binary").alias(free_name(cols, "u"))).mapInArrow(run, schema.schema)
        if not split:
            return made
        made = stash(made.withColumn(row, F.monotonically_increasing_id()), "scored")
        pairs = made.select(row, F.explode(rest).alias("gram")).join(self.rest, "gram")
        more = pairs.groupBy(F.col(row).alias("_of")).agg(F.sum("f").alias("_more"))
        both = made.join(more, made[row] == more["_of"], "left")
        return both.select(*[made[c] for c in cols], ((made[name] + F.coalesce(more["_more"], F.lit(0.0))) / made[size]).alias(name))


def threshold(scores: DataFrame) -> float:
    """``calibrate`` over a table (good, score) of any size."""
    good = F.col("good").cast("long")
    each = scores.groupBy("score").agg(F.sum(good).alias("g"), F.sum(1 - good).alias("b"))
    each = stash(each.repartitionByRange("score").withColumn("cell", F.spark_partition_id()), "scores")
    ahead, g, b, last = [], 0, 0, None
    for cell, dg, db, top in sorted(each.groupBy("cell").agg(F.sum("g"), F.sum("b"), F.max("score")).collect()):  # a row for each partition
        ahead.append((cell, g, b, last))
        g, b, last = g + dg, b + db, top
    if not g or not b:
        drop(each)
        return 0.0
    cells = F.broadcast(scores.sparkSession.createDataFrame(ahead, "cell int, ahead_g long, ahead_b long, ahead_score double"))
    own = Window.partitionBy("cell").orderBy("score")
    below = own.rowsBetween(Window.unboundedPreceding, -1)
    under = lambda c: F.col("ahead_" + c) + F.coalesce(F.sum(c).over(below), F.lit(0))
    before = F.coalesce(F.lag("score").over(own), F.col("ahead_score"))
    cuts = each.join(cells, "cell").select(F.coalesce((F.col("score") + before) / 2, F.col("score") - 1).alias("cut"), ((g - under("g")) * b + under("b") * g).alias("right"))
    cuts = stash(cuts.unionByName(scores.sparkSession.createDataFrame([(last + 1, g * b)], "cut double, right long")), "cuts")
    best = cuts.where(F.col("right") == cuts.agg(F.max("right")).first()[0])
    found = best.orderBy("cut").offset(best.count() // 2).first()[0]
    drop(each, cuts)
    return found


def fit_tables(urls: DataFrame, sample: int | None = None) -> tuple[Ratios, float]:
    """Ratios and threshold from all urls (u binary, v: the rules' verdict or null); the models see four fifths of each class.

    With ``sample`` only about so many of the different urls that rules decide, picked by a hash.
    """
    ruled = urls.where("v is not null").distinct()
    if sample is not None:
        ruled = ruled.where(F.pmod(F.xxhash64("u"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, ruled.count()))))
    ruled = stash(rank_within(ruled, ["v"], [F.crc32("u"), F.col("u")], "i"), "urls")
    fitted = F.col("i") % 5 != 0
    table, cut = Ratios(np.zeros(0, np.int64), np.zeros(0)), 0.0
    if ruled.where(fitted).select("v").distinct().count() == 2:
        every = urls.select("u", F.lit(0).alias("w"))
        grams = stash(count_grams(every.unionByName(ruled.where(fitted).select("u", F.when(F.col("v") == "allow", 1).otherwise(2).alias("w")))), "grams")
        table = Ratios.of(stash(gram_ratios(grams), "ratios"))
        cut = threshold(table.score(ruled.where(~fitted).select(F.col("u").alias("url"), (F.col("v") == "allow").alias("good")), "url", "score"))
        drop(grams)
    drop(ruled)
    return table, cut


def judge(df: DataFrame, url_col: str = "url", rules=RULES, sample: int | None = None, out: str = "url_filter") -> DataFrame:
    """``df`` with a struct ``out`` (or a free name like it, the last column): host, path, rule, verdict and score."""
    out = free_name(df.columns, out)
    small_batches(df.sparkSession)
    host, path = host_path(F.col(url_col))
    u = F.col(url_col).cast("string")
    table, cut = fit_tables(df.where(F.locate("://", u) > 0).select(u.cast("binary").alias("u"), longest_rule(host, path, rules)["verdict"].alias("v")), sample)
    s = free_name(df.columns, "score")
    scored = table.score(df, url_col, s)
    r = free_name(scored.columns, "r")
    scored = scored.withColumn(r, longest_rule(host, path, rules))
    verdict = F.coalesce(F.col(r)["verdict"], F.when((F.col(s) >= cut) | (F.col(s) == 0.0), F.lit("allow")).otherwise(F.lit("block")))
    return scored.withColumn(out, F.struct(host.alias("host"), path.alias("path"), F.col(r)["rule"].alias("rule"), verdict.alias("verdict"), F.col(s).alias("score"))).drop(r, s)


def hash_order(u: str) -> tuple[int, str]:
    """An order of urls that doesn't follow their spelling, the same everywhere."""
    import zlib

    return zlib.crc32(u.encode()), u
