"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's target weight is a whole number of ``parts`` of a ``period`` of slots
(all parts sum to the period). Its documents, in an order shuffled by MD5 of the
id, form blocks of ``block_docs``. Block j of a source with weight w = parts /
period is released at floor(j / w) and due at ceil((j + 1) / w); each slot takes
the released block that is due earliest (ties: source order). As the weights sum
to one, every block meets its deadline, so after any number of slots each source
has had within less than one block of its share, for as long as it has blocks.
Slots of a source that has run out stay empty; no row is dropped or repeated.

Block j + parts of a source is due exactly one period after block j, so one
period is scheduled (on the sources alone: one row) and every block reads its
slot from that table of ``period`` rows, the only thing broadcast.

A block's number needs a row's rank within its source. Rows are ranked within
the 4096 buckets that the MD5's first three digits make of each source and the
buckets' counts are summed ahead, so a source with a third of all rows spreads
over all tasks.

Defined results: rows without a source form a source of their own; rows without
an id are placed by a hash of all their columns (maps aside), so many of them
spread like others; rows with equal ids stand next to each other in any order;
rows of a source without parts get null slots; an empty table gives no rows; where
parts are derived, the period is the first multiple of ``period`` that has a slot
for each source (scheduling takes period times sources steps, on the sources
alone). All input columns are kept, whatever their names; the result is one more
struct, the last column, whose name gets underscores in front where the input has
such a column. Rows of one source with one id that isn't null, and rows repeated
whole, are ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcspool.llm.exprs import free_name, let

PERIOD = 1000
BLOCK_DOCS = 16


def _md5(df: DataFrame, id_col: str) -> Column:
    """The MD5 of the id, of a hash of the whole row where the id is null; without null ids only the id is read."""
    known = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    if df.where(F.col(id_col).isNull()).select(id_col).isEmpty():
        return known
    row = [F.col("`" + c.replace("`", "``") + "`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.when(F.col(id_col).isNull(), F.md5(F.concat(F.lit("null "), F.xxhash64(*row).cast("string")))).otherwise(known)


def derived_parts(counts: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, idx, parts) from (source, n): shares in proportion to the square root of n, at least one part each, largest remainders first."""
    every = Window.partitionBy(F.lit(0))
    t = counts.withColumn("r", F.floor(F.sqrt("n") * 1000000).cast("long")).withColumn("total", F.sum("r").over(every)).withColumn("s", F.count("*").over(every))
    t = t.withColumn("free", F.when(F.col("s") <= period, F.lit(period) - F.col("s")).otherwise(F.raise_error(F.lit(f"more than {period} sources; raise period"))))
    t = t.withColumn("q", F.expr("1 + (r * free) div total")).withColumn("rem", F.expr("(r * free) % total"))
    t = t.withColumn("left", F.lit(period) - F.sum("q").over(every)).withColumn("rk", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rem"), F.asc_nulls_first("source"))))
    t = t.withColumn("parts", (F.col("q") + (F.col("rk") <= F.col("left")).cast("int")).cast("long"))
    return t.select("source", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("source"))) - 1).alias("idx"), "parts")


def given_parts(counts: DataFrame, parts: dict) -> DataFrame:
    """(source, idx, parts) from a mapping of sources to parts."""
    of = F.lit(0).cast("long")
    for k, v in parts.items():
        of = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(int(v)).cast("long")).otherwise(of)
    return counts.select("source", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("source"))) - 1).alias("idx"), of.alias("parts"))


def edf_slots(parts: Column, period: int) -> Column:
    """An array over the slots of one period: the position in ``parts`` (an array of longs) that each takes, -1 for none."""
    far = F.lit(1 << 62).cast("long")

    def of(ms: Column) -> Column:
        n = F.size(ms).cast("long")

        def step(acc: Column, t: Column) -> Column:
            def key(a: Column, i: Column) -> Column:
                m = F.get(ms, i)
                due = F.floor(((a + 1) * period + m - 1) / m)
                return F.when((a < m) & (F.floor(a * period / m) <= t), due * n + i).otherwise(far)

            keys = F.transform(acc["alloc"], key)
            chosen = let(keys, lambda ks: F.when(F.array_min(ks) < far, F.array_position(ks, F.array_min(ks)) - 1).otherwise(F.lit(-1)).cast("long"))
            return let(chosen, lambda c: F.struct(
                F.transform(acc["alloc"], lambda a, i: a + F.when(i == c, 1).otherwise(0)).alias("alloc"),
                F.concat(acc["out"], F.array(c)).alias("out")))

        start = F.struct(F.transform(ms, lambda m: F.lit(0).cast("long")).alias("alloc"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long")), start, step)["out"]

    return let(parts, of)


def schedule(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", parts: dict | None = None, period: int = PERIOD, block_docs: int = BLOCK_DOCS, out: str = "mix") -> DataFrame:
    """``df`` with a struct ``out`` (or a free name like it): parts, block, place (in the block), release, due and slot (longs)."""
    if parts is not None and sum(parts.values()) != period:
        raise ValueError(f"parts must sum to the period of {period}")
    out = free_name(df.columns, out)
    md5 = _md5(df, id_col)
    cells = df.select(F.col(source_col).alias("source"), F.substring(md5, 1, 3).alias("bucket")).groupBy("source", "bucket").agg(F.count("*").alias("n"))
    ahead = cells.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = cells.groupBy("source").agg(F.sum("n").alias("n"))
    if parts is None:  # a period that has a part for each source
        period *= max(1, -(-counts.count() // period))
    shares = derived_parts(counts, period) if parts is None else given_parts(counts, parts)

    one = shares.agg(F.array_sort(F.collect_list(F.struct("idx", "source", "parts"))).alias("all")).where(F.size("all") > 0)
    slots = one.select("all", edf_slots(F.transform("all", lambda x: x["parts"]), period).alias("out"))
    slots = slots.select("all", F.posexplode("out").alias("at", "i")).where("i >= 0")
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("at")) - 1)
    k_src, k_bucket, k_md5, k_rank, s_at, s_k, s_src, a_ahead = (free_name(df.columns, x) for x in ("k_src", "k_bucket", "k_md5", "k_rank", "s_at", "s_k", "s_src", "a_ahead"))
    a_src, a_bucket, s_parts, p_src, p_parts = (free_name(df.columns, x) for x in ("a_src", "a_bucket", "s_parts", "p_src", "p_parts"))
    table = slots.select(F.get("all", F.col("i").cast("int"))["source"].alias(s_src), F.col("k").cast("long").alias(s_k), F.col("at").cast("long").alias(s_at))

    # a key that is never null, so that the join below finds the rows as the window has dealt them
    named = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))
    rows = df.withColumn(k_md5, md5).withColumn(k_bucket, F.substring(k_md5, 1, 3)).withColumn(k_src, named(F.col(source_col)))
    rows = rows.withColumn(k_rank, F.row_number().over(Window.partitionBy(k_src, k_bucket).orderBy(k_md5, id_col)) - 1)
    ahead = ahead.select(named(F.col("source")).alias(a_src), F.col("bucket").alias(a_bucket), F.col("ahead").alias(a_ahead))
    rows = rows.join(ahead, (rows[k_src] == ahead[a_src]) & (rows[k_bucket] == ahead[a_bucket]))
    quotas = F.broadcast(shares.select(F.col("source").alias(p_src), F.col("parts").alias(p_parts)))
    rows = rows.join(quotas, rows[source_col].eqNullSafe(quotas[p_src]))
    nth = F.col(a_ahead) + F.col(k_rank)
    block = F.floor(nth / block_docs)
    rows = rows.withColumn(s_parts, block)
    hit = rows.join(F.broadcast(table), rows[source_col].eqNullSafe(table[s_src]) & (F.when(F.col(p_parts) > 0, F.col(s_parts) % F.col(p_parts)) == table[s_k]), "left")
    m, j = F.nullif(F.col(p_parts), F.lit(0)), F.col(s_parts)
    made = F.struct(
        F.col(p_parts).alias("parts"), j.cast("long").alias("block"), (nth % block_docs).cast("long").alias("place"),
        F.floor(j * period / m).cast("long").alias("release"), F.floor(((j + 1) * period + m - 1) / m).cast("long").alias("due"),
        (F.floor(j / m) * period + F.col(s_at)).cast("long").alias("slot"))
    return hit.withColumn(out, made).select(*["`" + c.replace("`", "``") + "`" for c in df.columns], out)


def mixed(df: DataFrame, **how) -> DataFrame:
    """All rows of ``df`` with its columns, in the order of the schedule (rows without a slot last, by their blocks)."""
    m = free_name(df.columns, "mix")
    made = schedule(df, out=m, **how)
    order = [F.col(m)["slot"].asc_nulls_last(), F.col(m)["block"], F.col(m)["place"]]
    return made.repartitionByRange(*order).sortWithinPartitions(*order).drop(m)
