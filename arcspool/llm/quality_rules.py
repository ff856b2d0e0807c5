"""Quality rules: a threshold table compiled into one projection.

Each rule compares a measure of the whole text with a bound. All measures and
verdicts are built-in expressions, so the operator is a map over the scan: no
shuffle, no user function, and memory bounded by the row being read.

Defined results: a null text counts as empty (no words; base_failed); an empty
table gives an empty table; repeated rows are judged each on its own; input
columns beside the text are passed through and may have any name, as measures are
kept in one struct, the last column, whose name gets underscores in front where
the input has such a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspool.llm.exprs import free_name, let, spaced, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were with you "
    "das dem den der des die ein eine für im ist mit nicht sich und von zu auf "
    "au aux avec ce dans des du elle en est et il la le les par pas pour que qui sur un une "
    "al como con de del el es esta las lo los no para por se su una y"
).split()

#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``measure`` must be at least ``low`` and at most ``high`` (None: unbounded)."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. Measures: see ``ratios``.
RULES = (
    Rule("words", low=20),
    Rule("mean_word_chars", low=2.0, high=15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_share", low=0.03),
    Rule("dup_line_share", high=0.5),
    Rule("words_per_line", low=2.0),
)


def _repeat_words(ws: Column, n: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more; windows are compared by 64-bit hashes.

    Only a text whose window hashes aren't all different pays for the sort by
    (hash, position) that tells which windows repeat and the sweep over them.
    """
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def sweep(p: Column) -> Column:
            again = F.filter(p, lambda x, k: F.coalesce(x["h"] == F.get(p, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, k + 1)["h"], F.lit(False)))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(starts, lambda s: F.aggregate(
                F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
                F.lit(0), lambda acc, x: acc + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, sweep))

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """A struct of counts over the whole ``text``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    whole = F.coalesce(text, F.lit(""))
    bare = whole
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.replace(spaced(x), F.lit(" "), F.lit(""))) > 0)

    def of(ws: Column) -> Column:
        n = F.size(ws)
        line_counts = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
        return let(line_counts, lambda lc: F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(bare)).cast("long").alias("n_symbols"),
            lc["n"].cast("long").alias("n_lines"),
            lc["dup"].cast("long").alias("n_dup_lines"),
            _repeat_words(ws, n).cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        ))

    return let(words(text), of)


def ratios(m: Column) -> dict[str, Column]:
    """The measures that rules may name, from a struct of ``measures``; a text without words has ratios of 0."""
    per = lambda a, b: F.coalesce(m[a] / F.nullif(m[b], F.lit(0)), F.lit(0.0))
    return {
        "words": m["n_words"],
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "words_per_line": per("n_words", "n_lines"),
    }


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression: every rule holds. No rules: true."""
    by, out = ratios(m), F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (by[r.measure] >= r.low)
        if r.high is not None:
            out = out & (by[r.measure] <= r.high)
    return out


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "quality") -> DataFrame:
    """``df`` with a struct ``out`` (or a free name like it) of all measures, base_failed and kept."""
    out = free_name(df.columns, out)
    m = free_name(df.columns, "m")
    seen = df.withColumn(m, measures(df[text]))
    base = (F.col(m)["n_words"] < 20) | (100 * F.col(m)["n_repeat_words"] > 30 * F.col(m)["n_words"])
    return seen.withColumn(out, F.struct(F.col(f"`{m}`.*"), base.alias("base_failed"), (~base & compile_rules(F.col(m), rules)).alias("kept"))).drop(m)


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with its columns."""
    q = free_name(df.columns, "q")
    return judge(df, text, rules, q).where(F.col(q)["kept"]).drop(q)
