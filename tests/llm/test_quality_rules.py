import re

from arcspool.llm import quality_rules as Q
from arcspool.llm.queries import op7_quality_rules


def slow(text):
    text = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op7_quality_rules(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(docs[r.doc_id])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert all(r.kept for r in good)
    bad = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in bad) < 0.1 * len(bad)


def test_edges(spark):
    phrase = "one two three four five six seven eight "
    texts = [None, "", " \n\t", "a\x0bb\x0cc\rd", "\n\n x \n x \n x", phrase, phrase * 2, phrase + "nine " + phrase, "w " * 9, "é ü # * | <>", "x" * 100_000, "the of and " * 8000]
    df = spark.createDataFrame([(t, 1, "m") for t in texts], "text string, m int, quality string")
    got = Q.judge(df, out="q").collect()
    assert [(r.q.n_words, r.q.word_chars, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words, r.q.base_failed) for r in got] == [slow(t) for t in texts]
    assert not any(r.q.kept and r.q.base_failed for r in got)
    assert Q.apply_rules(df).columns == df.columns and Q.apply_rules(df.limit(0)).count() == 0


def test_columns_of_the_same_name_stay(spark):
    df = spark.createDataFrame([("the word", "mine", 1)], "text string, quality string, m int")
    made = Q.judge(df)
    assert made.columns == ["text", "quality", "m", "_quality"]
    assert made.first()["quality"] == "mine" and made.first()["_quality"].n_words == 2


def test_rules_compile(spark):
    df = spark.createDataFrame([("the word " * 20,), ("# " * 30,)], "text string")
    kept = lambda *rules: [r.q.kept for r in Q.judge(df, rules=rules, out="q").collect()]
    assert kept() == [False, False]  # both repeat themselves
    m = df.select(Q.measures(df["text"]).alias("m"))
    both = m.select(Q.compile_rules(m["m"], (Q.Rule("symbols_per_word", high=0.5),)).alias("k"), Q.compile_rules(m["m"], ()).alias("all")).collect()
    assert [tuple(r) for r in both] == [(True, True), (False, True)]
