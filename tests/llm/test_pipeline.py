import re

import public_tokenizers
from test_packing import check
from test_simhash import classes, slow_simhash

import corpus_pipeline as C
from arcspool.llm import quality_rules as Q


def kept_by_rules(text):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(ws)
    if n < 20:
        return False
    seen = {}
    for i in range(n - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    stop = set(Q.STOP_WORDS)
    m = {"words": n, "mean_word_chars": sum(map(len, ws)) / n, "symbols_per_word": len(re.findall(r"[#*$%&|<>]", text)) / n, "stop_word_share": sum(w in stop for w in ws) / n,
         "dup_line_share": 1 - len(set(lines)) / len(lines), "words_per_line": n / len(lines)}
    return 100 * len(cover) <= 30 * n and all((r.low is None or m[r.measure] >= r.low) and (r.high is None or m[r.measure] <= r.high) for r in Q.RULES)


def test_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    docs = [(d, t) for d, t in docs if kept_by_rules(t)]
    seen, one = set(), []
    for d, t in docs:
        norm = re.sub("[\x20\x09-\x0d]+", " ", t)
        if norm not in seen:
            seen.add(norm)
            one.append((d, t))
    comp = classes([slow_simhash(t) for _, t in one])
    want = {d: t for i, (d, t) in enumerate(one) if comp[i] == i}
    assert check(C.run(spark, sf).collect(), want) > 0.9


def test_stage_columns_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)]
    odd = spark.createDataFrame(rows, docs.schema)
    assert C.quality(spark, odd, sf).count() == 0
    assert C.exact(spark, odd, sf).count() == 1
    assert C.near(spark, odd, sf).count() == 2
    assert C.mix(spark, odd, sf).count() == 3
    assert C.pack(spark, odd, sf).count() == 3
    assert public_tokenizers


def test_mixing_reaches_the_sequences(spark, tmp_path):
    """Each stretch of packed groups holds the sources in the shares of the schedule, not in those of the table."""
    from arcspool.llm import mixing, packing

    rows = [(i, "word " * (5 + i % 7), "en", "a" if i % 10 else "b", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    parts = {r.source: r.mix.parts / 1000 for r in mixing.schedule(docs).collect()}
    C.mix(spark, docs, None).write.parquet(str(tmp_path / "mixed"))
    source = {r[0]: r[3] for r in rows}
    made = packing.pack(packing.file_places(spark.read.parquet(str(tmp_path / "mixed")), "at"), public_tokenizers.path("word_bpe_49k.json"), group_docs=320, place="at").collect()
    for grp in range(4):  # while both sources have documents left
        held = [source[r.id] for r in made if r.sequence_id >> 32 == grp]
        assert len(held) == 320 and abs(held.count("b") - 320 * parts["b"]) <= 16 and parts["b"] > 0.2
    assert len(C.pack(spark, spark.read.parquet(str(tmp_path / "mixed")), None).collect()) == 4000
