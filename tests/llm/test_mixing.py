import pytest

from arcspool.llm import mixing as M
from arcspool.llm.queries import op5_mixing


def deviations(rows, parts, period):
    """Most that any source is off its share after any slot while all sources have blocks."""
    by = {}
    for r in rows:
        by.setdefault(r.slot, r.source)
    left = {s: max(r.slot for r in rows if r.source == s) for s in parts}
    worst, have = 0, dict.fromkeys(parts, 0)
    for t in range(min(left.values()) + 1):
        have[by[t]] += 1
        worst = max(worst, max(abs(have[s] - parts[s] * (t + 1) / period) for s in parts))
    return worst


def test_whole_table(spark, sf):
    rows = op5_mixing(spark, sf).collect()
    assert len(rows) == 200 and len({r.doc_id for r in rows}) == 200
    assert all(r.release <= r.slot < r.due for r in rows)
    assert len({(r.slot, r.place) for r in rows}) == 200


@pytest.mark.parametrize("parts", [{"a": 50, "b": 25, "c": 25}, {"a": 67, "b": 32, "c": 1}, {"a": 34, "b": 33, "c": 33}])
def test_deviation_under_one_block(spark, parts):
    rows = [(i, "abc"[i % 3]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = M.schedule(df, parts=parts, period=100, block_docs=2).select("doc_id", "source", "mix.*").collect()
    assert len(got) == 1500 and all(r.release <= r.slot < r.due for r in got)
    assert deviations(got, parts, 100) < 1


def test_edges(spark):
    rows = [(1, None, "x"), (None, None, "y"), (2, "a", "z"), (2, "a", "z"), (3, "zero", "w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, idx string")
    got = M.schedule(df, parts={None: 5, "a": 5}, period=10, block_docs=1).collect()
    assert len(got) == 5 and {r.mix.slot is None for r in got if r.source == "zero"} == {True}
    assert len({r.mix.slot for r in got if r.source != "zero"}) == 4
    back = M.mixed(df)
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert M.mixed(df.limit(0)).count() == 0


def test_more_sources_than_the_period(spark):
    rows = [(i, f"s{i % 1200}") for i in range(1500)]
    got = M.schedule(spark.createDataFrame(rows, "doc_id long, source string")).select("doc_id", "source", "mix.*").collect()
    assert len(got) == 1500 and sum(dict((r.source, r.parts) for r in got).values()) == 2000
    assert all(r.release <= r.slot < r.due for r in got) and len({(r.slot, r.place) for r in got}) == 1500


def test_columns_of_the_same_name_stay(spark):
    rows = [(None if i % 3 else i, "ab"[i % 2], i, f"x{i}") for i in range(60)]  # and most rows without an id
    df = spark.createDataFrame(rows, "doc_id long, source string, mix int, `_Mix` string")
    made = M.schedule(df, parts={"a": 5, "b": 5}, period=10, block_docs=1)
    assert made.columns == [*df.columns, "__mix"]
    got = made.collect()
    assert sorted(tuple(r)[:4] for r in got if r.doc_id is not None) == sorted(r for r in rows if r[0] is not None)
    assert len({r["__mix"].slot for r in got}) == 60 and {r["mix"] for r in got} == set(range(60))


def test_rows_without_an_id_spread(spark):
    rows = [(None, "a", f"text {i}", {"k": i}) for i in range(600)] + [(i, "ab"[i % 2], "t", {}) for i in range(50)] + [(None, "b", "same", {})] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, `a map` map<string,int>")
    assert df.select(M._md5(df, "doc_id").substr(1, 3).alias("b")).where("doc_id is null").distinct().count() > 500
    made = M.schedule(df, parts={"a": 5, "b": 5}, period=10, block_docs=1)
    got = made.collect()
    assert len({r.mix.slot for r in got}) == len(got) == 653 and made.columns == [*df.columns, "mix"]
    for s in "ab":  # blocks without a gap
        assert sorted(r.mix.block for r in got if r.source == s) == list(range(sum(r[1] == s for r in rows)))
    again = M.schedule(df.repartition(3), parts={"a": 5, "b": 5}, period=10, block_docs=1).collect()
    assert {(r.text, r.mix.slot) for r in got if r.text != "t"} == {(r.text, r.mix.slot) for r in again if r.text != "t"}
