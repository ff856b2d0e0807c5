from arcspool.__main__ import main, percent
from test_core import T


def test_report(spark, tmp_path, capsys):
    f = tmp_path / "t.hyp"
    f.write_text(T)
    for pct in ("40", "100"):
        assert main([pct, f"file://{f}", "--log", f"file://{tmp_path}/log"]) == 0
    said = capsys.readouterr().out
    assert "verified: True" in said and "total_kb: 0" in said
    assert sorted(r.pct for r in spark.read.parquet(f"file://{tmp_path}/log").collect()) == [40.0, 100.0]
    assert percent("x") == 0.0 and percent("1.27") == 1.27
