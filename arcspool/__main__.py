"""``python -m arcspool PCT FILE``: encode a hypergraph file, report sizes and times, run the algorithms and verify the decoding.

``--log DIR`` appends the report as a Parquet row, so that runs over several
percentages gather in one table. A percentage that isn't a number counts as 0.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arcspool.operators.bfs import bfs
from arcspool.operators.decode import sum_check
from arcspool.operators.kcore import core_numbers
from arcspool.operators.pagerank import pagerank
from arcspool.sources.text_format import read_adjacency_hypergraph


def percent(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        return 0.0


def report(spark: SparkSession, pct: float, path: str, sources=range(5), k_max: int = 5, iters: int = 20) -> dict:
    """Sizes in KB and seconds of each part."""
    out: dict = {"pct": pct, "path": path}

    def timed(name, f):
        began = time.perf_counter()
        made = f()
        out[f"{name}_s"] = round(time.perf_counter() - began, 3)
        return made

    graph = timed("load", lambda: read_adjacency_hypergraph(spark, path))
    encoded = timed("encode", lambda: graph.encode(pct))
    stats = encoded.stats().first()
    out |= {"content_kb": stats.content_kb, "tree_kb": stats.tree_kb, "total_kb": stats.total_kb}
    for mode, g in (("encoded", encoded), ("raw", graph)):
        starts = [s for s in sources if s < g.merged()[2]]
        timed(f"bfs_{mode}", lambda g=g, starts=starts: bfs(g, starts).agg(F.count("dist")).first())
        timed(f"kcore_{mode}", lambda g=g: core_numbers(g, k_max).agg(F.sum("core")).first())
        timed(f"pagerank_{mode}", lambda g=g: pagerank(g, iters).agg(F.sum("pr")).first())
    check = timed("decode", lambda: sum_check(encoded.decode(), graph.side(positions=False).arcs).first())
    out["verified"] = check["diff"] == 0
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="arcspool", description=__doc__.split("\n")[0])
    p.add_argument("pct", type=percent, help="share of symbols with Huffman codes, in percent")
    p.add_argument("file")
    p.add_argument("--log", help="folder of a Parquet table to append the report to")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("arcspool").getOrCreate()
    found = report(spark, args.pct, args.file)
    for k, v in found.items():
        print(f"{k}: {v}")
    if args.log:
        spark.createDataFrame([found]).write.mode("append").parquet(args.log)
    return 0 if found["verified"] else 1


if __name__ == "__main__":
    raise SystemExit(main())
