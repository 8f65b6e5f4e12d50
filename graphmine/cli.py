"""Command line: ``python -m graphmine.cli -i graph.tsv -s 100 [-d] [-l 5] [-o out]``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from graphmine.plans.mine import mine
from graphmine.sources.exports import pattern_lines, write_patterns
from graphmine.sources.graph import adjacency, read_adjacency


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphmine", description="frequent subgraph mining in one large labelled graph")
    p.add_argument("-i", required=True, metavar="INPUT", help="adjacency text: src, label, then (dst, label, edge label) triples, tab-separated")
    p.add_argument("-s", required=True, type=int, metavar="SUPPORT", help="least support of a pattern (inclusive)")
    p.add_argument("-d", action="store_true", help="directed graph: list out-edges only")
    p.add_argument("-l", type=int, default=100, metavar="EDGES", help="most edges of a pattern")
    p.add_argument("-o", metavar="OUTPUT", help="folder for the patterns")
    p.add_argument("-f", default="text", choices=["text", "parquet", "json"], help="format of the output")
    p.add_argument("-b", action="store_true", help="print no patterns, only their number")
    p.add_argument("-e", type=int, default=100, metavar="N", help="report progress whenever so many patterns more are found")
    p.add_argument("-t", type=int, metavar="THREADS", help="local threads, where no master is set")
    p.add_argument("-p", type=int, metavar="PARTITIONS", help="shuffle partitions")
    p.add_argument("-n", metavar="NODES", help="accepted and left to the cluster manager")
    p.add_argument("-v", action="store_true", help="accepted; counting is always parallel")
    return p


def main(args: list[str] | None = None) -> int:
    o = parser().parse_args(args)
    build = SparkSession.builder.appName("graphmine")
    if o.t:
        build = build.master(f"local[{o.t}]")
    if o.p:
        build = build.config("spark.sql.shuffle.partitions", str(o.p))
    spark = build.getOrCreate()
    began, told = time.time(), 0

    def progress(size: int, n: int) -> None:
        nonlocal told
        if n // o.e > told:
            told = n // o.e
            print(f"{n} patterns of up to {size} edges", file=sys.stderr)

    patterns = mine(adjacency(read_adjacency(spark, o.i), o.d), o.s, o.l, progress).cache()
    if o.o:
        write_patterns(patterns, o.o, o.f)
    if not o.b:
        for row in pattern_lines(patterns).toLocalIterator():
            print(row[0])
    print(f"{patterns.count()} frequent patterns in {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
