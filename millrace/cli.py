"""Command line: ``python -m millrace.cli search "words" --index PATH [--mode keyword] [--ticker T] [--year Y] [--top-k 5]``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators.search import retrieve


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="ranked search over an index of retrieval rows (Parquet)")
    s.add_argument("query")
    s.add_argument("--index", required=True)
    s.add_argument("--mode", choices=["keyword"], default="keyword", help="vector and hybrid search need an embedding function: use the API")
    s.add_argument("--ticker")
    s.add_argument("--year", type=int)
    s.add_argument("--top-k", type=int, default=5)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    began = time.perf_counter()
    rows = retrieve(spark.read.parquet(a.index), a.query, mode=a.mode, top_k_=a.top_k, ticker=a.ticker, report_year=a.year).orderBy("rank").collect()
    print(f"{len(rows)} results in {time.perf_counter() - began:.2f} s")
    for r in rows:
        print(f"{r['rank']:>3}  {r['score']:.4f}  {r['document_id']}  {r['ticker']} {r['report_year']}  {' '.join((r['text'] or '').split())[:100]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
