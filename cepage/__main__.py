"""Command line: ``python -m cepage QUERY --data DIR [--out DIR] [--limit N]`` runs one registered query.

``python -m cepage --list`` names them; ``--module NAME`` adds those of a further module. Exit code 2 if any
row of the result has a column ``passed`` that is false, also with ``--out``.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from cepage.session import local_session, ship

PLANS = ["cepage.plans.curation", "cepage.plans.evaluation", "cepage.plans.analytics", "cepage.plans.corpus_queries", "cepage.plans.extensions"]


def registered(more: list[str]) -> dict:
    """All queries of the plans and of further modules that hold a table QUERIES."""
    return {k: f for n in [*PLANS, *more] for k, f in importlib.import_module(n).QUERIES.items()}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cepage", description=__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("--data", help="folder with one Parquet file or folder per table")
    parser.add_argument("--out", help="write Parquet here instead of printing")
    parser.add_argument("--limit", type=int, default=20, help="rows to print")
    parser.add_argument("--cores", default="*", help="cores of a local session")
    parser.add_argument("--master", help="a Spark master; settings such as spark.checkpoint.dir come from its configuration")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--module", action="append", default=[], help="a further module of queries, such as one of an optional subpackage")
    args = parser.parse_args(argv)
    known = registered(args.module)
    if args.list or not args.query:
        print("\n".join(sorted(known)))
        return 0
    if args.query not in known or not args.data:
        parser.error("unknown query or no --data")
    spark = local_session(args.cores) if args.master is None else SparkSession.builder.master(args.master).appName("cepage").getOrCreate()
    ship(spark)
    df = known[args.query](spark, args.data)
    if args.out:
        df.write.mode("errorifexists").parquet(args.out)
        df = spark.read.parquet(args.out)
    else:
        rows = [r.asDict(recursive=True) for r in df.limit(args.limit).collect()]
        print(json.dumps(rows, indent=2, default=str, ensure_ascii=False, sort_keys=True))
    return 2 if "passed" in df.columns and not df.where("not passed").isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
