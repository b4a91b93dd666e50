"""Commands: index, search, select, stats, serve, watch, version."""

from __future__ import annotations

import argparse
import sys

from bundlewright import __version__
from bundlewright.operators.chunking import LINES, OVERLAP
from bundlewright.plans.engine import BUDGET, TOPK, Engine, as_text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bundlewright")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("index", "watch"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--out", default=".bundlewright")
        p.add_argument("--lines", type=int, default=LINES)
        p.add_argument("--overlap", type=int, default=OVERLAP)
        p.add_argument("--ext", default="rs", help="extensions, with commas; empty for all files")
        p.add_argument("--exclude", action="append", default=[])
        if name == "watch":
            p.add_argument("--debounce", type=int, default=500)
    for name in ("search", "select"):
        p = commands.add_parser(name)
        p.add_argument("query")
        p.add_argument("--index", default=".bundlewright")
        p.add_argument("--budget", type=int, default=BUDGET)
        p.add_argument("--topk", type=int, default=TOPK)
        if name == "search":
            p.add_argument("--min-score-ratio", type=float, default=0.0)
    for name in ("stats", "serve"):
        p = commands.add_parser(name)
        p.add_argument("--index", default=".bundlewright")
    commands.add_parser("version")
    return top


def _print(results) -> None:
    for row in as_text(results).orderBy("rank").toLocalIterator():
        print(row["line"])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(__version__)
        return 0
    from pyspark.sql import SparkSession

    from bundlewright.session import local_session

    spark = SparkSession.getActiveSession() or local_session()
    if args.command in ("index", "watch"):
        from bundlewright.streaming.watch import rebuild, watch

        extensions = [x for x in args.ext.split(",")]
        how = dict(extensions=extensions, excludes=args.exclude, lines=args.lines, overlap=args.overlap)
        if args.command == "index":
            rebuild(spark, args.path, args.out, **how)
        else:
            watch(spark, args.path, args.out, f"{args.out}/watch", debounce=f"{args.debounce} milliseconds", **how).awaitTermination()
        return 0
    engine = Engine.load(spark, args.index)
    if args.command == "stats":
        for name, value in engine.index.stats().first().asDict().items():
            print(f"{name}: {value}")
    elif args.command == "serve":  # one request on each line of the input, one response on each of the output
        engine.cache()
        for number, line in enumerate(sys.stdin):
            for row in engine.serve(spark.createDataFrame([(number, line)], "request_id long, line string")).collect():
                print(row["response"], flush=True)
    else:
        queries = spark.createDataFrame([(0, args.query)], "query_id long, query string")
        if args.command == "search":
            _print(engine.search(queries, args.budget, args.topk, args.min_score_ratio))
        else:
            if sys.stdin.isatty():
                print("select reads paths from its input", file=sys.stderr)
                return 2
            paths = sorted({p.strip() for p in sys.stdin} - {""})
            _print(engine.select(queries, spark.createDataFrame([(p,) for p in paths], "file string"), args.budget, args.topk))
    return 0


if __name__ == "__main__":
    sys.exit(main())
