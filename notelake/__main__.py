"""Command line: index a folder, search it, show its status, print lines of a file."""

from __future__ import annotations

import argparse
import json
import logging
import sys


def _rerank_k(text: str) -> int | str:
    if text == "auto":
        return text
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("a number of at least 1, or auto")
    return int(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notelake")
    p.add_argument("--vault")
    p.add_argument("--store")
    p.add_argument("--log-level")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--rerank-k", type=_rerank_k, default=20)
    s.add_argument("--no-rerank", action="store_true")
    s.add_argument("--tags", nargs="*", default=[])
    s.add_argument("--folder")
    s.add_argument("--title-weight", type=float, default=1.5)
    s.add_argument("--expand", action="store_true")
    s.add_argument("--json", action="store_true")
    i = sub.add_parser("index")
    i.add_argument("path", nargs="?")
    t = sub.add_parser("status")
    t.add_argument("--json", action="store_true")
    g = sub.add_parser("get")
    g.add_argument("path")
    g.add_argument("-l", "--lines", type=int, dest="count")
    g.add_argument("-C", "--context", type=int)
    e = sub.add_parser("evaluate")
    e.add_argument("queries")
    e.add_argument("--config", choices=["A", "C"], default="A")
    e.add_argument("--out")
    return p


def checked(p: argparse.ArgumentParser, args: argparse.Namespace) -> argparse.Namespace:
    """Path and line of a window, and options that exclude one another."""
    if args.command == "get":
        head, _, tail = args.path.rpartition(":")
        args.path, args.line = (head, int(tail)) if head and tail.isdigit() else (args.path, None)
        if args.context is not None and args.line is None:
            p.error("--context needs PATH:LINE")
        if args.context is not None and args.count is not None:
            p.error("--lines and --context exclude one another")
        if any(x is not None and x < 0 for x in (args.count, args.context)):
            p.error("--lines and --context are at least 0")
    return args


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = checked(p, p.parse_args(argv))
    from notelake.config import Config

    config = Config.from_env(vault=args.vault, store=args.store, log_level=args.log_level)
    logging.basicConfig(level=config.log_level.upper(), format="%(asctime)s %(name)s %(levelname)s %(message)s", stream=sys.stderr)
    from pyspark.sql import SparkSession

    from notelake import api
    from notelake.sources import vault

    spark = SparkSession.builder.appName("notelake").getOrCreate()
    if args.command == "index":
        print(json.dumps(api.index(spark, config.vault, config.store, args.path)))
    elif args.command == "status":
        print(api.status_json(spark, config.vault, config.store) if args.json else "\n".join(f"{k}: {v}" for k, v in api.status(spark, config.vault, config.store).items()))
    elif args.command == "get":
        rows = api.get(spark, config.vault, args.path, args.line, args.count, args.context)
        if rows is None:
            print(f"no such file: {args.path}", file=sys.stderr)
            return 1
        print(rows)
    elif args.command == "evaluate":
        print(json.dumps(api.evaluate(spark, config.store, vault.query_file(spark, args.queries), args.config, config.reranking, args.out)["aggregate"]))
    else:
        print(api.search(spark, config.store, args.query, args.json, config.reranking and not args.no_rerank, top_k=args.top_k, rerank_k=args.rerank_k, tags=tuple(args.tags), folder=args.folder, title_weight=args.title_weight, expand=args.expand))
    return 0


if __name__ == "__main__":
    sys.exit(main())
