"""Commands: index, search, explain, stats, score, scores, recheck, ingest."""

from __future__ import annotations

import argparse
import sys
import time

from .errors import SondeError
from .operators.embed import HashEmbedder, OnnxEmbedder
from .operators.fusion import SearchOptions
from .plans import reports
from .plans.indexer import Indexer
from .plans.methods import load_or_create
from .plans.search import Searcher
from .plans.store import Store
from .session import build_session
from .streaming.ingest import start_ingest


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sonde", description=__doc__)
    out.add_argument("--store", default=".sonde-index")
    out.add_argument("--embedder", choices=["onnx", "hash", "none"], default="onnx", help="onnx reads SONDE_MODEL_DIR; without it search is sparse")
    commands = out.add_subparsers(dest="command", required=True)
    c = commands.add_parser("index")
    c.add_argument("root")
    c.add_argument("--reindex", action="store_true")
    c.add_argument("--exclude", action="append", default=[])
    c = commands.add_parser("search")
    c.add_argument("query", nargs="?", default="")
    c.add_argument("--like")
    c.add_argument("--mode", default="hybrid")
    c.add_argument("--top-k", type=int, default=10)
    c.add_argument("--tier", type=int, choices=[1, 2, 3])
    c.add_argument("--ext")
    c.add_argument("--max-per-file", type=int, default=3)
    c.add_argument("--output", default="table")
    commands.add_parser("explain").add_argument("path")
    commands.add_parser("stats")
    commands.add_parser("score").add_argument("--rescore", action="store_true")
    c = commands.add_parser("scores")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("--flagged", action="store_true")
    c.add_argument("--tier", type=int, choices=[1, 2, 3])
    commands.add_parser("recheck").add_argument("--dry-run", action="store_true")
    c = commands.add_parser("ingest")
    c.add_argument("folder")
    c.add_argument("--batch", type=int, default=128)
    c.add_argument("--follow", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("sonde-cli", master="local[*]", partitions=8)
    store = Store(spark, args.store)
    embedder = {"onnx": OnnxEmbedder.from_env, "hash": HashEmbedder, "none": lambda: None}[args.embedder]()
    indexer = Indexer(store, embedder, methods=load_or_create(args.store))
    began = time.time()
    try:
        if args.command == "index":
            print(indexer.index_root(args.root, args.reindex, tuple(args.exclude)), reports.elapsed(time.time() - began))
        elif args.command == "search":
            options = SearchOptions(args.mode, args.top_k, args.tier, max_per_file=args.max_per_file, ext_filter=args.ext)
            searcher = Searcher(store, embedder)
            if args.like:
                with open(args.like, "rb") as f:
                    hits = searcher.like(f.read(), args.like, options)
            else:
                hits = searcher.search(spark.createDataFrame([(0, args.query)], "query_id long, query string"), options)
            print(reports.render(hits, args.output))
        elif args.command == "explain":
            print(reports.explain_report(Searcher(store, embedder).explain(args.path)))
        elif args.command == "stats":
            print(reports.stats_report(store.table("files"), store.table("chunks"), store.table("edges")))
        elif args.command == "score":
            indexer.score(args.rescore)
        elif args.command == "scores":
            print(reports.scores_report(store.table("chunks"), store.table("files"), args.limit, args.flagged, args.tier))
        elif args.command == "recheck":
            tally, counts = indexer.recheck(args.dry_run)
            print("\n".join(f"{r['old']} -> {r['new']}: {r['files']}" for r in tally.collect()) or "No drift.", counts)
        elif args.command == "ingest":
            start_ingest(spark, args.folder, indexer, f"{args.store}/checkpoint", f"{args.store}/bad", args.batch, not args.follow).awaitTermination()
    except SondeError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
