"""python -m lumenflow info|search ROOT ...: a small command line over a library."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenflow")
    commands = parser.add_subparsers(dest="command", required=True)
    info = commands.add_parser("info", help="videos and their statistics")
    search = commands.add_parser("search", help="moments near a query vector")
    for c in (info, search):
        c.add_argument("root")
        c.add_argument("--json", action="store_true")
    search.add_argument("vector", help="comma-separated numbers")
    search.add_argument("-k", type=int, default=20)
    search.add_argument("--video")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .library import Library

    library = Library(SparkSession.builder.appName("lumenflow").getOrCreate(), args.root)
    try:
        df = library.stats() if args.command == "info" else library.search_all([float(x) for x in args.vector.split(",")], args.k, args.video)
        for row in df.toJSON().toLocalIterator():
            print(row if args.json else "  ".join(f"{k}={v}" for k, v in json.loads(row).items()))
    except (ValueError, LookupError) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
