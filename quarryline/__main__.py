"""python -m quarryline analyze|index|search ..."""

from __future__ import annotations

import argparse
import sys

from quarryline import api, session
from quarryline.operators import search
from quarryline.sources import sinks


def main(argv: list[str]) -> int:
    top = argparse.ArgumentParser(prog="quarryline")
    to = top.add_subparsers(dest="command", required=True)
    a = to.add_parser("analyze")
    a.add_argument("path", nargs="?", default=".")
    a.add_argument("--ci", action="store_true")
    a.add_argument("--fail-on", default="high", choices=["critical", "high", "medium", "low", "any"])
    a.add_argument("--sarif")
    a.add_argument("--json", help="folder for newline-delimited JSON")
    a.add_argument("--quiet", action="store_true")
    i = to.add_parser("index")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--store", required=True)
    i.add_argument("--batch", type=int, default=16)
    s = to.add_parser("search")
    s.add_argument("query", nargs="+")
    s.add_argument("--store", required=True)
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--lang", action="append")
    s.add_argument("--json", action="store_true")
    args = top.parse_args(argv)
    spark = session.local_session()
    session.share_package(spark)
    if args.command == "analyze":
        result = api.analyze(spark, args.path, args.fail_on)
        found = result.findings
        if args.sarif:
            sinks.write_sarif(found, args.sarif)
        if args.json:
            sinks.write_ndjson(found, args.json)
        elif not args.quiet:
            print("\n".join(sinks.table_lines(found)))
            print(f"{result.scanned_files} files scanned" + ", the rest left out" * result.truncated)
        return int(args.ci and result.over)
    if args.command == "index":
        print(api.index_tree(spark, args.path, args.store, batch=args.batch))
        return 0
    got = api.search_store(spark, args.store, " ".join(args.query), args.k, args.lang)
    if args.json:
        print(search.as_json(got, " ".join(args.query), args.k).first()["json"])
    else:
        for r in search.rendered(got).orderBy("rank").collect():
            print(f"{r['rank']}. {r['head']} {r['detail']}\n{r['body']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
