"""Command line: index, search, doctor and report over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .plans.requests import Search


def main() -> None:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--tables", required=True, help="folder of the project's tables")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("root")
    i.add_argument("--include", action="append", default=[])
    i.add_argument("--exclude", action="append", default=[])
    i.add_argument("--force", action="store_true")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--mode", default="hybrid")
    s.add_argument("--top-k", type=int, default=20)
    s.add_argument("--prefix", default="")
    for name in ("doctor", "report", "repomap"):
        sub.add_parser(name)
    a = p.parse_args()
    engine = Engine(SparkSession.builder.appName("lodestone").getOrCreate(), a.tables)
    if a.command == "index":
        print(engine.index(a.root, a.include, a.exclude, a.force))
    elif a.command == "search":
        got = engine.search(Search(a.query, a.mode, a.top_k, a.prefix))
        got.rows.show(a.top_k, False)
        print(*got.notes, sep="\n")
    elif a.command == "doctor":
        print(*(engine.doctor() or ["all is well"]), sep="\n")
    else:
        print(engine.report() if a.command == "report" else engine.repomap())


if __name__ == "__main__":
    main()
