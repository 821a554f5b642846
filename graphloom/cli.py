"""Command line: python -m graphloom.cli COMMAND --store FOLDER ..."""

from __future__ import annotations

import argparse
import json
import sys

from graphloom.api import GraphSession
from graphloom.server import serve
from graphloom.session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("command", choices=["index", "sync", "status", "query", "files", "context", "callers", "callees", "impact", "affected", "explore", "serve"])
    parser.add_argument("words", nargs="*", help="a project folder, a query, a symbol or changed paths; affected also reads paths from standard input")
    parser.add_argument("--store", default=".graphloom")
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--depth", type=int, default=5)
    parser.add_argument("--filter", default=None)
    parser.add_argument("--json", action="store_true")
    asked = parser.parse_args(args)
    spark = local_session("graphloom-cli")
    own, text = GraphSession(spark, asked.store), " ".join(asked.words)
    if asked.command in ("index", "sync"):
        print(json.dumps(getattr(own, asked.command)(text or ".")))
        return 0
    if asked.command == "serve":
        serve(own)
        return 0
    if asked.command == "explore":
        print(own.explore(text))
        return 0
    if asked.command == "context":
        print(own.context(text, asked.limit, "json" if asked.json else "markdown"))
        return 0
    changed = asked.words or ([x.strip() for x in sys.stdin if x.strip()] if asked.command == "affected" else [])
    rows = {
        "status": own.stats, "query": lambda: own.search(text, limit=asked.limit).select("kind", "name", "file_path", "start_line", "score"), "files": lambda: own.file_list(text, asked.limit).select("path", "language", "node_count"),
        "callers": lambda: own.callers(text, asked.limit), "callees": lambda: own.callees(text, asked.limit), "impact": lambda: own.impact(text, asked.depth).limit(asked.limit), "affected": lambda: own.affected(changed, asked.depth, asked.filter),
    }[asked.command]().collect()
    for r in rows:
        print(json.dumps(r.asDict(), ensure_ascii=False) if asked.json else "  ".join(str(v) for v in r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
