"""Tools over standard input and output: one JSON-RPC 2.0 message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from graphloom import __doc__ as about
from graphloom.api import GraphSession
from graphloom.operators.report import truncated

PROTOCOL = "2024-11-05"


def _number(args: dict, name: str, default: int, least: int, most: int) -> int:
    """A bounded argument; anything that is no number is refused."""
    value = args.get(name, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{name} must be a number")
    return int(max(least, min(value, most)))


def _text(args: dict, name: str) -> str:
    value = args.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text")
    return value


def _lines(rows: list, *columns: str) -> str:
    return "\n".join("  ".join(str(r[c]) for c in columns) for r in rows) or "nothing found"


class Tools:
    """The tools of one graph: name, what it does, its arguments, and the function."""

    def __init__(self, graph: GraphSession):
        self.graph = graph
        named = {"symbol": "string"}
        self.all: dict[str, tuple[str, dict, Callable[[dict], str]]] = {
            "search": ("Symbols that match a query", {"query": "string", "limit": "number"}, self.search),
            "context": ("What answers a question, with code", {"task": "string", "maxNodes": "number"}, lambda a: graph.context(_text(a, "task"), _number(a, "maxNodes", 20, 1, 100))),
            "callers": ("Who calls a symbol", named | {"limit": "number"}, lambda a: self.related(a, graph.callers)),
            "callees": ("What a symbol calls", named | {"limit": "number"}, lambda a: self.related(a, graph.callees)),
            "impact": ("What a change of a symbol reaches", named | {"depth": "number"}, self.impact),
            "explore": ("The files of a question, with code", {"query": "string", "maxFiles": "number"}, lambda a: graph.explore(_text(a, "query"), _number(a, "maxFiles", 8, 1, 20))),
            "node": ("Where a symbol is and what it is", named, lambda a: _lines(graph.symbols(_text(a, "symbol")).orderBy("id").limit(10).collect(), "kind", "qualified_name", "file_path", "start_line", "signature", "docstring")),
            "status": ("Counts of symbols, links and files", {}, lambda a: _lines(graph.stats().orderBy("metric", "key").collect(), "metric", "key", "count")),
            "files": ("Files of the project", {"path": "string", "format": "string"}, lambda a: graph.listing(str(a.get("path") or ""), str(a.get("format") or "tree"))),
        }

    def search(self, args: dict) -> str:
        rows = self.graph.search(_text(args, "query"), limit=_number(args, "limit", 10, 1, 100)).collect()
        return _lines(rows, "kind", "name", "file_path", "start_line")

    def related(self, args: dict, find: Callable) -> str:
        found = find(_text(args, "symbol"), _number(args, "limit", 20, 1, 100))
        rows = found.join(self.graph.nodes.withColumnRenamed("id", "node_id"), "node_id").orderBy("file_path", "start_line").collect()
        return _lines(rows, "kind", "name", "file_path", "start_line")

    def impact(self, args: dict) -> str:
        ids = [r["id"] for r in self.graph.symbols(_text(args, "symbol")).select("id").orderBy("id").limit(5).collect()]
        depth, parts = _number(args, "depth", 2, 1, 10), []
        for i in ids:
            found = self.graph.impact(i, depth)
            rows = found.join(self.graph.nodes.withColumnRenamed("id", "node_id"), "node_id").orderBy("depth", "file_path", "name").limit(200).collect()
            parts.append(_lines(rows, "depth", "kind", "name", "file_path"))
        return "\n\n".join(parts) or "nothing found"


def answer(tools: Tools, message: dict) -> dict | None:
    """The reply to one message; none to a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "graphloom", "version": "1"}, "instructions": about}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        shown = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}}} for n, (d, p, _) in tools.all.items()]
        return reply | {"result": {"tools": shown}}
    if method == "tools/call":
        if params.get("name") not in tools.all:
            return reply | {"error": {"code": -32602, "message": f"unknown tool: {params.get('name')}"}}
        try:
            text, failed = truncated(tools.all[params["name"]][2](params.get("arguments") or {})), False
        except Exception as e:  # noqa: BLE001
            text, failed = f"{type(e).__name__}: {e}"[:2000], True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve(graph: GraphSession, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answers until the input ends; a line that is no message gets a parse error."""
    tools = Tools(graph)
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(tools, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a message"}}
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
