"""Reports: listings, trees and explorations as text. Inputs are bounded by their own limits before they are collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.functions.text import explore_budget
from graphloom.operators import context, stats

MAX_CHARS = 15_000


def truncated(text: str, most: int = MAX_CHARS) -> str:
    """At most so many characters, cut at the last line end in the last fifth if there is one."""
    if len(text) <= most:
        return text
    cut = text.rfind("\n", int(most * 0.8), most)
    return text[: cut if cut > 0 else most] + "\n\n... (output truncated)"


def numbered(code: str, first: int) -> str:
    """Lines of code with their numbers."""
    return "\n".join(f"{first + k}\t{line}" for k, line in enumerate(code.split("\n")))


def size_text(size: int) -> str:
    for unit, width in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if size >= width:
            return f"{size / width:.1f} {unit}"
    return f"{size} B"


def file_tree(paths: Sequence[str], depth: int | None = None) -> str:
    """Paths as an indented tree, directories first."""
    root: dict = {}
    for path in paths:
        at = root
        for part in path.split("/")[:-1]:
            at = at.setdefault(part + "/", {})
        at[path.rsplit("/", 1)[-1]] = None
    out: list[str] = []

    def show(at: dict, level: int) -> None:
        if depth is not None and level >= depth:
            return
        for name in sorted(at, key=lambda n: (at[n] is None, n)):
            out.append("  " * level + name)
            if at[name] is not None:
                show(at[name], level + 1)

    show(root, 0)
    return "\n".join(out)


def file_listing(files: DataFrame, prefix: str = "", form: str = "flat", limit: int = 500) -> str:
    """Files below a prefix: flat, as a tree, or grouped by language, with the number of those left out."""
    found = files.filter(F.col("path").startswith(prefix)) if prefix else files
    if form == "grouped":
        return "\n".join(f"{r['language'] or 'unknown'}: {r['files']} files, {size_text(r['bytes'] or 0)}" for r in stats.files_by_language(found).collect())
    rows = [r["path"] for r in found.select("path").orderBy("path").limit(limit + 1).collect()]
    shown = rows[:limit]
    text = file_tree(shown) if form == "tree" else "\n".join(shown)
    return text + (f"\n... and {found.count() - limit} more" if len(rows) > limit else "")


def cluster_text(rows: DataFrame, sources: DataFrame, gap: int, most_chars: int) -> DataFrame:
    """Clusters of near symbols with their code, best first within a budget of characters a file: (file_path, first_line, code).

    Symbols have an importance; a cluster ranks by its greatest importance, then by symbols, then by shorter span. The
    budget stops at the first cluster of a file that does not fit.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    fresh = F.when(F.col("start_line") <= F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1)) + gap, 0).otherwise(1)
    islands = rows.withColumn("__fresh", fresh).withColumn("island", F.sum("__fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("file_path", "island").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.max("importance").alias("importance"), F.count("*").alias("symbols"))
    coded = merged.join(sources.select(F.col("path").alias("file_path"), "content"), "file_path").withColumn("code", fx.source_lines(F.col("content"), F.col("first_line"), F.col("last_line"))).drop("content")
    rank = W.partitionBy("file_path").orderBy(F.desc("importance"), F.desc("symbols"), F.col("last_line") - F.col("first_line"), "first_line").rowsBetween(W.unboundedPreceding, 0)
    return coded.withColumn("__upto", F.sum(F.length("code")).over(rank)).filter(F.col("__upto") <= most_chars).select("file_path", "first_line", "last_line", "symbols", "code")


def explore(question: str, nodes: DataFrame, edges: DataFrame, sources: DataFrame, files: int, most_files: int = 8) -> str:
    """An exploration: symbols of a question by file, the best files with their code in clusters, and how they relate."""
    chars = explore_budget(files)[1]
    found = context.relevant(nodes, edges, question, limit=8, depth=3, most=200, least_score=0.2)
    near = found.edges.filter("kind <> 'contains'")
    touched = found.nodes.filter("role = 'entry'").select("id").join(near.select(F.col("source").alias("id"), F.col("target").alias("other")).unionAll(near.select(F.col("target").alias("id"), F.col("source").alias("other"))), "id").select(F.col("other").alias("id")).distinct()
    roles = found.nodes.join(touched.withColumn("__n", F.lit(1)), "id", "left").withColumn("importance", F.when(F.col("role") == "entry", 10).when(F.col("__n") == 1, 3).otherwise(1)).drop("__n")
    scores = roles.groupBy("file_path").agg(F.sum("importance").alias("score"), F.count("*").alias("symbols"))
    top = [r["file_path"] for r in scores.filter("score >= 3").orderBy(fx.is_test_path(F.col("file_path")), F.desc("score"), F.desc("symbols"), "file_path").limit(most_files).collect()]
    out = [f"# {question}", ""]
    wanted = roles.filter(F.col("file_path").isin(top) & (F.col("kind") != "file"))
    code = cluster_text(wanted, sources, 8, chars // max(len(top), 1)).collect()
    names = {r["id"]: r["name"] for r in roles.select("id", "name").collect()}
    for path in top:
        out += [f"## {path}", ""]
        for r in sorted((r for r in code if r["file_path"] == path), key=lambda r: r["first_line"]):
            out += ["```", numbered(r["code"], r["first_line"]), "```", ""]
    links = near.orderBy("kind", "source", "target").limit(60).collect()
    if links:
        out += ["## Relationships", ""] + [f"- {names.get(e['source'], e['source'])} {e['kind']} {names.get(e['target'], e['target'])}" for e in links]
    return truncated("\n".join(out), chars)
