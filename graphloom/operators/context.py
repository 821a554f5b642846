"""Context of a question: candidates from several channels, their ranking, the graph around them, and the report."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.functions.text import query_symbols, search_terms, stem_variants
from graphloom.operators import graph, search
from graphloom.session import cut_lineage

#: Kinds worth showing, and kinds that define types.
HIGH_VALUE = "function method class interface struct trait protocol enum type_alias component route module property variable".split()
DEFINITIONS = ["class", "interface", "struct", "trait", "protocol", "enum", "type_alias"]


class Context(NamedTuple):
    """nodes: (*symbol columns, role, score); edges: links among them."""

    nodes: DataFrame
    edges: DataFrame


def candidates(nodes: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """Scored symbols of a question: (id, score, channel exact); best score of all channels.

    Exact names of the question (with co-location), prefixes of title-cased names and word forms, and one search a term,
    where each further term that finds a symbol adds 5. Tests weigh 0.3 unless asked for. With several term groups, two
    or more matched groups raise a score and fewer lower it. Names with a term inside at a word boundary join at the end.
    """
    symbols, terms = query_symbols(query), search_terms(query)
    parts: list[DataFrame] = []
    if symbols:
        exact = search.exact_names(nodes, symbols, limit=limit * 5)
        names = F.size(F.collect_set(F.lower("name")).over(W.partitionBy("file_path")))
        parts.append(exact.withColumn("score", F.col("score") + 20.0 * (names - 1)).select("id", "score", F.lit(1).alias("exact"), F.lit("").alias("term")))
        titled = list(dict.fromkeys(v[:1].upper() + v[1:] for s in symbols for v in [s, *stem_variants(s)] if len(v) >= 3))
        starts = [F.when(F.col("name").startswith(t), 15.0 + F.greatest(F.lit(0.0), 10.0 - (F.length("name") - len(t)) / 3.0)) for t in titled]
        if starts:
            best = F.greatest(*starts) if len(starts) > 1 else starts[0]
            found = nodes.filter(F.col("kind").isin(DEFINITIONS)).withColumn("score", best).filter("score IS NOT NULL")
            parts.append(found.orderBy(F.desc("score"), "id").limit(limit * 3).select("id", "score", F.lit(1).alias("exact"), F.lit("").alias("term")))
    kinds = [k for k in fx.KIND_BONUS if k not in ("import", "export")]
    for term in terms:
        parts.append(search.search(nodes, term, kinds=kinds, limit=limit * 2).select("id", "score", F.lit(0).alias("exact"), F.lit(term).alias("term")))
    if not parts:
        return nodes.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("exact")).limit(0)
    union = reduce(lambda a, b: a.unionAll(b), parts)
    text = F.max(F.when(F.col("exact") == 0, F.col("score"))) + 5.0 * (F.count(F.when(F.col("exact") == 0, 1)) - 1)
    merged = union.groupBy("id").agg(F.greatest(F.max(F.when(F.col("exact") == 1, F.col("score"))), text).alias("score"), F.max("exact").alias("exact"))
    merged = merged.join(nodes.select("id", "name", "file_path"), "id")
    if not any(w in query.lower() for w in ("test", "spec")):
        merged = merged.withColumn("score", F.col("score") * F.when(fx.is_test_path(F.col("file_path")), 0.3).otherwise(1.0))
    groups: list[list[str]] = []
    for term in terms:
        home = next((g for g in groups if any(term in t or t in term for t in g)), None)
        home.append(term) if home else groups.append([term])
    if len(groups) >= 2:
        folders = F.split(F.lower(fx.dirname(F.col("file_path"))), "/")
        hit = [reduce(lambda a, b: a | b, [F.lower("name").contains(t) | F.array_contains(folders, t) for t in g]) for g in groups]
        count = reduce(lambda a, b: a + b, [h.cast("int") for h in hit])
        merged = merged.withColumn("score", F.col("score") * F.when(count >= 2, 1 + 0.5 * count).when(F.col("exact") == 1, 1.0).otherwise(0.6))
    merged = merged.select("id", "score", "exact")
    inside = [fx.camel_boundary(F.col("name"), t).cast("int") for t in search_terms(query, stems=False)]
    if inside:
        hits = reduce(lambda a, b: a + b, inside)
        brevity = F.greatest(F.lit(0.0), 6.0 - F.length("name") / 8.0)
        found = nodes.filter(F.col("kind").isin(HIGH_VALUE)).withColumn("h", hits).filter("h > 0").withColumn("score", (8.0 + brevity) * (1 + F.col("h")) + 30.0 * (F.col("h") - 1))
        camel = found.orderBy(F.desc("score"), "id").limit(limit * 4).select("id", "score", F.lit(0).alias("exact"))
        merged = merged.unionAll(camel.join(merged.select("id"), "id", "left_anti"))
    return merged


def relevant(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 3, depth: int = 1, most: int = 20, least_score: float = 0.3) -> Context:
    """Entry points of a question and what surrounds them, within a number of nodes; empty for a blank question.

    Entry points that are imports or exports give way to what they lead to. Types bring their hierarchy; each entry point
    its neighbours up to its share. Files and test code are capped, so that no file fills the answer.
    """
    if not query.strip():
        empty = nodes.limit(0)
        return Context(empty.withColumns({"role": F.lit("entry"), "score": F.lit(0.0)}), edges.limit(0))
    best = candidates(nodes, query, limit).filter(F.col("score") >= least_score).orderBy(F.desc(F.round("score", 9)), "id").limit(limit * 3)
    found = cut_lineage(best.join(nodes.select("id", "kind"), "id"))
    passing = found.filter("kind IN ('import', 'export')")
    led = passing.join(edges, passing["id"] == edges["source"]).join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("target").alias("id"), "score")
    roots = found.filter("kind NOT IN ('import', 'export')").select("id", "score").unionAll(led).groupBy("id").agg(F.max("score").alias("score"))
    roots = cut_lineage(roots.orderBy(F.desc(F.round("score", 9)), "id").limit(limit))
    share = -(-most // max(roots.count(), 1))
    starts = roots.select(F.col("id").alias("origin"), F.col("id").alias("node_id"))
    around = graph.reach(edges, starts, depth, direction="both", through=nodes, limit=share).select("node_id", "depth")
    family = graph.reach(edges, starts, 2, ["extends", "implements"], "both", through=nodes, limit=-(-most // 4)).select("node_id", F.lit(1).alias("depth"))
    reached = around.unionAll(family).groupBy(F.col("node_id").alias("id")).agg(F.min("depth").alias("depth"))
    rows = nodes.join(reached, "id").join(roots, "id", "left").withColumn("role", F.when(F.col("score").isNotNull(), "entry").otherwise("around"))
    rows = rows.filter(F.col("kind").isin(HIGH_VALUE) | (F.col("role") == "entry"))
    priority = F.when(F.col("role") == "entry", 10).otherwise(0) + F.when(F.col("kind").isin(DEFINITIONS), 3).when(F.col("kind").isin("function", "method"), 1).otherwise(0)
    rows = rows.withColumns({"__p": priority, "__t": fx.is_test_path(F.col("file_path"))})
    rows = rows.withColumn("__f", F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("__p"), "depth", "id"))).filter(F.col("__f") <= max(5, -(-most // 5)))
    rows = rows.withColumn("__q", F.row_number().over(W.partitionBy("__t").orderBy(F.desc("__p"), "depth", "id"))).filter(~F.col("__t") | (F.col("__q") <= max(3, -(-most * 3 // 20))))
    kept = cut_lineage(rows.orderBy(F.desc("__p"), "depth", "id").limit(most).select(*nodes.columns, "role", F.coalesce("score", F.lit(0.0)).alias("score")))
    return Context(kept, graph.edges_between(edges, kept).dropDuplicates(["source", "target", "kind"]))


def code_blocks(found: DataFrame, sources: DataFrame, most: int = 5, longest: int = 1500) -> DataFrame:
    """Source lines of the best symbols: (id, file_path, code); sources is (path, content). Entry points, then callables, then types."""
    rank = F.when(F.col("role") == "entry", 0).when(F.col("kind").isin("function", "method"), 1).when(F.col("kind") == "class", 2).otherwise(3)
    top = found.orderBy(rank, "id").limit(most)
    code = fx.source_lines(F.col("content"), F.col("start_line"), F.col("end_line"))
    cut = F.when(F.length(code) > longest, F.concat(F.substring(code, 1, longest), F.lit("\n..."))).otherwise(code)
    return top.join(sources, top["file_path"] == sources["path"]).select("id", "file_path", cut.alias("code"))


def report(query: str, found: Context, blocks: DataFrame | None = None, form: str = "markdown") -> str:
    """The answer as markdown or JSON; all parts are bounded by the context's own limit."""
    rows = sorted(found.nodes.collect(), key=lambda r: (r["role"] != "entry", -r["score"], r["id"]))
    links = [(e["source"], e["target"], e["kind"]) for e in found.edges.collect()]
    codes = {b["id"]: b["code"] for b in blocks.collect()} if blocks is not None else {}
    if form == "json":
        symbols = [{k: r[k] for k in ("id", "kind", "name", "file_path", "role", "score")} for r in rows]
        return json.dumps({"query": query, "symbols": symbols, "edges": links, "code": codes}, indent=2, ensure_ascii=False)
    out = [f"# {query}", "", "## Entry points", ""]
    for r in rows:
        if r["role"] == "entry":
            out.append(f"- **{r['name']}** ({r['kind']}) `{r['file_path']}`")
            if r["id"] in codes:
                out += ["", "```", codes[r["id"]], "```", ""]
    rest = [r for r in rows if r["role"] != "entry"]
    if rest:
        out += ["", "## Related symbols", ""] + [f"- `{f}`: {', '.join(r['name'] for r in rest if r['file_path'] == f)}" for f in dict.fromkeys(r["file_path"] for r in rest)]
    return "\n".join(out)


def relationships(edges: DataFrame, nodes: DataFrame, ids: Sequence[str], incoming: bool, limit: int = 20) -> DataFrame:
    """Callers or callees of several symbols together, each neighbour once: (node_id, kinds array)."""
    near, far = ("target", "source") if incoming else ("source", "target")
    hops = edges.filter(F.col("kind").isin(["calls", "references", "imports"]) & F.col(near).isin(list(ids)) & (F.col("source") != F.col("target")))
    return hops.join(nodes.select(F.col("id").alias(far)), far, "left_semi").groupBy(F.col(far).alias("node_id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds")).orderBy("node_id").limit(limit)
