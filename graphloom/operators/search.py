"""Ranked search over symbols: full text, substrings, near names, and the ladder that combines them.

A query is parsed on the driver into columns; each stage is a scan with a filter and a top-k, so nothing but the result
and a few counts leaves the executors. Ties are broken by id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.functions.text import ParsedQuery, fts_terms, parse_query

#: Columns of the text index with their weights, and the constants of the ranking formula.
INDEX = {"id": 0.0, "name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ["kind", "name", "qualified_name", "file_path", "language", "docstring", "signature"]


def tokens(column: Column) -> Column:
    """Lower-case letters-and-digits tokens of a text; none of a null."""
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _occurrences(words: Column, phrase: Sequence[str]) -> Column:
    """Places where a phrase starts whose last token is a prefix."""
    m = len(phrase)
    if m == 1:
        return F.size(F.filter(words, lambda t: t.startswith(phrase[0])))

    def at(k: Column) -> Column:
        same = [F.get(words, k + j) == phrase[j] for j in range(m - 1)]
        return F.coalesce(reduce(lambda a, b: a & b, same) & F.get(words, k + (m - 1)).startswith(phrase[-1]), F.lit(False))

    places = F.filter(F.transform(words, lambda _, k: k), at)
    return F.size(places)


def _wanted(kinds: Sequence[str] | None, languages: Sequence[str] | None) -> Column:
    ok = F.lit(True)
    if kinds:
        ok = ok & F.col("kind").isin(list(kinds))
    if languages:
        ok = ok & F.col("language").isin(list(languages))
    return ok


def full_text(nodes: DataFrame, text: str, kinds: Sequence[str] | None = None, languages: Sequence[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Symbols by BM25 over five weighted columns: (*columns of nodes, score double), best first.

    Every blank-separated term is a phrase of tokens with a prefix at its end; any one of them matches. Length and
    document frequencies count all indexed columns and all symbols. Without usable terms, and on an empty table, there
    are no rows. At most max(5 * limit, 100) rows come out, as later stages rank again.

    Two scans: one aggregate of 2 + terms numbers, then scores with a top-k.
    """
    phrases = fts_terms(text)
    words = nodes.withColumns({f"__t_{c}": tokens(F.col(c)) for c in INDEX})
    words = words.withColumn("__length", reduce(lambda a, b: a + b, [F.size(f"__t_{c}") for c in INDEX]))
    for i, phrase in enumerate(phrases):
        counts = {c: _occurrences(F.col(f"__t_{c}"), phrase) for c in INDEX}
        words = words.withColumns({f"__hit{i}": reduce(lambda a, b: a + b, list(counts.values())), f"__f{i}": reduce(lambda a, b: a + b, [counts[c] * F.lit(w) for c, w in INDEX.items()])})
    words = words.drop(*[f"__t_{c}" for c in INDEX])
    if not phrases:
        return nodes.withColumn("score", F.lit(0.0)).limit(0)
    seen = words.agg(F.count("*").alias("n"), F.avg("__length").alias("mean"), *[F.count(F.when(F.col(f"__hit{i}") > 0, 1)).alias(f"n{i}") for i in range(len(phrases))]).first()
    total = F.lit(0.0)
    for i in range(len(phrases)):
        idf = math.log((seen["n"] - seen[f"n{i}"] + 0.5) / (seen[f"n{i}"] + 0.5)) if seen["n"] else 0.0
        f = F.col(f"__f{i}")
        total = total + F.lit(idf if idf > 0 else LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__length") / F.lit(seen["mean"] or 1.0)))
    match = reduce(lambda a, b: a | b, [F.col(f"__hit{i}") > 0 for i in range(len(phrases))])
    scored = words.filter(match & _wanted(kinds, languages)).withColumn("score", total).select(*nodes.columns, "score")
    return scored.orderBy(F.desc(F.round("score", 9)), "id").offset(offset).limit(max(limit * 5, 100))


def like(nodes: DataFrame, text: str, kinds: Sequence[str] | None = None, languages: Sequence[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Substring search: score 1.0 for an equal name, 0.9 a prefix, 0.8 a part of the name, 0.7 of the qualified name.

    Prefixes and parts ignore case; text is taken literally, so % and _ mean themselves.
    """
    low, name, qualified = text.lower(), F.lower("name"), F.lower("qualified_name")
    score = F.when(F.col("name") == text, 1.0).when(name.startswith(low), 0.9).when(name.contains(low), 0.8).when(qualified.contains(low), 0.7)
    found = nodes.withColumn("score", score).filter(F.col("score").isNotNull() & _wanted(kinds, languages))
    return found.orderBy(F.desc("score"), F.length("name"), "id").offset(offset).limit(limit)


def by_filters(nodes: DataFrame, kinds: Sequence[str] | None, languages: Sequence[str] | None, limit: int) -> DataFrame:
    """All symbols of some kinds and languages, by name, with score 1."""
    return nodes.filter(_wanted(kinds, languages)).orderBy("name", "id").limit(limit).withColumn("score", F.lit(1.0))


def fuzzy(nodes: DataFrame, text: str, kinds: Sequence[str] | None = None, languages: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    """Names within one edit (up to four letters) or two: score 1 / (1 + distance), up to five symbols a name."""
    low = text.lower()
    most = 1 if len(low) <= 4 else 2
    distance = F.levenshtein(F.lower("name"), F.lit(low), most)
    found = nodes.filter((F.abs(F.length("name") - len(low)) <= most) & _wanted(kinds, languages)).withColumn("__d", distance).filter("__d >= 0")
    found = found.withColumn("__r", F.row_number().over(W.partitionBy("name").orderBy("id"))).filter("__r <= 5")
    return found.withColumn("score", 1 / (1 + F.col("__d"))).orderBy(F.desc("score"), "name", "id").limit(limit).drop("__d", "__r")


def rescored(found: DataFrame, query: str) -> DataFrame:
    """Adds the points of kind, path and name to a score."""
    points = fx.kind_bonus(F.col("kind")) + fx.path_relevance(F.col("file_path"), query) + fx.name_match_bonus(F.col("name"), query)
    return found.withColumn("score", F.col("score") + points)


def search(nodes: DataFrame, query: str, kinds: Sequence[str] | None = None, languages: Sequence[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The search ladder: full text, else substrings, else near names; then exact names, points, path and name filters.

    Field filters of the query widen the given kinds and languages. Symbols whose name equals a word of the raw query
    join with the best score, up to 20 a word. path: and name: filters hold after ranking.
    """
    parsed: ParsedQuery = parse_query(query)
    kinds = list(dict.fromkeys([*(kinds or []), *parsed.kinds])) if parsed.kinds else kinds
    languages = list(dict.fromkeys([*(languages or []), *parsed.languages])) if parsed.languages else languages
    text = parsed.text
    found = full_text(nodes, text, kinds, languages, limit, offset) if text else by_filters(nodes, kinds, languages, limit * 5)
    for least, stage in ((2, like), (3, fuzzy)):
        if len(text) >= least and found.isEmpty():
            found = stage(nodes, text, kinds, languages, limit)
    best = found.agg(F.max("score")).first()[0]
    if best is not None:
        words = [w.lower() for w in query.split() if len(w) >= 2]
        exact = nodes.filter(F.lower("name").isin(words) & _wanted(kinds, languages)) if words else nodes.limit(0)
        exact = exact.withColumn("__r", F.row_number().over(W.partitionBy(F.lower("name")).orderBy("id"))).filter("__r <= 20").drop("__r")
        found = found.unionByName(exact.join(found.select("id"), "id", "left_anti").withColumn("score", F.lit(best)))
    found = rescored(found, text or query)
    if parsed.paths:
        found = found.filter(reduce(lambda a, b: a | b, [F.lower("file_path").contains(p.lower()) for p in parsed.paths]))
    if parsed.names:
        found = found.filter(reduce(lambda a, b: a | b, [F.lower("name").contains(p.lower()) for p in parsed.names]))
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def exact_names(nodes: DataFrame, names: Sequence[str], kinds: Sequence[str] | None = None, languages: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """Symbols of given names, without case; 20 more where their file holds a name that fewer than ten files hold.

    Each name gives up to max(8, limit / names) symbols.
    """
    low = list(dict.fromkeys(n.lower() for n in names))
    hits = nodes.withColumn("__n", F.lower("name")).filter(F.col("__n").isin(low) & _wanted(kinds, None))
    places = hits.select("__n", "file_path").distinct()
    rare = places.groupBy("__n").agg(F.count("*").alias("c")).filter("c < 10")
    near = places.join(rare, "__n", "left_semi").select("file_path").distinct().withColumn("__near", F.lit(20.0))
    scored = hits.filter(_wanted(None, languages)).join(near, "file_path", "left").withColumn("score", 1.0 + F.coalesce("__near", F.lit(0.0)))
    order = W.partitionBy("__n").orderBy(F.desc("score"), "id")
    kept = scored.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= max(8, -(-limit // max(len(names), 1))))
    return kept.orderBy(F.desc("score"), "id").limit(limit).select(*nodes.columns, "score")


def substring_names(nodes: DataFrame, part: str, exclude_prefix: bool = False, kinds: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    """Symbols whose name holds a text, without case; shortest names first; without those that start with it if asked."""
    name = F.lower("name")
    ok = name.contains(part.lower()) & _wanted(kinds, None)
    if exclude_prefix:
        ok = ok & ~name.startswith(part.lower())
    return nodes.filter(ok).orderBy(F.length("name"), "id").limit(limit)


def symbol_matches(nodes: DataFrame, symbol: str) -> DataFrame:
    """Symbols that a possibly qualified name means: equal name, file stem, or tail with its qualifiers around."""
    parts = [p for p in re.split(r"::|[./]", symbol) if p]
    if not parts:
        return nodes.limit(0)
    ok = (F.col("name") == symbol) | ((F.col("kind") == "file") & (F.regexp_replace(F.col("name"), r"\.[^.]*$", "") == symbol))
    if len(parts) > 1:
        hints = [p for p in parts[:-1] if p not in ("crate", "super", "self")]
        suffix = F.col("qualified_name").endswith("::".join(parts))
        around = reduce(lambda a, b: a & b, [F.array_contains(F.split(F.regexp_replace("file_path", r"\.[^./]*$", ""), "/"), h) | F.array_contains(F.split("qualified_name", "::"), h) for h in hints], F.lit(True))
        ok = ok | ((F.col("name") == parts[-1]) & (suffix | around))
    return nodes.filter(ok)
