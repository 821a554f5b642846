"""Scalar functions as Spark columns; all stay inside generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import search_terms

#: Points of a search result by the kind of symbol.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4, "property": 3, "field": 3, "variable": 2, "constant": 3, "import": 1, "export": 1,
    "namespace": 4, "protocol": 9, "enum_member": 3,
}
#: Paths of tests and other code outside production, on the lower-case and on the given path.
TEST_LOWER = (
    r"(^|/)test[_.][^/]*$|[._-](test|tests|spec|specs)\.[a-z0-9]+$|/(tests?|__tests__|specs?|testlib|testing)/|^(tests?|specs?)/|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/"
)
TEST_CASED = r"(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$|(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/"
#: Files that run as tests when something they depend on changes.
AFFECTED_TEST = r"\.spec\.|\.test\.|(^|/)__tests__/|(^|/)tests?/|(^|/)e2e/|(^|/)spec/"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def node_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    """kind and the first 32 hex digits of the hash of path:kind:name:line."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line.cast("string")), 256), 1, 32))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The directory of a path; . at the root."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_LOWER) | path.rlike(TEST_CASED)


def is_affected_test(path: Column) -> Column:
    return F.translate(path, "\\", "/").rlike(AFFECTED_TEST)


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in KIND_BONUS.items() for x in pair])[kind], F.lit(0))


def path_relevance(path: Column, query: str) -> Column:
    """For each term 10 in the file name, and 5 in the directory or else 3 in the path; 15 less for tests that the query does not ask for."""
    terms = search_terms(query, stems=False)
    lower, name, folder = F.lower(path), F.lower(basename(path)), F.lower(dirname(path))
    parts = [F.when(name.contains(t), 10).otherwise(0) + F.when(folder.contains(t), 5).when(lower.contains(t), 3).otherwise(0) for t in terms]
    score = reduce(lambda a, b: a + b, parts, F.lit(0))
    if terms and not any(w in query.lower() for w in ("test", "spec")):
        score = score - F.when(is_test_path(path), 15).otherwise(0)
    return score


def name_match_bonus(name: Column, query: str) -> Column:
    """80 for the whole query, 60 for one of several words, 10 to 40 for a prefix, 15 for all parts, 10 for a part."""
    lower, whole = F.lower(name), re.sub(r"\s+", "", query).lower()
    parts = [t.lower() for t in re.split(r"[\s_.\-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query)) if len(t) >= 2]
    words = [t.lower() for t in query.split() if len(t) >= 2]
    out = F.when(lower == whole, 80)
    if len(words) > 1:
        out = out.when(lower.isin(words), 60)
    out = out.when(lower.startswith(whole), F.floor(10.5 + 30.0 * len(whole) / F.length(lower)).cast("int"))
    if len(parts) > 1:
        out = out.when(reduce(lambda a, b: a & b, [lower.contains(t) for t in parts]), 15)
    return out.when(lower.contains(whole), 10).otherwise(0)


def path_proximity(a: Column, b: Column) -> Column:
    """15 for each leading directory that two paths share, at most 80."""
    def folders(p: Column) -> Column:
        return F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))

    same = F.zip_with(folders(a), folders(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, False)
    return F.least(F.when(miss == 0, F.size(same)).otherwise(miss - 1) * 15, F.lit(80)).cast("int")


def camel_words(text: Column) -> Column:
    """Words of a name, cut at case changes and separators, of two letters or more."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(spaced, r"[\s._:/\\]+"), lambda w: F.length(w) > 1)


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def camel_boundary(name: Column, term: str) -> Column:
    """Whether a name holds a term at the start of one of its words, but not at its own start."""
    title = term[:1].upper() + term[1:]
    return name.contains(title) & ~F.lower(name).startswith(term.lower()) | F.array_contains(F.transform(camel_words(name), lambda w: F.lower(w)), term.lower()) & ~F.lower(name).startswith(term.lower())


def line_clusters(rows: DataFrame, gap: int) -> DataFrame:
    """Merges symbols of a file whose lines lie within gap: (file_path, island, first_line, last_line, symbols)."""
    order = W.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    reach = F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.col("start_line") <= reach + gap, 0).otherwise(1)
    islands = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("file_path", "island").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count("*").alias("symbols"))


def source_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\r?\n"), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")



def json_strings(text: Column) -> Column:
    """A JSON array of strings as an array; null where it is malformed."""
    return F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings; null where it is malformed."""
    return F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})


def node_json(*columns: str) -> Column:
    """A row as JSON text; null fields are left out."""
    return F.to_json(F.struct(*columns))
