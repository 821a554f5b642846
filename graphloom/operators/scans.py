"""Lookups and listings over the clean views. All are filters and projections that reach the scan."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    """Symbols of a file by line, then id."""
    return nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")


def nodes_by_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(list(kinds)))


def nodes_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """Case-sensitive equality."""
    return nodes.filter(F.col("name") == name)


def nodes_by_lower_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.lower("name") == name.lower())


def nodes_by_qualified_name(nodes: DataFrame, pattern: str, kinds: Sequence[str] = ("function", "method", "class", "interface", "struct", "enum", "type_alias")) -> DataFrame:
    """Qualified names that match a glob from end to end; * crosses all separators, ? is one character."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return nodes.filter(F.col("kind").isin(list(kinds)) & F.col("qualified_name").rlike(f"(?s)^{regex}$"))


def outgoing(edges: DataFrame, node_id: str, kinds: Sequence[str] | None = None, provenance: str | None = None) -> DataFrame:
    found = edges.filter(F.col("source") == node_id)
    found = found.filter(F.col("kind").isin(list(kinds))) if kinds else found
    return found.filter(F.col("provenance") == provenance) if provenance else found


def incoming(edges: DataFrame, node_id: str, kinds: Sequence[str] | None = None) -> DataFrame:
    found = edges.filter(F.col("target") == node_id)
    return found.filter(F.col("kind").isin(list(kinds))) if kinds else found


def normal_prefix(prefix: str) -> str:
    """A path prefix without blanks around and leading ./ parts."""
    prefix = prefix.strip().replace("\\", "/")
    while prefix.startswith("./"):
        prefix = prefix[2:]
    return prefix


def files_under(files: DataFrame, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Files whose path starts with a prefix, by path; a limit keeps the first ones."""
    found = files.filter(F.col("path").startswith(normal_prefix(prefix))) if prefix else files
    found = found.orderBy("path")
    return found.limit(limit) if limit is not None else found


def file_names(files: DataFrame) -> DataFrame:
    return files.select("path").orderBy("path")


def references_by_name(refs: DataFrame, name: str) -> DataFrame:
    return refs.filter(F.col("reference_name") == name)


def reference_batch(refs: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of references by ref_id."""
    return refs.orderBy("ref_id").offset(offset).limit(limit)


def references_of_files(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """References of the files in paths (path)."""
    return refs.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
