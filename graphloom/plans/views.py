"""Clean views for queries, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import model
from graphloom.sources.tables import read

#: Symbols of the shared runtime library that every test scale holds; start points of single-node queries.
HOT = "function:d87b66b179a001ebf0837497376a6b37"
BOX = "module:2fdbb793a926a0ae8d5c62a15e4b7461"
TYPE = "class:b676f1faa0ee148acf4f8e1560082187"
FILE = "corelib/runtime/log.ts"


def nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return model.current_nodes(read(spark, folder, "nodes"), columns or model.NODE_COLUMNS)


def files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return model.current_files(read(spark, folder, "files"), columns) if columns else model.current_files(read(spark, folder, "files"))


def edges(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return model.clean_edges(read(spark, folder, "edges"), columns) if columns else model.clean_edges(read(spark, folder, "edges"))


_TRIM = r"lower(trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
N = f"""n AS (SELECT id, {_TRIM.format('kind')} AS kind, name, qualified_name, file_path, language, start_line, end_line, docstring, signature, visibility, is_exported
  FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) = 1)"""
E = f"""e AS (SELECT edge_id, source, target, {_TRIM.format('kind')} AS kind, metadata, line, col, provenance FROM edges WHERE source IS NOT NULL AND target <> '')"""
F = f"""f AS (SELECT path, content_hash, {_TRIM.format('language')} AS language, size, modified_at, indexed_at, node_count
  FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST) = 1)"""


def sql(body: str, *views: str, recursive: str = "") -> str:
    """A statement over clean views; recursive holds further common tables."""
    parts = [*views, *([recursive] if recursive else [])]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"
