"""Clean views of the raw tables: newest states, trimmed labels, usable links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"
NODE_COLUMNS = "kind name qualified_name file_path language start_line end_line docstring signature visibility is_exported".split()
#: Node kinds with members, node kinds that can be called, and the kinds of links.
CONTAINERS = ["class", "interface", "struct", "trait", "protocol", "module", "enum"]
CALLABLES = ["function", "method"]
CALL_KINDS = ["calls", "references", "imports"]
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()


def trimmed_lower(column: Column) -> Column:
    """A label without stray case and blanks."""
    return F.lower(F.btrim(column, F.lit(BLANKS)))


def newest(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """One row for each non-null key: (key, *columns) of its row of the largest order.

    A null order is oldest; of equal orders the row of the largest content hash holds, so exact copies collapse and the
    choice is stable. Rows reduce in each task before the one shuffle by key.
    """
    own = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(F.coalesce(F.col(order).cast("long"), F.lit(-(2**63))), F.xxhash64(*[F.col(c) for c in columns]))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(own, rank).alias("own")).select(key, *[F.col(f"own.{c}").alias(c) for c in columns])


def current_nodes(nodes: DataFrame, columns: Sequence[str] = NODE_COLUMNS) -> DataFrame:
    """The newest row of each symbol with a clean kind; only the named columns are read."""
    rows = newest(nodes, "id", "updated_at", columns)
    return rows.withColumn("kind", trimmed_lower(F.col("kind"))) if "kind" in columns else rows


def current_files(files: DataFrame, columns: Sequence[str] = ("content_hash", "language", "size", "modified_at", "indexed_at", "node_count")) -> DataFrame:
    """The newest row of each path with a clean language."""
    rows = newest(files, "path", "indexed_at", columns)
    return rows.withColumn("language", trimmed_lower(F.col("language"))) if "language" in columns else rows


def clean_edges(edges: DataFrame, columns: Sequence[str] = ("edge_id", "source", "target", "kind")) -> DataFrame:
    """The bag of links with clean kinds; links without a source or a target are left out."""
    rows = edges.filter("source IS NOT NULL AND target <> ''").select(*columns)
    return rows.withColumn("kind", trimmed_lower(F.col("kind"))) if "kind" in columns else rows


def persistable(nodes: DataFrame) -> DataFrame:
    """Symbols with all required fields: id, kind, name, file_path and language neither null nor empty."""
    ok = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("id", "kind", "name", "file_path", "language")]
    return nodes.filter(ok[0] & ok[1] & ok[2] & ok[3] & ok[4])
