"""Queries of the general training-data operators (problems 1 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import descendants, hierarchy, loops, parent_child
from graphloom.operators.model import trimmed_lower
from graphloom.operators.skew import distinct_counts, heavy_keys, key_quantiles
from graphloom.sources.tables import read


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return loops(parent_child(read(spark, folder, "edges")))


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(parent_child(read(spark, folder, "edges")))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return descendants(parent_child(read(spark, folder, "edges")))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    edges = read(spark, folder, "edges").filter("target <> ''")
    return edges.withColumn("kind", trimmed_lower(F.col("kind")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(_pairs(spark, folder), ["target", "kind"], 0.01).select("target", "kind")


def p5_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of edges and of distinct sources of every pair of target and kind."""
    pairs = _pairs(spark, folder)
    counts = pairs.groupBy("target", "kind").agg(F.count("*").alias("edges"))
    sources = distinct_counts(pairs, ["target", "kind"], "source", "sources").withColumnsRenamed({"target": "t", "kind": "k"})
    return counts.join(sources, (F.col("target") == F.col("t")) & F.col("kind").eqNullSafe(F.col("k"))).drop("t", "k")


def p5_line_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quartiles of the line of the edges of every pair of target and kind."""
    return key_quantiles(_pairs(spark, folder), ["target", "kind"], "line", [0.25, 0.5, 0.75])


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p5_found, p5_pair_counts, p5_line_quantiles)}

_LINKS = r"""links AS (SELECT DISTINCT source AS parent, target AS child FROM edges
  WHERE lower(trim(kind, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) = 'contains' AND source IS NOT NULL AND target IS NOT NULL)"""
_PAIRS = r"""pairs AS (SELECT source, target, lower(trim(kind, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS kind, line FROM edges WHERE target <> '')"""

ORACLES = {
    "p1_found": f"""WITH RECURSIVE {_LINKS},
      reach(a, b) AS (SELECT parent, child FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b),
      looped AS (SELECT x.a AS node, min(x.b) AS cycle_id FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)
      SELECT DISTINCT r.b AS node_id, l.cycle_id FROM looped l JOIN reach r ON r.a = l.node""",
    "p1_hierarchy": f"""WITH RECURSIVE {_LINKS},
      up AS (SELECT child AS node, min(parent) AS parent FROM links GROUP BY 1),
      nodes AS (SELECT parent AS node FROM links UNION SELECT child FROM links),
      walk(node, root, depth, path) AS (
        SELECT node, node, 0, node FROM nodes WHERE node NOT IN (SELECT node FROM up)
        UNION ALL SELECT u.node, w.root, w.depth + 1, w.path || ' > ' || u.node FROM walk w JOIN up u ON u.parent = w.node)
      SELECT n.node AS node_id, u.parent AS parent_id, w.root AS root_id, w.depth, w.path, w.node IS NULL AS looped
      FROM nodes n LEFT JOIN up u USING (node) LEFT JOIN walk w USING (node)""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS},
      reach(a, b) AS (SELECT parent, child FROM links UNION SELECT r.a, l.child FROM reach r JOIN links l ON l.parent = r.b),
      far(a, b, d) USING KEY (a, b) AS (SELECT parent, child, 1 FROM links WHERE parent NOT IN (SELECT a FROM reach WHERE a = b)
        UNION SELECT f.a, l.child, f.d + 1 FROM far f JOIN links l ON l.parent = f.b LEFT JOIN recurring.far k ON k.a = f.a AND k.b = l.child WHERE k.d IS NULL)
      SELECT a AS node_id, b AS descendant_id, d AS distance FROM far""",
    "p5_found": f"""WITH {_PAIRS} SELECT target, kind FROM pairs GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges WHERE target <> '')""",
    "p5_pair_counts": f"""WITH {_PAIRS} SELECT target, kind, count(*) AS edges, count(DISTINCT source) AS sources FROM pairs GROUP BY 1, 2""",
    "p5_line_quantiles": f"""WITH {_PAIRS} SELECT target, kind, count(line) AS n, quantile_disc(line::double, 0.25) AS q_25, quantile_disc(line::double, 0.5) AS q_50,
      quantile_disc(line::double, 0.75) AS q_75 FROM pairs WHERE line IS NOT NULL GROUP BY 1, 2""",
}
