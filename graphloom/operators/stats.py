"""Counts and summaries; each is one aggregation with map-side combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(metric, key, count): totals and counts by kind and language in one table."""
    def total(df: DataFrame, metric: str) -> DataFrame:
        return df.agg(F.count("*").alias("count")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "count")

    def by(df: DataFrame, column: str, metric: str) -> DataFrame:
        return df.groupBy(F.coalesce(column, F.lit("")).alias("key")).agg(F.count("*").alias("count")).select(F.lit(metric).alias("metric"), "key", "count")

    parts = [total(nodes, "nodes"), total(edges, "edges"), total(files, "files"), by(nodes, "kind", "nodes_by_kind"), by(edges, "kind", "edges_by_kind"), by(files, "language", "files_by_language")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def files_by_language(files: DataFrame) -> DataFrame:
    """Languages with number and bytes of files, largest groups first."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "language")


def name_spread(nodes: DataFrame) -> DataFrame:
    """Distinct files of each name, without case."""
    return nodes.groupBy(F.lower("name").alias("name")).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("symbols"))


def file_scores(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """Relevance of files: 10 for each entry point, 3 for each direct neighbour, 1 for each other hit (node_id, role)."""
    weight = F.when(F.col("role") == "entry", 10).when(F.col("role") == "neighbour", 3).otherwise(1)
    return hits.join(nodes.select(F.col("id").alias("node_id"), "file_path"), "node_id").groupBy("file_path").agg(F.sum(weight).alias("score"), F.count("*").alias("hits"))


def evaluation(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Recall and reciprocal rank of retrieval cases: found is (case_id, symbol, rank), expected is (case_id, symbol)."""
    expected = expected.distinct()
    best = found.groupBy("case_id", "symbol").agg(F.min("rank").alias("rank"))
    hits = expected.join(best, ["case_id", "symbol"], "left").groupBy("case_id").agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)).alias("reciprocal_rank"))
    return hits.withColumn("passed", F.col("recall") >= 0.5)
