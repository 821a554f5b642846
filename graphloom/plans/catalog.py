"""Queries of lookups, listings, counts and storage rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.operators import model, scans, stats, storage
from graphloom.plans import views
from graphloom.plans.views import BOX, FILE, HOT, sql
from graphloom.sources.tables import read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query(sql(f"SELECT id, kind, name, file_path FROM n WHERE id = '{HOT}'", views.N))
def node_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return scans.node_by_id(views.nodes(spark, folder, "kind", "name", "file_path"), HOT)


@query(sql(f"SELECT id, kind, name, start_line FROM n WHERE file_path = '{FILE}' ORDER BY start_line, id", views.N))
def nodes_by_file(spark: SparkSession, folder: str) -> DataFrame:
    return scans.nodes_by_file(views.nodes(spark, folder, "kind", "name", "file_path", "start_line"), FILE).drop("file_path")


@query(sql("SELECT id, name, file_path FROM n WHERE kind IN ('class', 'interface')", views.N))
def nodes_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return scans.nodes_by_kind(views.nodes(spark, folder, "kind", "name", "file_path"), "class", "interface").drop("kind")


@query(sql("SELECT id, kind, file_path FROM n WHERE name = 'logEvent'", views.N))
def name_exact(spark: SparkSession, folder: str) -> DataFrame:
    return scans.nodes_by_name(views.nodes(spark, folder, "kind", "name", "file_path"), "logEvent").drop("name")


@query(sql("SELECT id, name FROM n WHERE lower(name) = 'logevent'", views.N))
def name_lower(spark: SparkSession, folder: str) -> DataFrame:
    return scans.nodes_by_lower_name(views.nodes(spark, folder, "name"), "LogEvent")


@query(sql("SELECT id, qualified_name FROM n WHERE kind IN ('function', 'method', 'class', 'interface', 'struct', 'enum', 'type_alias') AND regexp_matches(qualified_name, '(?s)^.*Queue.*$')", views.N))
def qualified_glob(spark: SparkSession, folder: str) -> DataFrame:
    return scans.nodes_by_qualified_name(views.nodes(spark, folder, "kind", "qualified_name"), "*Queue*").drop("kind")


@query(sql(f"SELECT edge_id, target, kind FROM e WHERE source = '{BOX}' AND kind IN ('contains', 'calls')", views.E))
def out_edges_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return scans.outgoing(views.edges(spark, folder), BOX, ["contains", "calls"]).drop("source")


@query(sql(f"SELECT edge_id, target, provenance FROM e WHERE source = '{BOX}' AND provenance = 'tree-sitter'", views.E))
def out_edges_by_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return scans.outgoing(views.edges(spark, folder, "edge_id", "source", "target", "provenance"), BOX, provenance="tree-sitter").drop("source")


@query(sql(f"SELECT edge_id, source FROM e WHERE target = '{HOT}' AND kind = 'references'", views.E))
def in_edges_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return scans.incoming(views.edges(spark, folder), HOT, ["references"]).select("edge_id", "source")


@query(sql("SELECT path, language, size FROM f WHERE starts_with(path, 'harborline/lib/')", views.F))
def file_prefix_listing(spark: SparkSession, folder: str) -> DataFrame:
    return scans.files_under(views.files(spark, folder, "language", "size"), "./harborline/lib/")


@query(sql("SELECT count(*) AS files FROM f WHERE starts_with(path, 'harborline/')", views.F))
def file_count_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return scans.files_under(views.files(spark, folder, "size"), "harborline/").agg(F.count("*").alias("files"))


@query(sql("SELECT path FROM f ORDER BY path LIMIT 20", views.F))
def file_listing_limited(spark: SparkSession, folder: str) -> DataFrame:
    return scans.files_under(views.files(spark, folder, "size"), limit=20).select("path")


@query("SELECT ref_id, from_node_id, line FROM unresolved_refs WHERE reference_name = 'println'")
def references_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return scans.references_by_name(read(spark, folder, "unresolved_refs"), "println").select("ref_id", "from_node_id", "line")


@query("SELECT ref_id, reference_name FROM unresolved_refs ORDER BY ref_id LIMIT 100 OFFSET 50")
def reference_batch(spark: SparkSession, folder: str) -> DataFrame:
    return scans.reference_batch(read(spark, folder, "unresolved_refs"), 50, 100).select("ref_id", "reference_name")


@query(sql("SELECT ref_id FROM unresolved_refs WHERE file_path IN (SELECT path FROM f WHERE language = 'python')", views.F))
def references_of_files(spark: SparkSession, folder: str) -> DataFrame:
    python = views.files(spark, folder, "language").filter("language = 'python'")
    return scans.references_of_files(read(spark, folder, "unresolved_refs"), python).select("ref_id")


@query(
    sql(
        """SELECT 'nodes' AS metric, '' AS key, count(*) AS count FROM n UNION ALL SELECT 'edges', '', count(*) FROM e UNION ALL SELECT 'files', '', count(*) FROM f
        UNION ALL SELECT 'nodes_by_kind', coalesce(kind, ''), count(*) FROM n GROUP BY 2 UNION ALL SELECT 'edges_by_kind', coalesce(kind, ''), count(*) FROM e GROUP BY 2
        UNION ALL SELECT 'files_by_language', coalesce(language, ''), count(*) FROM f GROUP BY 2""",
        views.N, views.E, views.F,
    )
)
def stats_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.totals(views.nodes(spark, folder, "kind"), views.edges(spark, folder, "source", "target", "kind"), views.files(spark, folder, "language"))


@query(sql("SELECT language, count(*) AS files, sum(size)::bigint AS bytes FROM f GROUP BY 1", views.F))
def files_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return stats.files_by_language(views.files(spark, folder, "language", "size"))


@query(sql("SELECT lower(name) AS name, count(DISTINCT file_path) AS files, count(*) AS symbols FROM n GROUP BY 1", views.N))
def name_spread(spark: SparkSession, folder: str) -> DataFrame:
    return stats.name_spread(views.nodes(spark, folder, "name", "file_path"))


@query("SELECT reference_kind, count(*) AS refs, count(DISTINCT reference_name) AS names FROM unresolved_refs GROUP BY 1")
def unresolved_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "unresolved_refs").groupBy("reference_kind").agg(F.count("*").alias("refs"), F.countDistinct("reference_name").alias("names"))


@query(sql("SELECT id, kind, name, file_path FROM n", views.N))
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    return views.nodes(spark, folder, "kind", "name", "file_path")


@query(
    sql(
        """SELECT d.path AS path, CASE WHEN t.path IS NULL THEN 'added' WHEN d.content_hash IS DISTINCT FROM t.content_hash THEN 'modified' ELSE 'unchanged' END AS status FROM f d LEFT JOIN t USING (path)""",
        views.F,
        recursive="""t AS (SELECT path, content_hash FROM files WHERE indexed_at < 1735689600000 QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1)""",
    )
)
def sync_diff(spark: SparkSession, folder: str) -> DataFrame:
    """What changed between the state at a point in time and the newest state."""
    rows = read(spark, folder, "files")
    before = model.current_files(rows.filter("indexed_at < 1735689600000"), ["content_hash"])
    return storage.sync_plan(model.current_files(rows, ["content_hash"]), before, unchanged=True)


@query(
    sql(
        "SELECT path, t.content_hash AS stored_hash, f.content_hash AS current_hash FROM f JOIN t USING (path) WHERE t.content_hash <> f.content_hash",
        views.F,
        recursive="""t AS (SELECT path, content_hash FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at, content_hash) = 1)""",
    )
)
def stale_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "files")
    first = rows.groupBy("path").agg(F.min_by("content_hash", F.struct("indexed_at", "content_hash")).alias("content_hash"))
    return storage.stale_files(first, model.current_files(rows, ["content_hash"]))


@query(sql("SELECT edge_id FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)", views.N, views.E))
def integrity_filter(spark: SparkSession, folder: str) -> DataFrame:
    return storage.valid_edges(views.edges(spark, folder, "edge_id", "source", "target"), views.nodes(spark, folder, "kind")).select("edge_id")


@query(sql(f"SELECT edge_id FROM e WHERE source NOT IN (SELECT id FROM n WHERE file_path = '{FILE}') AND target NOT IN (SELECT id FROM n WHERE file_path = '{FILE}')", views.N, views.E))
def delete_file_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Links that stay when a file's symbols are deleted."""
    gone = views.nodes(spark, folder, "file_path").filter(F.col("file_path") == FILE)
    return storage.without_nodes(views.edges(spark, folder, "edge_id", "source", "target"), gone).select("edge_id")


@query("SELECT ref_id FROM unresolved_refs a WHERE NOT EXISTS (SELECT 1 FROM unresolved_refs b WHERE b.reference_kind = 'imports' AND b.from_node_id = a.from_node_id AND b.reference_name = a.reference_name AND b.reference_kind = a.reference_kind)")
def delete_resolved_refs(spark: SparkSession, folder: str) -> DataFrame:
    refs = read(spark, folder, "unresolved_refs")
    return storage.without_references(refs, refs.filter("reference_kind = 'imports'")).select("ref_id")


@query(sql("SELECT name, id, rank::int AS rank FROM (SELECT lower(name) AS name, id, row_number() OVER (PARTITION BY lower(name) ORDER BY coalesce(is_exported, false) DESC, id) AS rank FROM n) WHERE rank <= 2", views.N))
def topn_per_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.nodes(spark, folder, "name", "is_exported").withColumn("name", F.lower("name"))
    order = W.partitionBy("name").orderBy(F.coalesce("is_exported", F.lit(False)).desc(), "id")
    return rows.select("name", "id", F.row_number().over(order).alias("rank")).filter("rank <= 2")


@query(
    sql(
        """SELECT id, file_path FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY CASE WHEN kind IN ('class', 'interface', 'struct') THEN 3 WHEN kind IN ('function', 'method') THEN 1 ELSE 0 END DESC, id) AS r FROM n) WHERE r <= 5""",
        views.N,
    )
)
def per_file_cap(spark: SparkSession, folder: str) -> DataFrame:
    rank = F.when(F.col("kind").isin("class", "interface", "struct"), 3).when(F.col("kind").isin("function", "method"), 1).otherwise(0)
    order = W.partitionBy("file_path").orderBy(rank.desc(), "id")
    return views.nodes(spark, folder, "kind", "file_path").withColumn("r", F.row_number().over(order)).filter("r <= 5").select("id", "file_path")


@query(
    sql(
        """SELECT file_path, min(start_line) AS first_line, max(end_line) AS last_line, count(*) AS symbols FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 THEN 0 ELSE 1 END AS fresh
            FROM n WHERE kind <> 'file' AND start_line IS NOT NULL AND end_line IS NOT NULL AND file_path IS NOT NULL)) GROUP BY file_path, island""",
        views.N,
    )
)
def gaps_islands_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.nodes(spark, folder, "kind", "file_path", "start_line", "end_line").filter("kind <> 'file' AND start_line IS NOT NULL AND end_line IS NOT NULL AND file_path IS NOT NULL")
    return fx.line_clusters(rows, gap=8).select("file_path", "first_line", "last_line", "symbols")


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").filter("text IS NOT NULL").select("doc_id", fx.content_hash(F.col("text")).alias("hash"))


@query(sql("SELECT id, kind || ':' || substr(sha256(concat_ws(':', file_path, kind, name, start_line::varchar)), 1, 32) AS made_id FROM n WHERE file_path IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL AND start_line IS NOT NULL", views.N))
def node_id_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.nodes(spark, folder, "kind", "name", "file_path", "start_line").dropna(subset=["file_path", "kind", "name", "start_line"])
    return rows.select("id", fx.node_id(F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line")).alias("made_id"))
