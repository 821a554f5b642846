"""Queries of extraction, change feeds and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import extract
from graphloom.plans import views
from graphloom.plans.views import sql
from graphloom.sources.tables import read
from graphloom.streaming import feed

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are source text, as a file for each language in them."""
    rows = read(spark, folder, "documents").filter("doc_kind = 'source' AND text IS NOT NULL")
    return extract.split_languages(rows.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")))


@query()
def extract_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return extract.explode_rows(extract.extract(_texts(spark, folder)), "nodes").filter("kind <> 'file'").select("file_path", "kind", "name", "start_line")


@query()
def extract_references(spark: SparkSession, folder: str) -> DataFrame:
    return extract.explode_rows(extract.extract(_texts(spark, folder)), "refs").select("file_path", "reference_name", "reference_kind", "line")


@query()
def route_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.explode_rows(extract.extract(_texts(spark, folder)), "nodes").filter("kind IN ('route', 'component')").select("file_path", "name", "start_line")


@query()
def import_mappings(spark: SparkSession, folder: str) -> DataFrame:
    return extract.import_table(_texts(spark, folder)).select("path", "local_name", "export_name", "module")


_LANGUAGE = "CASE lower(regexp_extract(path, '(\\.[^./]*)$')) " + " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in extract.EXTENSIONS.items()) + " ELSE 'unknown' END"


@query(sql(f"SELECT path, {_LANGUAGE} AS detected FROM f", views.F))
def detect_languages(spark: SparkSession, folder: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in extract.EXTENSIONS.items() for x in pair])
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return views.files(spark, folder, "size").select("path", F.coalesce(table[ending], F.lit("unknown")).alias("detected"))


@query(
    """SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, burst"""
)
def debounce_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return feed.debounce(read(spark, folder, "events"), ["user_id"], "ts", "12 hours")
