"""Queries of the search and context operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.functions.text import search_terms
from graphloom.operators import context, search
from graphloom.plans import views
from graphloom.plans.views import E, N, sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return views.nodes(spark, folder, *search.COLUMNS)


def _bm25(terms: list[str]) -> str:
    """Common tables of the ranking for one-token prefix terms."""
    split = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t_{0}"
    hits = lambda c, t: f"len(list_filter(t_{c}, lambda t: starts_with(t, '{t}')))"
    columns = ", ".join(f"{' + '.join(hits(c, t) for c in search.INDEX)} AS h{i}, {' + '.join(f'{w} * {hits(c, t)}' for c, w in search.INDEX.items())} AS f{i}" for i, t in enumerate(terms))
    idf = ", ".join(f"greatest(CASE WHEN ln((count(*) - count(*) FILTER (h{i} > 0) + 0.5) / (count(*) FILTER (h{i} > 0) + 0.5)) > 0 THEN ln((count(*) - count(*) FILTER (h{i} > 0) + 0.5) / (count(*) FILTER (h{i} > 0) + 0.5)) ELSE 1e-6 END, 0) AS idf{i}" for i in range(len(terms)))
    total = " + ".join(f"s.idf{i} * c.f{i} * 2.2 / (c.f{i} + 1.2 * (0.25 + 0.75 * c.length / s.mean))" for i in range(len(terms)))
    return f"""w AS (SELECT *, {', '.join(split.format(c) for c in search.INDEX)} FROM n),
      c AS (SELECT *, {' + '.join(f'len(t_{x})' for x in search.INDEX)} AS length, {columns} FROM w), s AS (SELECT avg(length) AS mean, {idf} FROM c),
      b AS (SELECT c.*, {total} AS score FROM c, s WHERE {' OR '.join(f'c.h{i} > 0' for i in range(len(terms)))})"""


@query(sql("SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 9) DESC, id LIMIT 100", N, recursive=_bm25(["queue", "snapshot"])))
def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return search.full_text(_nodes(spark, folder), "queue snapshot", limit=20).select("id", F.round("score", 6).alias("score"))


@query(
    sql(
        """SELECT id, score FROM (SELECT id, name, CASE WHEN name = 'Queue' THEN 1.0 WHEN starts_with(lower(name), 'queue') THEN 0.9 WHEN contains(lower(name), 'queue') THEN 0.8 WHEN contains(lower(qualified_name), 'queue') THEN 0.7 END::double AS score FROM n)
        WHERE score IS NOT NULL ORDER BY score DESC, length(name), id LIMIT 50""",
        N,
    )
)
def search_like(spark: SparkSession, folder: str) -> DataFrame:
    return search.like(_nodes(spark, folder), "Queue", limit=50).select("id", "score")


@query(
    sql(
        """SELECT id, score FROM (SELECT id, name, 1.0::double / (1 + levenshtein(lower(name), 'logevnt')) AS score, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM n WHERE levenshtein(lower(name), 'logevnt') <= 2)
        WHERE r <= 5 ORDER BY score DESC, name, id LIMIT 20""",
        N,
    )
)
def search_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return search.fuzzy(_nodes(spark, folder), "logevnt", limit=20).select("id", "score")


@query(sql("SELECT id, name FROM n WHERE kind = 'interface' AND language = 'typescript' ORDER BY name, id LIMIT 100", N))
def search_filters_only(spark: SparkSession, folder: str) -> DataFrame:
    return search.by_filters(_nodes(spark, folder), ["interface"], ["typescript"], 100).select("id", "name")


_KIND_BONUS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fx.KIND_BONUS.items()) + " ELSE 0 END"
_IS_TEST = f"(regexp_matches(lower(file_path), '{fx.TEST_LOWER}') OR regexp_matches(file_path, '{fx.TEST_CASED}'))"
_DIR = "CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END"
_BASE = "regexp_extract(file_path, '[^/]*$')"


def _relevance(text: str) -> str:
    terms = search_terms(text, stems=False)
    parts = [f"(CASE WHEN contains(lower({_BASE}), '{t}') THEN 10 ELSE 0 END + CASE WHEN contains(lower({_DIR}), '{t}') THEN 5 WHEN contains(lower(file_path), '{t}') THEN 3 ELSE 0 END)" for t in terms]
    return f"({' + '.join(parts)} - CASE WHEN {_IS_TEST} THEN 15 ELSE 0 END)"


def _name_bonus(text: str) -> str:
    words, whole = text.lower().split(), text.lower().replace(" ", "")
    several = len(words) > 1
    return (
        f"CASE WHEN lower(name) = '{whole}' THEN 80 " + (f"WHEN lower(name) IN ({', '.join(repr(w) for w in words)}) THEN 60 " if several else "")
        + f"WHEN starts_with(lower(name), '{whole}') THEN floor(10.5 + 30.0 * {len(whole)} / length(name))::int "
        + (f"WHEN {' AND '.join(f'contains(lower(name), {w!r})' for w in words)} THEN 15 " if several else "") + f"WHEN contains(lower(name), '{whole}') THEN 10 ELSE 0 END"
    )


@query(sql(f"SELECT file_path, {_relevance('queue snapshot')} AS relevance, {_IS_TEST} AS is_test FROM n", N))
def path_relevance(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("file_path")
    return views.nodes(spark, folder, "file_path").select("file_path", fx.path_relevance(path, "queue snapshot").alias("relevance"), fx.is_test_path(path).alias("is_test"))


@query(sql(f"SELECT id, {_KIND_BONUS} AS points, {_name_bonus('store queue')} AS name_points FROM n", N))
def kind_bonus_rank(spark: SparkSession, folder: str) -> DataFrame:
    return views.nodes(spark, folder, "kind", "name").select("id", fx.kind_bonus(F.col("kind")).alias("points"), fx.name_match_bonus(F.col("name"), "store queue").alias("name_points"))


@query(
    sql(
        f"""SELECT id, round(total, 6) AS score FROM (
          SELECT id, base + {_KIND_BONUS} + {_relevance('queue snapshot')} + {_name_bonus('queue snapshot')} AS total FROM (
            SELECT id, kind, name, file_path, score AS base FROM h UNION ALL
            SELECT id, kind, name, file_path, (SELECT max(score) FROM h) FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS r FROM n WHERE lower(name) IN ('queue', 'snapshot') AND kind IN ('function', 'method')) WHERE r <= 20 AND id NOT IN (SELECT id FROM h)))
        ORDER BY round(total, 9) DESC, id LIMIT 30""",
        N,
        recursive=_bm25(["queue", "snapshot"]) + ", h AS (SELECT * FROM b WHERE kind IN ('function', 'method') ORDER BY round(score, 9) DESC, id LIMIT 150)",
    )
)
def search_rescored(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(_nodes(spark, folder), "kind:function kind:method queue snapshot", limit=30).select("id", F.round("score", 6).alias("score"))


@query(
    sql(
        """SELECT id, score FROM (SELECT id, name, score, row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, id) AS r FROM (
          SELECT n.*, CASE WHEN file_path IN (SELECT file_path FROM n WHERE lower(name) IN (SELECT name FROM (SELECT lower(name) AS name, count(DISTINCT file_path) AS c FROM n WHERE lower(name) IN ('logevent', 'get', 'openqueue') GROUP BY 1) WHERE c < 10) AND lower(name) IN ('logevent', 'get', 'openqueue'))
          THEN 21.0 ELSE 1.0 END::double AS score FROM n WHERE lower(name) IN ('logevent', 'get', 'openqueue'))) WHERE r <= 17 ORDER BY score DESC, id LIMIT 50""",
        N,
    )
)
def exact_name_colocated(spark: SparkSession, folder: str) -> DataFrame:
    return search.exact_names(_nodes(spark, folder), ["logEvent", "get", "openQueue"]).select("id", "score")


@query(sql("SELECT id, name FROM n WHERE contains(lower(name), 'queue') AND NOT starts_with(lower(name), 'queue') ORDER BY length(name), id LIMIT 60", N))
def substring_excl_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return search.substring_names(_nodes(spark, folder), "queue", True, limit=60).select("id", "name")


@query(sql("SELECT id, name FROM n WHERE (contains(name, 'Queue') OR list_contains(list_transform(string_split_regex(name, '[\\s._:/\\\\]+'), lambda w: lower(w)), 'queue')) AND NOT starts_with(lower(name), 'queue')", N))
def camel_boundary(spark: SparkSession, folder: str) -> DataFrame:
    return views.nodes(spark, folder, "name").filter(fx.camel_boundary(F.col("name"), "queue")).select("id", "name")


@query(sql("SELECT id, name FROM n WHERE name = 'LogEvent.logEvent' OR (name = 'logEvent' AND (ends_with(qualified_name, 'log::logEvent') OR list_contains(string_split(regexp_replace(file_path, '\\.[^./]*$', ''), '/'), 'log') OR list_contains(string_split(qualified_name, '::'), 'log')))", N))
def symbol_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return search.symbol_matches(_nodes(spark, folder), "log.logEvent").select("id", "name")


@query(
    sql(
        """SELECT file_path, sum(CASE role WHEN 'entry' THEN 10 WHEN 'neighbour' THEN 3 ELSE 1 END)::bigint AS score, count(*) AS hits FROM (
          SELECT id AS node_id, 'entry' AS role FROM n WHERE name = 'logEvent' UNION ALL
          SELECT DISTINCT e.source, 'neighbour' FROM e JOIN n t ON t.id = e.target WHERE t.name = 'logEvent' AND e.kind <> 'contains') x JOIN n ON n.id = x.node_id GROUP BY 1""",
        N, E,
    )
)
def file_score_groups(spark: SparkSession, folder: str) -> DataFrame:
    from graphloom.operators.stats import file_scores

    nodes, edges = views.nodes(spark, folder, "name", "file_path"), views.edges(spark, folder)
    entry = nodes.filter("name = 'logEvent'")
    near = edges.filter("kind <> 'contains'").join(entry.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("node_id"), F.lit("neighbour").alias("role")).distinct()
    return file_scores(nodes, entry.select(F.col("id").alias("node_id"), F.lit("entry").alias("role")).unionAll(near))


@query()
def relevant_context(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols that answer a question: several channels, multi-term ranking, traversal and caps have no short SQL."""
    nodes = views.nodes(spark, folder, *search.COLUMNS, "start_line", "end_line", "is_exported")
    return context.relevant(nodes, views.edges(spark, folder), "How does openQueue store a snapshot of the queue?").nodes.select("id", "role", F.round("score", 6).alias("score"))
