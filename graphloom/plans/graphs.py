"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.operators import graph
from graphloom.operators.hierarchy import hierarchy
from graphloom.plans import views
from graphloom.plans.views import BOX, HOT, TYPE, E, N, sql

QUERIES, ORACLES = {}, {}
CALLS = "('calls', 'references', 'imports')"
CHANGED = ["corelib/runtime/log.ts", "corelib/runtime/types.ts", "corelib/i18n/catalog.py"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _both(spark: SparkSession, folder: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    return views.edges(spark, folder), views.nodes(spark, folder, *(columns or ("kind",)))


def _walk(step: str, depth: int | None, first: str) -> str:
    """Common table walk(node, depth): everything within depth steps of first."""
    bound = f" AND w.depth < {depth}" if depth is not None else ""
    return f"walk(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{first}' UNION SELECT x.b, w.depth + 1 FROM walk w JOIN ({step}) x ON x.a = w.node JOIN n ON n.id = x.b WHERE true{bound})"


def _within(step: str, depth: int, first: str) -> str:
    return sql("SELECT node AS node_id, min(depth)::int AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0", N, E, recursive=_walk(step, depth, first))


@query(sql(f"SELECT e.source AS node_id, e.kind, e.edge_id FROM e JOIN n ON n.id = e.source WHERE e.target = '{HOT}' AND e.source <> e.target AND e.kind IN {CALLS}", N, E))
def callers_1hop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(*_both(spark, folder), HOT, True)


@query(sql(f"SELECT e.target AS node_id, e.kind, e.edge_id FROM e JOIN n ON n.id = e.target WHERE e.source = '{BOX}' AND e.source <> e.target AND e.kind IN {CALLS}", N, E))
def callees_1hop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(*_both(spark, folder), BOX, False)


@query(_within(f"SELECT target AS a, source AS b FROM e WHERE kind IN {CALLS}", 2, HOT))
def callers_khop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.hops(*_both(spark, folder), HOT, 2, True)


@query(_within(f"SELECT source AS a, target AS b FROM e WHERE kind IN {CALLS}", 4, HOT))
def callees_khop(spark: SparkSession, folder: str) -> DataFrame:
    return graph.hops(*_both(spark, folder), HOT, 4, False)


@query(
    sql(
        f"SELECT DISTINCT node AS node_id FROM (SELECT node FROM up UNION ALL SELECT node FROM down) ",
        N, E,
        recursive=f"""up(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{HOT}' UNION SELECT e.source, u.depth + 1 FROM up u JOIN e ON e.target = u.node AND e.kind IN {CALLS} JOIN n ON n.id = e.source WHERE u.depth < 2),
        down(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{HOT}' UNION SELECT e.target, d.depth + 1 FROM down d JOIN e ON e.source = d.node AND e.kind IN {CALLS} JOIN n ON n.id = e.target WHERE d.depth < 2)""",
    )
)
def call_graph(spark: SparkSession, folder: str) -> DataFrame:
    return graph.call_graph(*_both(spark, folder), HOT, 2)


@query(sql("SELECT node AS node_id, min(depth)::int AS depth FROM walk GROUP BY 1", N, E, recursive=_walk("SELECT source AS a, target AS b FROM e", 3, BOX)))
def bfs_levels(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = _both(spark, folder)
    return graph.traverse(edges, nodes, BOX, graph.Traversal(depth=3))


@query(sql("SELECT node AS node_id, min(depth)::int AS depth FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 40", N, E, recursive=_walk("SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e", 2, BOX)))
def bfs_both_limited(spark: SparkSession, folder: str) -> DataFrame:
    """The first 40 nodes around a module in both directions, by depth and id; the limit is a traversal's own."""
    edges, nodes = _both(spark, folder)
    return graph.traverse(edges, nodes, BOX, graph.Traversal(depth=2, direction="both", limit=40))


@query(
    sql(
        "SELECT node AS node_id, min(depth)::int AS depth FROM walk GROUP BY 1",
        N, E,
        recursive=f"""links AS (SELECT e.target AS a, e.source AS b, 1 AS cost FROM e JOIN n ON n.id = e.source
          UNION SELECT e.source, e.target, 0 FROM e JOIN n ON n.id = e.source AND n.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum') WHERE e.kind = 'contains'),
        walk(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{TYPE}' UNION SELECT l.b, w.depth + l.cost FROM walk w JOIN links l ON l.a = w.node JOIN n ON n.id = l.b WHERE w.depth + l.cost <= 2)""",
    )
)
def impact_radius(spark: SparkSession, folder: str) -> DataFrame:
    return graph.impact(*_both(spark, folder), TYPE, 2)


@query(
    sql(
        "SELECT node AS node_id, 'ancestor' AS role, min(depth)::int AS depth FROM up GROUP BY 1 HAVING min(depth) > 0 UNION ALL SELECT node, 'descendant', min(depth)::int FROM down GROUP BY 1 HAVING min(depth) > 0",
        N, E,
        recursive=f"""up(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{TYPE}' UNION SELECT e.target, u.depth + 1 FROM up u JOIN e ON e.source = u.node AND e.kind IN ('extends', 'implements') JOIN n ON n.id = e.target WHERE u.depth < 60),
        down(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{TYPE}' UNION SELECT e.source, d.depth + 1 FROM down d JOIN e ON e.target = d.node AND e.kind IN ('extends', 'implements') JOIN n ON n.id = e.source WHERE d.depth < 60)""",
    )
)
def type_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return graph.type_hierarchy(*_both(spark, folder), TYPE)


@query(sql(f"SELECT e.source AS node_id, e.kind, e.edge_id FROM e JOIN n ON n.id = e.source WHERE e.target = '{TYPE}' AND e.source <> e.target", N, E))
def usages(spark: SparkSession, folder: str) -> DataFrame:
    return graph.usages(*_both(spark, folder), TYPE)


@query(sql(f"SELECT id, kind FROM n WHERE id IN (SELECT target FROM e WHERE source = '{BOX}' AND kind = 'contains')", N, E))
def children(spark: SparkSession, folder: str) -> DataFrame:
    return graph.children(*_both(spark, folder), BOX)


@query(
    sql(
        "SELECT depth::int AS depth, node AS node_id FROM chain WHERE depth > 0",
        N, E,
        recursive=f"""p AS (SELECT target AS node, arg_min(source, edge_id) AS parent FROM e WHERE kind = 'contains' GROUP BY 1),
        chain(node, depth, seen) AS (SELECT '{HOT}', 0, ['{HOT}'] UNION ALL SELECT p.parent, c.depth + 1, list_append(c.seen, p.parent) FROM chain c JOIN p ON p.node = c.node JOIN n ON n.id = p.parent WHERE NOT list_contains(c.seen, p.parent))""",
    )
)
def ancestors_chain(spark: SparkSession, folder: str) -> DataFrame:
    return graph.ancestors(*_both(spark, folder), HOT)


@query(sql(f"SELECT min(depth)::int AS steps FROM walk WHERE node = '{TYPE}'", N, E, recursive=_walk("SELECT source AS a, target AS b FROM e", 8, BOX)))
def find_path_steps(spark: SparkSession, folder: str) -> DataFrame:
    return graph.find_path(*_both(spark, folder), BOX, TYPE).agg(F.max("step").alias("steps"))


@query(sql("SELECT id, kind FROM n WHERE kind IN ('function', 'method', 'class') AND NOT coalesce(is_exported, false) AND id NOT IN (SELECT target FROM e WHERE kind <> 'contains')", N, E))
def dead_code(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dead_code(*_both(spark, folder, "kind", "is_exported")).select("id", "kind")


_DEPENDS = "d AS (SELECT DISTINCT a.file_path AS path, b.file_path AS depends_on FROM e JOIN n a ON a.id = e.source AND a.kind = 'file' JOIN n b ON b.id = e.target WHERE e.kind = 'imports' AND a.file_path <> b.file_path)"
_DEPENDENTS = "r AS (SELECT DISTINCT b.file_path AS path, a.file_path AS dependent FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target AND (b.kind = 'file' OR b.is_exported) WHERE e.kind = 'imports' AND a.file_path <> b.file_path)"


@query(sql("SELECT path, depends_on FROM d", N, E, _DEPENDS))
def file_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return graph.file_dependencies(*_both(spark, folder, "kind", "file_path"))


@query(sql("SELECT path, dependent FROM r", N, E, _DEPENDENTS))
def file_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return graph.file_dependents(*_both(spark, folder, "kind", "file_path", "is_exported"))


@query(
    sql(
        "SELECT min(y.b) AS cycle_id, x.a AS path FROM reach x JOIN reach y ON x.a = y.a JOIN reach z ON z.a = y.b AND z.b = y.a WHERE x.a = x.b GROUP BY x.a",
        N, E, _DEPENDS,
        recursive="reach(a, b) AS (SELECT path, depends_on FROM d UNION SELECT r.a, d.depends_on FROM reach r JOIN d ON d.path = r.b)",
    )
)
def file_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graph.file_cycles(*_both(spark, folder, "kind", "file_path"))


_CALLED = "d AS (SELECT DISTINCT a.file_path AS path, b.file_path AS depends_on FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind IN ('calls', 'contains', 'extends') AND a.file_path <> b.file_path)"


@query(
    sql(
        "SELECT min(y.b) AS cycle_id, x.a AS path FROM reach x JOIN reach y ON x.a = y.a JOIN reach z ON z.a = y.b AND z.b = y.a WHERE x.a = x.b GROUP BY x.a",
        N, E, _CALLED,
        recursive="reach(a, b) AS (SELECT path, depends_on FROM d UNION SELECT r.a, d.depends_on FROM reach r JOIN d ON d.path = r.b)",
    )
)
def file_cycles_of_links(spark: SparkSession, folder: str) -> DataFrame:
    """Files on circles of calls, containment and inheritance between symbols."""
    return graph.file_cycles(*_both(spark, folder, "kind", "file_path"), kinds=["calls", "contains", "extends"])


_PATHS = f"""walk(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{BOX}' UNION SELECT e.target, w.depth + 1 FROM walk w JOIN e ON e.source = w.node JOIN n ON n.id = e.target WHERE w.depth < 8),
  level AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1),
  back(node, depth) AS (SELECT node, depth FROM level WHERE node = '{TYPE}' UNION ALL SELECT (SELECT min(e.source) FROM e JOIN level l ON l.node = e.source WHERE e.target = b.node AND l.depth = b.depth - 1), b.depth - 1 FROM back b WHERE b.depth > 0)"""


@query(sql("SELECT depth::int AS step, node AS node_id FROM back", N, E, recursive=_PATHS))
def find_path_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of a shortest path."""
    return graph.find_path(*_both(spark, folder), BOX, TYPE)


_IS_TEST = r"regexp_matches(path, '\.spec\.|\.test\.|(^|/)__tests__/|(^|/)tests?/|(^|/)e2e/|(^|/)spec/')"


@query(
    sql(
        f"SELECT DISTINCT path FROM walk WHERE {_IS_TEST}",
        N, E, _DEPENDENTS,
        recursive=f"walk(path, depth) AS (SELECT unnest({CHANGED!r}), 0 UNION SELECT r.dependent, w.depth + 1 FROM (SELECT * FROM walk WHERE NOT {_IS_TEST}) w JOIN r ON r.path = w.path WHERE w.depth < 5)",
    )
)
def affected_tests(spark: SparkSession, folder: str) -> DataFrame:
    return graph.affected_tests(*_both(spark, folder, "kind", "file_path", "is_exported"), CHANGED, fx.is_affected_test(F.col("path")))


@query(
    sql(
        """SELECT n.id AS node_id, coalesce(i.c, 0)::bigint AS in_degree, coalesce(o.c, 0)::bigint AS out_degree, coalesce(i.k, 0)::bigint AS calls_in, coalesce(o.k, 0)::bigint AS calls_out, coalesce(o.h, 0)::bigint AS children FROM n
        LEFT JOIN (SELECT target AS id, count(*) AS c, count(*) FILTER (kind = 'calls') AS k FROM e GROUP BY 1) i USING (id)
        LEFT JOIN (SELECT source AS id, count(*) AS c, count(*) FILTER (kind = 'calls') AS k, count(*) FILTER (kind = 'contains') AS h FROM e GROUP BY 1) o USING (id)""",
        N, E,
    )
)
def node_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return graph.node_metrics(*_both(spark, folder))


@query(sql("SELECT edge_id, source, target FROM e WHERE kind = 'calls' AND source IN (SELECT id FROM n WHERE kind = 'method') AND target IN (SELECT id FROM n WHERE kind = 'method')", N, E))
def edges_between(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = _both(spark, folder)
    return graph.edges_between(edges, nodes.filter("kind = 'method'"), ["calls"]).select("edge_id", "source", "target")


@query(sql("SELECT edge_id FROM e WHERE source IN (SELECT id FROM n WHERE language = 'python') AND target IN (SELECT id FROM n WHERE language = 'python')", N, E))
def filtered_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = _both(spark, folder, "language")
    return graph.filtered_subgraph(edges, nodes, F.col("language") == "python")[1].select("edge_id")


@query(sql("SELECT id, file_path FROM n WHERE is_exported", N))
def exported_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return views.nodes(spark, folder, "file_path", "is_exported").filter("is_exported").select("id", "file_path")


@query(sql("SELECT CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS directory, list_sort(list(DISTINCT file_path)) AS files FROM n WHERE kind = 'file' AND file_path IS NOT NULL GROUP BY 1", N))
def module_structure(spark: SparkSession, folder: str) -> DataFrame:
    return graph.module_structure(views.nodes(spark, folder, "kind", "file_path"))


@query(sql("SELECT kind, depth::int AS depth, count(*) AS symbols FROM (SELECT node, min(depth) AS depth FROM walk GROUP BY 1) JOIN n ON n.id = node GROUP BY 1, 2", N, E, recursive=_walk("SELECT target AS a, source AS b FROM e", 2, TYPE)))
def impact_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """How many symbols of each kind come within two incoming links of a class."""
    edges, nodes = _both(spark, folder)
    found = graph.reach(edges, graph.start(nodes, TYPE), 2, direction="incoming", through=nodes)
    return found.join(nodes, F.col("node_id") == F.col("id")).groupBy("kind", "depth").agg(F.count("*").alias("symbols"))


@query(
    sql(
        f"""SELECT DISTINCT role, node AS node_id FROM (SELECT 'focal' AS role, id AS node FROM n WHERE id = '{BOX}' UNION ALL SELECT 'ancestor', node FROM chain WHERE depth > 0
        UNION ALL SELECT 'child', target FROM e WHERE source = '{BOX}' AND kind = 'contains' UNION ALL SELECT 'incoming', source FROM e WHERE target = '{BOX}' AND kind <> 'contains'
        UNION ALL SELECT 'outgoing', target FROM e WHERE source = '{BOX}' AND kind <> 'contains' UNION ALL SELECT 'type', target FROM e WHERE source = '{BOX}' AND kind IN ('type_of', 'returns')
        UNION ALL SELECT 'import', target FROM e WHERE kind = 'imports' AND source IN (SELECT id FROM n WHERE kind = 'file' AND file_path IN (SELECT file_path FROM n WHERE id = '{BOX}'))) WHERE node IN (SELECT id FROM n)""",
        N, E,
        recursive=f"""p AS (SELECT target AS node, arg_min(source, edge_id) AS parent FROM e WHERE kind = 'contains' GROUP BY 1),
        chain(node, depth, seen) AS (SELECT '{BOX}', 0, ['{BOX}'] UNION ALL SELECT p.parent, c.depth + 1, list_append(c.seen, p.parent) FROM chain c JOIN p ON p.node = c.node JOIN n ON n.id = p.parent WHERE NOT list_contains(c.seen, p.parent))""",
    )
)
def node_context(spark: SparkSession, folder: str) -> DataFrame:
    return graph.node_context(*_both(spark, folder, "kind", "file_path"), BOX)


_RANK = "CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END"
_LEVELS = "level AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"


def _hung(rows: str) -> str:
    return f"SELECT node AS node_id, depth::int AS depth, parent_id, edge_id, kind FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY {_RANK}, edge_id) = 1"


@query(sql(_hung("SELECT l.node, l.depth, e.source AS parent_id, e.edge_id, e.kind FROM level l JOIN e ON e.target = l.node JOIN level p ON p.node = e.source AND p.depth = l.depth - 1"), N, E, recursive=_walk("SELECT source AS a, target AS b FROM e", 3, BOX) + ", " + _LEVELS))
def bfs_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The links of a breadth-first tree."""
    edges, nodes = _both(spark, folder)
    return graph.tree_edges(edges, graph.traverse(edges, nodes, BOX, graph.Traversal(depth=3)))


@query(
    sql(
        _hung(
            f"""SELECT l.node, l.depth, e.target AS parent_id, e.edge_id, e.kind FROM level l JOIN e ON e.source = l.node JOIN level p ON p.node = e.target AND p.depth = l.depth - 1 WHERE l.node <> '{TYPE}'
            UNION ALL SELECT l.node, l.depth, e.source, e.edge_id, e.kind FROM level l JOIN e ON e.target = l.node AND e.kind = 'contains' JOIN level p ON p.node = e.source AND p.depth = l.depth AND p.node <> l.node
            JOIN n ON n.id = p.node AND n.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum') WHERE l.node <> '{TYPE}'"""
        ),
        N, E,
        recursive=f"""links AS (SELECT e.target AS a, e.source AS b, 1 AS cost FROM e JOIN n ON n.id = e.source
          UNION SELECT e.source, e.target, 0 FROM e JOIN n ON n.id = e.source AND n.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum') WHERE e.kind = 'contains'),
        walk(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{TYPE}' UNION SELECT l.b, w.depth + l.cost FROM walk w JOIN links l ON l.a = w.node JOIN n ON n.id = l.b WHERE w.depth + l.cost <= 2), {_LEVELS}""",
    )
)
def impact_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = _both(spark, folder)
    return graph.impact_edges(edges, nodes, graph.impact(edges, nodes, TYPE, 2), TYPE)


@query(sql("SELECT b.depth::int AS step, a.node AS source, b.node AS target, min(e.edge_id) AS edge_id FROM back a JOIN back b ON b.depth = a.depth + 1 JOIN e ON e.source = a.node AND e.target = b.node GROUP BY 1, 2, 3", N, E, recursive=_PATHS))
def find_path_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes = _both(spark, folder)
    return graph.path_edges(edges, graph.find_path(edges, nodes, BOX, TYPE))


@query(
    sql(
        f"SELECT edge_id, source, target, kind FROM e WHERE kind IN {CALLS} AND source IN (SELECT node FROM up UNION SELECT node FROM down) AND target IN (SELECT node FROM up UNION SELECT node FROM down)",
        N, E,
        recursive=f"""up(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{HOT}' UNION SELECT e.source, u.depth + 1 FROM up u JOIN e ON e.target = u.node AND e.kind IN {CALLS} JOIN n ON n.id = e.source WHERE u.depth < 2),
        down(node, depth) AS (SELECT id, 0 FROM n WHERE id = '{HOT}' UNION SELECT e.target, d.depth + 1 FROM down d JOIN e ON e.source = d.node AND e.kind IN {CALLS} JOIN n ON n.id = e.target WHERE d.depth < 2)""",
    )
)
def call_graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The links among the symbols of a call graph."""
    edges, nodes = _both(spark, folder)
    found = graph.call_graph(edges, nodes, HOT, 2).select(F.col("node_id").alias("id"))
    return graph.edges_between(edges, found, ["calls", "references", "imports"]).select("edge_id", "source", "target", "kind")


_DEPTHS = """up AS (SELECT target AS node, min(source) AS parent FROM e WHERE kind = 'contains' GROUP BY 1),
  walk(node, depth) AS (SELECT source, 0 FROM (SELECT DISTINCT source FROM e WHERE kind = 'contains') WHERE source NOT IN (SELECT node FROM up) UNION ALL SELECT u.node, w.depth + 1 FROM walk w JOIN up u ON u.parent = w.node)"""


@query(sql("SELECT n.kind, w.depth::int AS depth, count(*) AS symbols FROM walk w JOIN n ON n.id = w.node GROUP BY 1, 2", N, E, recursive=_DEPTHS))
def depth_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """How deep symbols of each kind lie in their containers."""
    edges, nodes = _both(spark, folder)
    tree = hierarchy(edges.filter("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("child")))
    return tree.filter("NOT looped").join(nodes, F.col("node_id") == F.col("id")).groupBy("kind", "depth").agg(F.count("*").alias("symbols"))
