"""Graph operators over (nodes, edges): hops, traversals, impact, hierarchies, dependencies.

Traversals are level loops: each level joins the frontier with the links, drops what was seen with an anti join and is
written to the checkpoint folder, so plans stay short and lost executors repeat one level. Results are defined by least
depth. Inputs are the clean views of operators.model; ends that no node has drop out in the joins with nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import loop_members
from graphloom.operators.model import CALL_KINDS, CONTAINERS
from graphloom.session import cut_lineage


@dataclass(frozen=True)
class Traversal:
    """Options of a traversal; kinds of None stand for all."""

    depth: int = 1 << 30
    edge_kinds: Sequence[str] | None = None
    node_kinds: Sequence[str] | None = None
    direction: str = "outgoing"
    limit: int | None = None
    include_start: bool = True


def of_kinds(edges: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    return edges if kinds is None else edges.filter(F.col("kind").isin(list(kinds)))


def adjacent(edges: DataFrame, node_id: str, direction: str = "outgoing", kinds: Sequence[str] | None = None) -> DataFrame:
    """Links at one node, out, in or both (a bag)."""
    edges = of_kinds(edges, kinds)
    out, into = edges.filter(F.col("source") == node_id), edges.filter(F.col("target") == node_id)
    return out if direction == "outgoing" else into if direction == "incoming" else out.unionAll(into)


def neighbours(edges: DataFrame, nodes: DataFrame, node_id: str, incoming: bool, kinds: Sequence[str] | None = CALL_KINDS) -> DataFrame:
    """Callers (incoming) or callees at one hop: (node_id, kind, edge_id), a row for each link but for loops to itself."""
    near, far = ("target", "source") if incoming else ("source", "target")
    hops = of_kinds(edges, kinds).filter((F.col(near) == node_id) & (F.col("source") != F.col("target")))
    return hops.join(nodes.select("id"), hops[far] == nodes["id"]).select(F.col("id").alias("node_id"), "kind", "edge_id")


def reach(edges: DataFrame, starts: DataFrame, depth: int = 1 << 30, kinds: Sequence[str] | None = None, direction: str = "outgoing", through: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Least depth of all nodes within reach of each start: (origin, node_id, depth).

    starts is (origin, node_id); an origin may have several. through limits the walk to nodes it holds (id). limit ends
    the walk after the level in which an origin has that many nodes in all, and cuts by (depth, node_id).
    """
    links = of_kinds(edges, kinds).select("source", "target")
    if direction == "incoming":
        links = links.select(F.col("target").alias("a"), F.col("source").alias("b"))
    elif direction == "both":
        links = links.select(F.col("source").alias("a"), F.col("target").alias("b")).unionAll(links.select(F.col("target").alias("a"), F.col("source").alias("b")))
    else:
        links = links.select(F.col("source").alias("a"), F.col("target").alias("b"))
    if through is not None:
        links = links.join(through.select(F.col("id").alias("b")), "b", "left_semi")
    seen = cut_lineage(starts.select("origin", "node_id", F.lit(0).alias("depth")).distinct())
    frontier, level = seen, 0
    if depth > 1:  # levels join with one written table, spread by the node they start from
        links = cut_lineage(links.distinct().repartition("a"))
    while level < depth and not frontier.isEmpty():
        level += 1
        found = frontier.join(links, F.col("node_id") == F.col("a")).select("origin", F.col("b").alias("node_id")).distinct()
        frontier = cut_lineage(found.join(seen, ["origin", "node_id"], "left_anti").withColumn("depth", F.lit(level)))
        seen = cut_lineage(seen.unionAll(frontier)) if level % 4 == 0 else seen.unionAll(frontier)
        if limit is not None and seen.groupBy("origin").count().filter(F.col("count") < limit).isEmpty():
            break
    if limit is not None:
        order = W.partitionBy("origin").orderBy("depth", "node_id")
        seen = seen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).drop("r")
    return seen


def start(nodes: DataFrame, *ids: str) -> DataFrame:
    """Starts of a traversal: the given nodes that exist."""
    return nodes.filter(F.col("id").isin(list(ids))).select(F.col("id").alias("origin"), F.col("id").alias("node_id"))


def traverse(edges: DataFrame, nodes: DataFrame, node_id: str, options: Traversal = Traversal()) -> DataFrame:
    """Breadth first from one node: (node_id, depth). Nodes of other kinds than asked for are neither shown nor passed."""
    through = nodes.filter(F.col("kind").isin(list(options.node_kinds))) if options.node_kinds else nodes
    found = reach(edges, start(nodes, node_id), options.depth, options.edge_kinds, options.direction, through, options.limit).select("node_id", "depth")
    return found if options.include_start else found.filter("depth > 0")


def hops(edges: DataFrame, nodes: DataFrame, node_id: str, depth: int, incoming: bool, kinds: Sequence[str] = tuple(CALL_KINDS)) -> DataFrame:
    """Nodes within depth hops over call-like links, without the node itself: (node_id, depth)."""
    found = reach(edges, start(nodes, node_id), depth, kinds, "incoming" if incoming else "outgoing", through=nodes)
    return found.filter("depth > 0").select("node_id", "depth")


def call_graph(edges: DataFrame, nodes: DataFrame, node_id: str, depth: int = 2) -> DataFrame:
    """The node, its callers and its callees within depth hops: distinct (node_id)."""
    callers, callees = hops(edges, nodes, node_id, depth, True), hops(edges, nodes, node_id, depth, False)
    return callers.select("node_id").unionAll(callees.select("node_id")).unionAll(start(nodes, node_id).select("node_id")).distinct()


def impact(edges: DataFrame, nodes: DataFrame, node_id: str, depth: int = 3) -> DataFrame:
    """What a change of a node reaches: (node_id, depth), over all incoming links; members of a container cost nothing.

    A reached container (class, interface, ...) brings in what it contains at its own depth, at any nesting.
    """
    known = nodes.select("id", "kind")
    known = cut_lineage(known)
    into = cut_lineage(edges.join(known.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target").distinct().repartition("target"))
    boxes = known.filter(F.col("kind").isin(CONTAINERS)).select(F.col("id").alias("source"))
    inside = cut_lineage(edges.filter("kind = 'contains'").join(boxes, "source", "left_semi").join(known.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target").distinct().repartition("source"))
    seen = cut_lineage(nodes.filter(F.col("id") == node_id).select(F.col("id").alias("node_id"), F.lit(0).alias("depth")))
    level, fresh = 0, seen
    while True:
        grown = fresh
        while not grown.isEmpty():  # members, and members of members, at the same depth
            found = grown.join(inside, F.col("node_id") == F.col("source")).select(F.col("target").alias("node_id")).distinct()
            grown = cut_lineage(found.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(level)))
            seen, fresh = seen.unionAll(grown), fresh.unionAll(grown)
        level += 1
        if level > depth:
            return seen
        seen, fresh = cut_lineage(seen), cut_lineage(fresh)
        found = fresh.join(into, F.col("node_id") == F.col("target")).select(F.col("source").alias("node_id")).distinct()
        fresh = cut_lineage(found.join(seen, "node_id", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionAll(fresh)


def _first_edge(found: DataFrame) -> DataFrame:
    """One link a node: containment before calls before others, then the least edge_id."""
    rank = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)
    best = found.groupBy("node_id", "depth").agg(F.min_by(F.struct("parent_id", "edge_id", "kind"), F.struct(rank, "edge_id")).alias("e"))
    return best.select("node_id", "depth", "e.parent_id", "e.edge_id", "e.kind")


def tree_edges(edges: DataFrame, found: DataFrame, direction: str = "outgoing", kinds: Sequence[str] | None = None) -> DataFrame:
    """The links that lead a traversal to what it found: (node_id, depth, parent_id, edge_id, kind), one for each node but the root.

    found is (node_id, depth). A link leads from a node one level nearer; containment comes before calls before all else,
    then the least edge_id.
    """
    links = of_kinds(edges, kinds).select("edge_id", "kind", F.col("source").alias("parent_id"), F.col("target").alias("node_id"))
    turned = links.select("edge_id", "kind", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("node_id"))
    links = turned if direction == "incoming" else links.unionAll(turned) if direction == "both" else links
    near = found.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("above"))
    return _first_edge(links.join(found, "node_id").join(near, "parent_id").filter("above = depth - 1"))


def impact_edges(edges: DataFrame, nodes: DataFrame, found: DataFrame, node_id: str) -> DataFrame:
    """The links of impact(): (node_id, depth, parent_id, edge_id, kind); a member hangs on its container at the same depth."""
    level = found.join(nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("own_kind")), "node_id")
    near = level.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("above"), F.col("own_kind").alias("above_kind"))
    into = edges.select("edge_id", "kind", F.col("target").alias("parent_id"), F.col("source").alias("node_id"))
    inside = edges.filter("kind = 'contains'").select("edge_id", "kind", F.col("source").alias("parent_id"), F.col("target").alias("node_id"))
    rows = found.filter(F.col("node_id") != node_id)
    reached = into.join(rows, "node_id").join(near, "parent_id").filter("above = depth - 1")
    member = inside.join(rows, "node_id").join(near, "parent_id").filter((F.col("above") == F.col("depth")) & F.col("above_kind").isin(CONTAINERS) & (F.col("parent_id") != F.col("node_id")))
    return _first_edge(reached.unionByName(member))


def path_edges(edges: DataFrame, path: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """The links along a path (step, node_id): (step, source, target, edge_id), of several the least edge_id."""
    ends = path.select(F.col("node_id").alias("source"), (F.col("step") + 1).alias("step")).join(path.select(F.col("node_id").alias("target"), "step"), "step")
    return of_kinds(edges, kinds).join(ends, ["source", "target"]).groupBy("step", "source", "target").agg(F.min("edge_id").alias("edge_id"))


def type_hierarchy(edges: DataFrame, nodes: DataFrame, node_id: str, both: bool = True) -> DataFrame:
    """Super types and, with both, sub types at any distance: (node_id, role, depth)."""
    kinds, first = ["extends", "implements"], start(nodes, node_id)
    up = reach(edges, first, kinds=kinds, through=nodes).filter("depth > 0").select("node_id", F.lit("ancestor").alias("role"), "depth")
    if not both:
        return up
    down = reach(edges, first, kinds=kinds, direction="incoming", through=nodes).filter("depth > 0").select("node_id", F.lit("descendant").alias("role"), "depth")
    return up.unionAll(down)


def find_path(edges: DataFrame, nodes: DataFrame, source: str, target: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """A shortest path over outgoing links: (step, node_id), step 0 being source; of equal ones the least predecessors.

    No rows if an end is missing or out of reach.
    """
    links = cut_lineage(of_kinds(edges, kinds).join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target").distinct().repartition("source"))
    levels = [cut_lineage(nodes.filter(F.col("id") == source).select(F.col("id").alias("node_id"), F.lit(None).cast("string").alias("parent")))]
    seen = levels[0].select("node_id")
    while not levels[-1].isEmpty() and levels[-1].filter(F.col("node_id") == target).isEmpty():
        found = levels[-1].join(links, F.col("node_id") == F.col("source")).groupBy("target").agg(F.min("source").alias("parent"))
        levels.append(cut_lineage(found.select(F.col("target").alias("node_id"), "parent").join(seen, "node_id", "left_anti")))
        seen = cut_lineage(seen.unionAll(levels[-1].select("node_id")))
    path, at = [], target
    for step in range(len(levels) - 1, -1, -1):
        row = levels[step].filter(F.col("node_id") == at).first()
        if row is None:
            path = []
            break
        path.append((step, at))
        at = row["parent"]
    return nodes.sparkSession.createDataFrame(path, "step int, node_id string")


def usages(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """All incoming links with an existing source, contains included: (node_id, kind, edge_id)."""
    return neighbours(edges.filter(F.lit(True)), nodes, node_id, True, None)


def children(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Distinct nodes that the node contains."""
    found = edges.filter((F.col("kind") == "contains") & (F.col("source") == node_id)).select(F.col("target").alias("id")).distinct()
    return nodes.join(found, "id", "left_semi")


def first_parents(edges: DataFrame) -> DataFrame:
    """The container of the smallest edge_id of each contained node: (node_id, parent_id)."""
    return edges.filter("kind = 'contains'").groupBy(F.col("target").alias("node_id")).agg(F.min_by("source", "edge_id").alias("parent_id"))


def ancestors(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Containers upwards from a node along first parents, nearest first, up to a repeated or unknown one: (depth, node_id)."""
    parents, known = cut_lineage(first_parents(edges)), nodes.select(F.col("id").alias("parent_id"))
    chain, seen, at = [], {node_id}, node_id
    while row := parents.filter(F.col("node_id") == at).join(known, "parent_id", "left_semi").first():
        if row["parent_id"] in seen:
            break
        at = row["parent_id"]
        seen.add(at)
        chain.append((len(chain) + 1, at))
    return nodes.sparkSession.createDataFrame(chain, "depth int, node_id string")


def dead_code(edges: DataFrame, nodes: DataFrame, kinds: Sequence[str] = ("function", "method", "class")) -> DataFrame:
    """Symbols of some kinds that are not exported and that no link but contains leads to."""
    used = edges.filter("kind <> 'contains'").select(F.col("target").alias("id"))
    return nodes.filter(F.col("kind").isin(list(kinds)) & ~F.coalesce("is_exported", F.lit(False))).join(used, "id", "left_anti")


def edges_between(edges: DataFrame, ids: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Links whose ends are both among ids (id)."""
    ids = ids.select("id").distinct()
    return of_kinds(edges, kinds).join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def filtered_subgraph(edges: DataFrame, nodes: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that satisfy a predicate and the links among them."""
    kept = nodes.filter(predicate)
    return kept, edges_between(edges, kept)


def node_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degrees of every node: (node_id, in_degree, out_degree, calls_in, calls_out, children)."""
    out = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).alias("ci"), (F.col("kind") == "calls").cast("int").alias("co"), (F.col("kind") == "contains").cast("int").alias("ch"))
    into = edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), (F.col("kind") == "calls").cast("int").alias("ci"), F.lit(0).alias("co"), F.lit(0).alias("ch"))
    sums = out.unionAll(into).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("i", "o", "ci", "co", "ch")])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return nodes.select("id").join(sums, "id", "left").select(F.col("id").alias("node_id"), zero("i").alias("in_degree"), zero("o").alias("out_degree"), zero("ci").alias("calls_in"), zero("co").alias("calls_out"), zero("ch").alias("children"))


def file_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files that the import links of a file's own node lead to: distinct (path, depends_on), never the file itself."""
    own = nodes.filter("kind = 'file'").select(F.col("id").alias("source"), F.col("file_path").alias("path"))
    other = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
    return edges.filter("kind = 'imports'").select("source", "target").distinct().join(own, "source").join(other, "target").filter("path <> depends_on").select("path", "depends_on").distinct()


def file_dependents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files with import links to a file's node or to one of its exported symbols: distinct (path, dependent)."""
    own = nodes.filter("kind = 'file' OR is_exported").select(F.col("id").alias("target"), F.col("file_path").alias("path"))
    other = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("dependent"))
    return edges.filter("kind = 'imports'").select("source", "target").distinct().join(own, "target").join(other, "source").filter("path <> dependent").select("path", "dependent").distinct()


def file_links(edges: DataFrame, nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Files whose symbols have links of some kinds to those of other files: distinct (path, depends_on)."""
    own = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path"))
    other = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
    return of_kinds(edges, kinds).select("source", "target").distinct().join(own, "source").join(other, "target").filter("path <> depends_on").select("path", "depends_on").distinct()


def file_cycles(edges: DataFrame, nodes: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Files on circular dependencies: (cycle_id, path), cycle_id being the smallest path of the circle.

    Dependencies are the imports of files or, with kinds, links of those kinds between any symbols of two files.
    """
    found = file_links(edges, nodes, kinds) if kinds else file_dependencies(edges, nodes)
    links = found.select(F.col("path").alias("parent"), F.col("depends_on").alias("child"))
    return loop_members(links).select(F.col("loop").alias("cycle_id"), F.col("node").alias("path"))


def affected_tests(edges: DataFrame, nodes: DataFrame, changed: Sequence[str], is_test: Column, depth: int = 5) -> DataFrame:
    """Test files that depend on changed files within depth steps, changed tests included: distinct (path), sorted.

    is_test is a predicate over a column path. Steps do not go on from test files.
    """
    spark = nodes.sparkSession
    links = cut_lineage(file_dependents(edges, nodes))
    seen = spark.createDataFrame([(p,) for p in dict.fromkeys(changed)], "path string")
    fresh = seen
    for _ in range(depth):
        found = fresh.filter(~is_test).join(links, "path").select(F.col("dependent").alias("path")).distinct()
        fresh = cut_lineage(found.join(seen, "path", "left_anti"))
        if fresh.isEmpty():
            break
        seen = cut_lineage(seen.unionAll(fresh))
    return seen.filter(is_test).distinct().orderBy("path")


def module_structure(nodes: DataFrame) -> DataFrame:
    """Directories and their files in order: (directory, files array)."""
    files = nodes.filter("kind = 'file'").select("file_path").distinct()
    folder = F.when(F.instr("file_path", "/") == 0, ".").otherwise(F.regexp_replace("file_path", "/[^/]*$", ""))
    return files.groupBy(folder.alias("directory")).agg(F.array_sort(F.collect_list("file_path")).alias("files"))


def node_context(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """What surrounds a symbol: distinct (role, node_id), role being focal, ancestor, child, incoming, outgoing, type or import.

    Links other than contains give incoming and outgoing; types are ends of type_of and returns links; imports are those
    of the node of the symbol's file. No rows if the symbol does not exist.
    """
    known = nodes.select("id", "kind", "file_path")
    focal = known.filter(F.col("id") == node_id)
    chain = ancestors(edges, nodes, node_id).join(focal.select(F.lit(1)).limit(1), how="left_semi").select(F.lit("ancestor").alias("role"), "node_id")
    out, into = edges.filter(F.col("source") == node_id), edges.filter(F.col("target") == node_id)
    file_node = known.filter("kind = 'file'").join(focal.select("file_path"), "file_path", "left_semi").select(F.col("id").alias("source"))
    rows = out.filter("kind = 'contains'").select(F.lit("child").alias("role"), F.col("target").alias("id"))
    rows = rows.unionAll(into.filter("kind <> 'contains'").select(F.lit("incoming"), "source")).unionAll(out.filter("kind <> 'contains'").select(F.lit("outgoing"), "target"))
    rows = rows.unionAll(out.filter("kind IN ('type_of', 'returns')").select(F.lit("type"), "target")).unionAll(edges.filter("kind = 'imports'").join(file_node, "source", "left_semi").select(F.lit("import"), "target"))
    rows = rows.join(known.select("id"), "id", "left_semi").select("role", F.col("id").alias("node_id")).unionAll(focal.select(F.lit("focal"), "id"))
    return rows.unionAll(chain).distinct()
