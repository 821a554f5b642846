"""Parent-child links to full hierarchies by pointer doubling (problem 1).

Pointers are doubled over nodes with one parent only, where a node has one pointer and a round one row a node: a chain of
depth d takes log2(d) rounds, and a pointer that still leads somewhere when a round resolves nobody is on a circle or below
one. Where lines of descent join, chains shrink to the nodes they start from and the nodes with several parents are seen
again among what is left. So no step holds more rows than there are links, however many ancestors nodes have.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.model import trimmed_lower
from graphloom.operators.skew import join_heavy
from graphloom.session import cut_lineage

SEPARATOR = " > "
#: Links whose loops one task finds by itself, as pairs of numbers (measured: 250 MB for a million nodes, 600 MB where no two links share an end); more are first reduced by all tasks.
IN_TASK = 2_000_000


def parent_child(edges: DataFrame, kind: str = "contains", source: str = "source", target: str = "target", kind_col: str = "kind") -> DataFrame:
    """Links (parent, child) of one kind; rows with a null end do not count. Rows repeat as they do in edges."""
    return edges.filter(trimmed_lower(edges[kind_col]) == kind).filter(edges[source].isNotNull() & edges[target].isNotNull()).select(edges[source].alias("parent"), edges[target].alias("child"))


def _tops(chain: DataFrame) -> DataFrame:
    """(v, top, endless) of pointers (v, u), one for each v: where following them leads, or endless if to a circle.

    Each round doubles the distance of all open pointers. A round that closes nobody is the last: a chain of finite length
    has a node at each smaller distance from its end.
    """
    open_rows, closed, before = chain.select("v", "u"), None, -1
    while (left := open_rows.count()) not in (0, before):
        before = left
        ahead = open_rows.select(F.col("v").alias("u"), F.col("u").alias("w"), F.lit(False).alias("ended"))
        if closed is not None:
            ahead = ahead.unionAll(closed.select(F.col("v").alias("u"), F.col("top").alias("w"), F.lit(True).alias("ended")))
        moved = cut_lineage(open_rows.join(ahead, "u", "left").select("v", F.coalesce("w", "u").alias("u"), F.coalesce("ended", F.lit(True)).alias("ended")))
        fresh = moved.filter("ended").select("v", F.col("u").alias("top"))
        closed = fresh if closed is None else closed.unionAll(fresh)
        open_rows = moved.filter("NOT ended").select("v", "u")
    lost = open_rows.select("v", F.col("u").alias("top"), F.lit(True).alias("endless"))
    return lost if closed is None else closed.withColumn("endless", F.lit(False)).unionAll(lost)


def _endless(links: DataFrame) -> DataFrame:
    """Distinct v of links (v, u: v's parent) from which a chain of parents never ends.

    Nodes with one parent fold into the node where their chain starts; links of the others follow, and those that then
    start at a root are gone. What is left after a round without change has only parents that are left, so it is endless.
    Links only ever become fewer. The rounds follow how often lines of descent join on a path, not its length. What a round
    adds is written before the next one uses it, else plans double with each round that folds back.
    """
    links, folded, before = cut_lineage(links.select("v", "u").distinct()), [], -1
    endless = links.select("v").limit(0)
    while (left := links.count()) not in (0, before):
        before = left
        parents = cut_lineage(links.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u")))
        several = parents.filter("n > 1").select("v")
        tops = _tops(parents.filter("n = 1"))
        folded.append(tops)
        known = tops.select(F.col("v").alias("u"), "top", "endless")
        moved = links.join(several, "v", "left_semi").join(known, "u", "left").select("v", F.coalesce("top", "u").alias("u"), F.coalesce("endless", F.lit(False)).alias("endless"))
        looped = endless.select(F.col("v").alias("u"), F.lit(True).alias("before"))
        moved = cut_lineage(moved.join(looped, "u", "left").select("v", "u", (F.col("endless") | F.col("before").isNotNull()).alias("endless")).distinct())
        reached = moved.filter("endless").select("v").distinct()
        endless = endless.unionAll(reached)
        endless = cut_lineage(endless) if len(folded) % 8 == 0 else endless
        links = cut_lineage(moved.join(reached, "v", "left_anti").join(several.select(F.col("v").alias("u")), "u", "left_semi").select("v", "u").distinct())
    endless = endless.unionAll(links.select("v").distinct())
    for k, tops in enumerate(reversed(folded), 1):
        below = tops.join(endless.select(F.col("v").alias("top"), F.lit(True).alias("reached")), "top", "left").filter("endless OR reached").select("v")
        endless = endless.unionAll(cut_lineage(below) if k < len(folded) else below)
        endless = cut_lineage(endless) if k % 8 == 0 else endless
    return cut_lineage(endless)


def _endless_parents(links: DataFrame) -> DataFrame:
    """Hashes v of the parents of links (parent, child) that are on loops or below; their children are as well.

    Only nodes that are parents themselves take part, which leaves out the mass of nodes at the ends of a tree.
    """
    hashed = links.select(F.xxhash64("child").alias("v"), F.xxhash64("parent").alias("u"))
    return _endless(hashed.join(hashed.select(F.col("u").alias("v")).distinct(), "v", "left_semi"))


def loops(links: DataFrame) -> DataFrame:
    """Nodes on or below loops: (node_id, cycle_id), a row for each loop above the node; cycle_id is its smallest node.

    links is (parent, child) without nulls; repeated rows do not matter and a node that is its own parent is a loop.
    Loops that share nodes are one. Without loops, and for an empty table, the result is empty.

    The whole graph is seen once as 64-bit hashes; equal hashes of two ids could only leave too many nodes, and what is
    left is worked on by id. There, each node keeps one parent, doubling over that choice finds a circle in each part, all
    that leads back to it grows onto it, the loop shrinks to one node, and this repeats until no chain is endless. The loops
    above a node are then carried down once, over the nodes where lines of descent join.
    """
    links = links.select("parent", "child")
    core = cut_lineage(links.join(_endless_parents(links), F.xxhash64("parent") == F.col("v"), "left_semi").distinct())
    members, graph = _shrunk(core)

    ends = members.select(F.col("loop").alias("v")).distinct()
    steps = graph.select(F.col("child").alias("v"), F.col("parent").alias("u")).distinct()
    parents = cut_lineage(steps.groupBy("v").agg(F.count("*").alias("n"), F.min("u").alias("u")).join(ends.withColumn("end", F.lit(True)), "v", "left"))
    tops = cut_lineage(_tops(parents.filter("n = 1 AND end IS NULL")).select("v", "top"))
    joins = parents.filter("n > 1 OR end").select("v")
    moved = steps.join(joins, "v", "left_semi").join(tops.withColumnRenamed("v", "u"), "u", "left").select("v", F.coalesce("top", "u").alias("u")).distinct()
    moved = cut_lineage(moved)
    above = fresh = cut_lineage(ends.select("v", F.col("v").alias("loop")))
    while not fresh.isEmpty():
        reached = moved.join(fresh.select(F.col("v").alias("u"), "loop"), "u").select("v", "loop").distinct()
        fresh = cut_lineage(reached.join(above, ["v", "loop"], "left_anti"))
        above = cut_lineage(above.unionAll(fresh))
    above = above.unionAll(tops.join(above.withColumnRenamed("v", "top"), "top").select("v", "loop"))
    own = members.select("node", F.col("loop").alias("own"))
    named = above.join(own, F.col("v") == F.col("own"), "left").select(F.coalesce("node", "v").alias("node_id"), F.col("loop").alias("cycle_id"))
    return named.distinct()


def loop_members(links: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """Nodes on loops of links (parent, child) without nulls: (node, loop), loop being the smallest node of the loop.

    At most in_task distinct links are searched by one task; of more, all tasks first leave out nodes that are not on or
    below loops and shrink loops, until so few are left or none is endless. The rows do not depend on in_task.
    """
    links = cut_lineage(links.select("parent", "child").distinct())
    if links.count() <= in_task:
        return _members_in_task(links)
    core = links.join(_endless_parents(links), F.xxhash64("parent") == F.col("v"), "left_semi")
    return _shrunk(cut_lineage(core), in_task)[0]


def _members_in_task(links: DataFrame) -> DataFrame:
    """loop_members() by one task, which sees the nodes as numbers."""
    names = links.select(F.col("parent").alias("node")).unionAll(links.select("child")).distinct()
    names = cut_lineage(names.withColumn("id", F.monotonically_increasing_id()))
    numbered = links.join(names.select(F.col("node").alias("parent"), F.col("id").alias("p")), "parent").join(names.select(F.col("node").alias("child"), F.col("id").alias("c")), "child").select("p", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ends := [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]:
            found = strong_parts(*(np.concatenate(x) for x in zip(*ends)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "part"])

    found = cut_lineage(numbered.repartition(1).mapInArrow(run, "id long, part long").join(names, "id").select("node", "part"))
    return found.join(found.groupBy("part").agg(F.min("node").alias("loop")), "part").select("node", "loop")


def strong_parts(parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers on loops of links, and a number that those of the same loop share (Tarjan's algorithm, in time linear in the links)."""
    ids, ends = np.unique(np.concatenate([parent, child]), return_inverse=True)
    up, down = ends[: len(parent)], ends[len(parent) :]
    order, bounds = np.argsort(up, kind="stable"), np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.bincount(up, minlength=len(ids)), out=bounds[1:])
    below, bounds = down[order].tolist(), bounds.tolist()
    at, seen, low, part = bounds[:-1], [0] * len(ids), [0] * len(ids), [-1] * len(ids)
    visits, undecided = itertools.count(1), []
    for root in range(len(ids)):
        path = [] if seen[root] else [root]
        while path:
            v = path[-1]
            if not seen[v]:
                seen[v] = low[v] = next(visits)
                undecided.append(v)
            if at[v] < bounds[v + 1]:
                w = below[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            while low[v] == seen[v] and part[v] < 0:
                part[undecided.pop()] = v
    own = np.array(part, np.int64)
    looped = (np.bincount(own, minlength=len(ids)) > 1)[own]
    looped[up[up == down]] = True
    return ids[looped], own[looped]


def _shrunk(core: DataFrame, in_task: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of links (parent, child): the nodes on loops as (node, loop: its smallest node), and the links with each loop shrunk to that node.

    Once at most in_task links are left, one task finds all loops among them.
    """
    members = core.filter("parent = child").select(F.col("child").alias("node"), F.col("child").alias("loop"))
    graph = core.filter("parent <> child")
    links, sure = graph, False  # where links come from a walk back from loops, nearly every node is on or below one
    last = False
    while not last:
        last = in_task > 0 and graph.count() <= in_task
        circle = _members_in_task(graph).select(F.col("node").alias("v"), F.col("loop").alias("low")) if last else _strong(links)
        if circle.isEmpty():
            if sure or last:
                return members, graph
            alive = _endless(graph.select(F.col("child").alias("v"), F.col("parent").alias("u")))
            if alive.isEmpty():
                return members, graph
            links, sure = cut_lineage(graph.join(alive, F.col("child") == F.col("v"), "left_semi").join(alive, F.col("parent") == F.col("v"), "left_semi")), True
            continue
        rename = circle.select(F.col("v").alias("old"), F.col("low").alias("new"))
        kept = members.join(rename, F.col("loop") == F.col("old"), "left").select("node", F.coalesce("new", "loop").alias("loop"))
        fresh = circle.select(F.col("v").alias("node"), F.col("low").alias("loop"))
        members = cut_lineage(kept.unionAll(fresh).distinct())
        for end in ("parent", "child"):
            graph = graph.join(rename, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        links = graph = cut_lineage(graph.filter("parent <> child").distinct())
        sure = False
    return members, graph


def _strong(links: DataFrame) -> DataFrame:
    """Nodes (v, low) of loops of links (parent, child): one at least in each part whose children all have parents in it.

    Each node keeps one parent. Every node lies below the one circle that its choice leads to; what leads back to the
    circle without leaving the nodes below it is on its loop, with all its chosen ancestors. low is the loop's smallest node.
    """
    choice = cut_lineage(links.groupBy(F.col("child").alias("v")).agg(F.min("parent").alias("u")).withColumn("low", F.least("v", "u")).withColumn("moved", F.lit(True)))
    jumps, before = [choice], None
    while True:  # after 2**k steps from anywhere only circles and the rest of long tails are left
        seen = jumps[-1].agg(F.countDistinct("u"), F.max("moved")).first()
        if not seen[0]:
            return choice.select("v", "low").limit(0)
        if seen[0] == before and not seen[1]:
            break
        before = seen[0]
        ahead = jumps[-1].select(F.col("v").alias("u"), F.col("u").alias("w"), F.col("low").alias("other"))
        jumps.append(cut_lineage(jumps[-1].join(ahead, "u").select("v", F.col("w").alias("u"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("moved"))))
    strong = fresh = cut_lineage(jumps[-1].join(jumps[-1].select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("v", "low"))
    below = jumps[-1].select("v", "u").join(strong.select(F.col("v").alias("u"), "low"), "u").select("v", "low")
    near = links.join(below.select(F.col("v").alias("parent"), "low"), "parent").join(below.select(F.col("v").alias("child"), "low"), ["child", "low"])
    back = cut_lineage(near.join(strong.select(F.col("v").alias("parent")), "parent", "left_anti").select("parent", "child"))
    for level in itertools.count(1):
        found = back.join(fresh.select(F.col("v").alias("child"), "low"), "child").select(F.col("parent").alias("v"), "low").distinct().join(strong, "v", "left_anti")
        found = cut_lineage(found)
        if found.isEmpty():
            break
        for jump in jumps if level & (level - 1) == 0 else []:  # at times, all chosen ancestors of what was found
            found = cut_lineage(found.unionAll(found.join(jump.select("v", "u"), "v").select(F.col("u").alias("v"), "low")).distinct())
        fresh = cut_lineage(found.join(strong, "v", "left_anti"))
        strong = cut_lineage(strong.unionAll(fresh))
    least = strong.groupBy("low").agg(F.min("v").alias("least"))
    return strong.join(least, "low").select("v", F.col("least").alias("low"))


def hierarchy(links: DataFrame, order_col: str | None = None) -> DataFrame:
    """Full path of every node: (node_id, parent_id, root_id, depth int, path string, looped boolean).

    links is (parent, child[, order_col]). Where a node has several parents, its path follows the one of the smallest
    order_col (without order_col the smallest parent id); all parents count in descendants(). A root has depth 0 and a
    null parent_id. path lists ids from the root down. Nodes whose path never reaches a root (on a loop or below one)
    come out once, with looped true and null root, depth and path. Repeated rows change nothing; null ends do not count;
    an empty table gives no rows.

    Each round doubles the distance of all open pointers and joins path segments, so it takes log2(depth) joins. Only
    nodes with children take part; the others get their paths in one last join. The segments of looped nodes grow with the
    rounds, to at most four times the deepest path. Parents that hold many of the other nodes are joined apart, see join_heavy().
    """
    links = links.filter("parent IS NOT NULL AND child IS NOT NULL")
    first = F.min_by("parent", F.struct(order_col, "parent")) if order_col else F.min("parent")
    parents = cut_lineage(links.groupBy(F.col("child").alias("node")).agg(first.alias("up")))
    inner = links.select(F.col("parent").alias("node")).distinct()
    root = F.col("up").isNull()
    start = inner.join(parents, "node", "left").select("node", F.col("up").alias("parent"), F.col("up").alias("jump"), F.when(root, F.col("node")).alias("root"), F.when(root, 0).otherwise(1).alias("depth"), F.col("node").alias("path"))
    start = cut_lineage(start)
    closed, open_rows, before = start.filter("jump IS NULL"), start.filter("jump IS NOT NULL"), -1
    while (left := open_rows.count()) not in (0, before):
        before = left
        ahead = closed.unionAll(open_rows).select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("root").alias("r2"), F.col("depth").alias("d2"), F.col("path").alias("p2"))
        moved = cut_lineage(open_rows.join(ahead, "jump").select("node", "parent", F.col("j2").alias("jump"), F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"), F.concat("p2", F.lit(SEPARATOR), "path").alias("path")))
        closed, open_rows = closed.unionAll(moved.filter("jump IS NULL")), moved.filter("jump IS NOT NULL")

    above = closed.select("node", "root", "depth", "path")
    leaves = join_heavy(parents.join(inner, "node", "left_anti"), above.withColumnRenamed("node", "up"), "up", "left")
    looped = F.col("path").isNull()
    ends = leaves.select(F.col("node").alias("node_id"), F.col("up").alias("parent_id"), F.col("root").alias("root_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit(SEPARATOR), "node").alias("path"), looped.alias("looped"))
    none = F.lit(None).cast("string")
    walked = closed.select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", "path", F.lit(False).alias("looped"))
    lost = open_rows.select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), none.alias("root_id"), F.lit(None).cast("int").alias("depth"), none.alias("path"), F.lit(True).alias("looped"))
    return walked.unionAll(lost).unionAll(ends)


def descendants(links: DataFrame) -> DataFrame:
    """All descendants of every node that is not itself on a loop: (node_id, descendant_id, distance int).

    Nodes above loops have the nodes on and below them as descendants, nodes below loops what is below them; nodes on a
    loop, which contain themselves, are reported by loops() and have no rows of their own. All parents count and distance
    is the shortest. Repeated rows change nothing, null ends do not count, an empty table gives no rows. Round k joins the
    pairs of distance 2**k with all shorter ones, among nodes with children; the others follow in one last join, and only
    those with several parents are reduced again. Descendants on or below loops are found apart, see _past_loops().
    """
    links = cut_lineage(links.filter("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct())
    endless = _endless_parents(links)
    below = cut_lineage(links.join(endless, F.xxhash64("parent") == F.col("v"), "left_semi").select("child").distinct())
    looped = links.join(below, "child", "left_semi")
    links = links.join(below, "child", "left_anti")
    inner = links.select(F.col("parent").alias("child")).distinct()
    steps = cut_lineage(links.join(inner, "child", "left_semi").select(F.col("child").alias("v"), F.col("parent").alias("u")))
    near, width = steps.select("v", "u", F.lit(1).alias("distance")), 1
    while not steps.isEmpty():
        far = steps.join(near.select(F.col("v").alias("u"), F.col("u").alias("w"), "distance"), "u").select("v", F.col("w").alias("u"), (F.col("distance") + width).alias("distance"))
        steps = cut_lineage(steps.join(steps.select(F.col("v").alias("u"), F.col("u").alias("w")), "u").select("v", F.col("w").alias("u")).distinct())
        near = cut_lineage(near.unionAll(far).groupBy("v", "u").agg(F.min("distance").alias("distance")))
        width *= 2
    leaves = links.join(inner, "child", "left_anti")
    several = leaves.groupBy("child").count().filter("count > 1").select("child")

    def climb(rows: DataFrame) -> DataFrame:
        own = rows.select(F.col("child").alias("v"), F.col("parent").alias("u"), F.lit(1).alias("distance"))
        over = rows.join(near.select(F.col("v").alias("parent"), F.col("u").alias("w"), "distance"), "parent")  # AQE splits skewed parents
        return own.unionAll(over.select(F.col("child").alias("v"), F.col("w").alias("u"), F.col("distance") + 1))

    single = climb(leaves.join(several, "child", "left_anti"))
    shared = climb(leaves.join(several, "child", "left_semi")).groupBy("v", "u").agg(F.min("distance").alias("distance"))
    pairs = near.unionAll(single).unionAll(shared)
    if not below.isEmpty():
        entries = cut_lineage(looped.join(below.withColumnRenamed("child", "parent"), "parent", "left_anti"))
        above = climb(links.join(entries.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"))
        pairs = pairs.unionAll(_past_loops(cut_lineage(looped.join(below.withColumnRenamed("child", "parent"), "parent", "left_semi")), entries, above))
    return pairs.select(F.col("u").alias("node_id"), F.col("v").alias("descendant_id"), "distance")


def _past_loops(core: DataFrame, entries: DataFrame, above: DataFrame) -> DataFrame:
    """Pairs (v, u, distance) of nodes v on or below loops and the nodes u above them that are on no loop.

    core has the links (parent, child) among nodes on or below loops, entries those that lead there from other nodes, and
    above the pairs (v, u, distance) over the parents of entries. Walks start only at nodes on no loop and where entries
    lead, so no loop is paired with itself unless something is above it. Round k adds the nodes at distances from 2**k to
    2**(k + 1) - 1; a round without new ones is the last, for a shortest walk passes through all smaller distances. Where
    the steps of a round outgrow the links four times, the walks go on link by link.
    """
    members, _ = _shrunk(core)
    on = members.select("node").distinct()
    sources = core.select(F.col("parent").alias("s")).unionAll(entries.select("child")).distinct()
    sources = sources.join(on, F.col("s") == F.col("node"), "left_anti").unionAll(entries.select("child").distinct()).distinct()
    near, steps, width, before = cut_lineage(sources.select("s", F.col("s").alias("v"), F.lit(0).alias("distance"))), core, 1, -1
    most = 4 * core.count()
    while (count := near.count()) != before:
        before = count
        far = near.join(steps.withColumnRenamed("parent", "v"), "v").select("s", F.col("child").alias("v"), (F.col("distance") + width).alias("distance"))
        near = cut_lineage(near.unionAll(far).groupBy("s", "v").agg(F.min("distance").alias("distance")))
        steps = cut_lineage(steps.join(steps.select(F.col("parent").alias("child"), F.col("child").alias("w")), "child").select("parent", F.col("w").alias("child")).distinct())
        width *= 2
        if steps.count() > most:  # steps of this width would pair the loops with themselves: go on link by link
            edge = near.filter(F.col("distance") == width - 1)
            while not edge.isEmpty():
                found = edge.join(core.withColumnRenamed("parent", "v"), "v").select("s", F.col("child").alias("v"), (F.col("distance") + 1).alias("distance")).distinct()
                edge = cut_lineage(found.join(near, ["s", "v"], "left_anti"))
                near = cut_lineage(near.unionAll(edge))
            break
    own = near.filter("distance > 0").join(on, F.col("s") == F.col("node"), "left_anti").select("v", F.col("s").alias("u"), "distance")
    starts = entries.select(F.col("child").alias("s"), F.col("parent").alias("u"), F.lit(1).alias("d"))
    over = entries.join(above.select(F.col("v").alias("parent"), "u", "distance"), "parent").select(F.col("child").alias("s"), "u", (F.col("distance") + 1).alias("d"))
    starts = starts.unionAll(over).groupBy("s", "u").agg(F.min("d").alias("d"))
    entered = starts.join(near, "s").groupBy("v", "u").agg(F.min(F.col("distance") + F.col("d")).alias("distance"))
    return own.unionAll(entered)
