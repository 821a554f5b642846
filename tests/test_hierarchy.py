import random

import numpy as np
import pytest

from graphloom.operators import hierarchy as module
from graphloom.operators.hierarchy import descendants, hierarchy, loop_members, loops, parent_child

LINKS = "parent string, child string"


def brute_reach(links):
    nodes = {x for link in links for x in link}
    below = {n: set() for n in nodes}
    for p, c in links:
        below[p].add(c)
    out = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for c in below[todo.pop()]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        out[n] = seen
    return out


def brute_loops(links):
    reach = brute_reach(links)
    looped = {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}
    return {(m, c) for n, c in looped.items() for m in {*reach[n], n}}


CASES = {
    "none": [("a", "b"), ("b", "c")],
    "self": [("a", "a"), ("a", "b")],
    "two": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")],
    "eight": [("a", "b"), ("b", "c"), ("c", "a"), ("b", "x"), ("x", "y"), ("y", "b"), ("y", "t")],
    "chain of loops": [("b", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("r", "e")],
    "below two": [("a", "a"), ("b", "b"), ("a", "m"), ("b", "m"), ("m", "n")],
    "tail above": [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("q", "b")],
    "self on loop": [("a", "b"), ("b", "a"), ("a", "a"), ("", "z"), ("z", "")],
}


def random_links(seed):
    r = random.Random(seed)
    return [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(r.choice([30, 45, 60, 80]))]


def apart(graphs):
    """Graphs in one table, each with names of its own."""
    return [(f"{g}:{p}", f"{g}:{c}") for g, links in graphs for p, c in links]


ALL = apart([*((name, links * 2) for name, links in CASES.items()), *((f"random {seed}", random_links(seed)) for seed in range(12))])


def test_loops(spark):
    assert {tuple(r) for r in loops(spark.createDataFrame(ALL, LINKS)).collect()} == brute_loops(ALL)


def test_loops_of_one_graph(spark):
    for links in (CASES["self on loop"],):
        assert {tuple(r) for r in loops(spark.createDataFrame(links, LINKS)).collect()} == brute_loops(links)


def brute_members(links):
    reach = brute_reach(links)
    return sorted((n, min(m for m in reach[n] if n in reach[m])) for n in reach if n in reach[n])


@pytest.mark.parametrize("in_task", [module.IN_TASK, 150])
def test_loop_members(spark, in_task):
    """In one task, and in one for what all tasks left."""
    assert sorted(map(tuple, loop_members(spark.createDataFrame(ALL, LINKS), in_task).collect())) == brute_members(ALL)


def test_strong_parts_of_a_long_loop():
    n = 200_000
    ids, parts = module.strong_parts(np.arange(n), np.r_[np.arange(1, n - 10), 0, np.arange(n - 9, n + 1)])
    assert ids.tolist() == list(range(n - 10)) and len(set(parts.tolist())) == 1


def test_plans_stay_small_where_lines_join_often(spark, monkeypatch):
    """Each level above the loop has two parents, so each is a round that folds back; plans must not double with each."""
    sizes, cut = [], module.cut_lineage

    def measured(df):
        sizes.append(len(df._jdf.queryExecution().analyzed().toString()))
        assert sizes[-1] < 30_000, f"step {len(sizes)} has a plan of {sizes[-1]} characters"
        return cut(df)

    monkeypatch.setattr(module, "cut_lineage", measured)
    ladder = [(f"{a}{k}", f"{b}{k + 1}") for k in range(7) for a in "ab" for b in "ab"]
    links = [("z", "a7"), ("a7", "z"), *ladder]
    assert sorted(map(tuple, loop_members(spark.createDataFrame(links, LINKS), 0).collect())) == [("a7", "a7"), ("z", "a7")]
    sizes.clear()
    assert sorted(map(tuple, loop_members(spark.createDataFrame(links, LINKS)).collect())) == [("a7", "a7"), ("z", "a7")] and len(sizes) <= 3


def test_large_component_with_two_parents(spark):
    """No step may pair nodes with their ancestors: here that would be 10**10 pairs."""
    r = random.Random(3)
    n = 100_000
    links = [(f"n{r.randrange(n):06}", f"n{k:06}") for k in range(n) for _ in range(2)]
    groups = {x["cycle_id"]: x["count"] for x in loops(spark.createDataFrame(links, LINKS)).groupBy("cycle_id").count().collect()}
    assert max(groups.values()) == n and min(groups) == max(groups, key=groups.get)


def test_long_chain_and_loop(spark):
    links = [(f"c{k:04}", f"c{k + 1:04}") for k in range(300)] + [(f"l{k:03}", f"l{(k + 1) % 150:03}") for k in range(150)] + [("l000", "c0000")]
    found = {tuple(x) for x in loops(spark.createDataFrame(links, LINKS)).collect()}
    assert found == {(n, "l000") for link in links for n in link}
    tree = links[:300]
    rows = {r.node_id: r for r in hierarchy(spark.createDataFrame(tree, LINKS)).collect()}
    assert rows["c0300"].depth == 300 and rows["c0300"].root_id == "c0000" and rows["c0300"].path.startswith("c0000 > c0001 > ")
    assert descendants(spark.createDataFrame(tree, LINKS)).count() == 300 * 301 // 2


def test_empty(spark):
    empty = spark.createDataFrame([], LINKS)
    assert loops(empty).count() == hierarchy(empty).count() == descendants(empty).count() == 0


def test_hierarchy_of_several_parents_and_loops(spark):
    links = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z")]
    rows = {r.node_id: r for r in hierarchy(spark.createDataFrame(links, LINKS)).collect()}
    assert (rows["d"].path, rows["d"].depth, rows["d"].root_id, rows["d"].looped) == ("r > a > c > d", 3, "r", False)
    assert rows["r"].depth == 0 and rows["r"].parent_id is None
    assert {n for n, r in rows.items() if r.looped} == {"x", "y", "z"} and rows["z"].path is None
    pairs = {(r.node_id, r.descendant_id): r.distance for r in descendants(spark.createDataFrame(links, LINKS)).collect()}
    assert pairs == {("r", "a"): 1, ("r", "b"): 1, ("r", "c"): 2, ("a", "c"): 1, ("b", "c"): 1, ("r", "d"): 3, ("a", "d"): 2, ("b", "d"): 2, ("c", "d"): 1}
    ordered = spark.createDataFrame([(p, c, 9 if p == "a" else 1) for p, c in links], LINKS + ", edge_id int")
    assert {r.node_id: r.path for r in hierarchy(ordered, "edge_id").collect()}["d"] == "r > b > c > d"


def test_nulls_kinds_and_clashing_columns(spark):
    rows = [("a", "b", " Contains\t", "x"), (None, "b", "contains", "x"), ("a", None, "contains", "x"), ("b", "c", "CONTAINS", None), ("q", "r", "calls", "x"), ("q", "r", None, "x")]
    edges = spark.createDataFrame(rows, "source string, target string, kind string, node_id string").withColumnRenamed("node_id", "v")
    links = parent_child(edges)
    assert sorted(map(tuple, links.collect())) == [("a", "b"), ("b", "c")]
    assert loops(links).count() == 0 and hierarchy(links).count() == 3


def brute_descendants(links):
    below, out = {}, {}
    for p, c in links:
        below.setdefault(p, set()).add(c)
    for n in below:
        seen, level, distance = {}, {n}, 0
        while level:
            distance += 1
            level = {c for x in level for c in below.get(x, ())} - set(seen)
            seen |= dict.fromkeys(level, distance)
        if n not in seen:
            out |= {(n, d): k for d, k in seen.items()}
    return out


def found_descendants(spark, links):
    rows = [tuple(r) for r in descendants(spark.createDataFrame(links, LINKS)).collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {r[:2]: r[2] for r in rows}


def test_descendants_above_and_below_loops(spark):
    links = ALL + apart([("more", [("r", "x"), ("a", "b"), ("b", "a"), ("b", "x"), ("x", "y")])])
    assert found_descendants(spark, links) == brute_descendants(links)
    assert found_descendants(spark, CASES["chain of loops"]) == brute_descendants(CASES["chain of loops"])


def test_descendants_past_dense_loops(spark):
    r = random.Random(8)
    links = [("top", "over"), ("over", "m000"), *((f"m{r.randrange(120):03}", f"m{k:03}") for k in range(120) for _ in range(4)), ("m007", "out"), ("out", "end")]
    assert found_descendants(spark, links) == brute_descendants(links)


def test_descendants_past_a_long_loop(spark):
    links = [("r", "q"), ("q", "l000"), ("l007", "x"), ("x", "y"), *((f"l{k:03}", f"l{(k + 1) % 50:03}") for k in range(50))]
    assert found_descendants(spark, links) == brute_descendants(links)
