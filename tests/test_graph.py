import pytest
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.operators import graph, model, resolve, search, stats, storage

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, docstring string, signature string, start_line int, is_exported boolean"


def nodes(spark, rows):
    return spark.createDataFrame([(i, kind, i, i, path, "typescript", None, None, 1, exported) for i, kind, path, exported in rows], NODES)


def edges(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "edge_id long, source string, target string, kind string")


@pytest.fixture(scope="module")
def small(spark):
    n = nodes(spark, [("a", "function", "f.ts", True), ("b", "function", "g.ts", False), ("c", "function", "h.ts", False)])
    return n, edges(spark, [("a", "b", "calls"), ("a", "c", "imports"), ("b", "a", "references"), ("a", "a", "calls"), ("a", "gone", "calls")])


def ids(df, column="node_id"):
    return sorted(r[column] for r in df.collect())


def test_hops(small):
    n, e = small
    assert ids(graph.neighbours(e, n, "a", False)) == ["b", "c"] and ids(graph.neighbours(e, n, "a", True)) == ["b"]
    assert ids(graph.usages(e, n, "c")) == ["a"]
    assert [(r.source, r.target) for r in graph.edges_between(e, n.filter("id IN ('a', 'b')"), ["calls"]).filter("source <> target").collect()] == [("a", "b")]


def test_two_directions(spark):
    n = nodes(spark, [(x, "function", f"{x}.ts", True) for x in "abc"])
    e = edges(spark, [("a", "b", "calls"), ("b", "c", "calls")])
    assert ids(graph.reach(e, graph.start(n, "b"), direction="both", through=n)) == ["a", "b", "c"]
    assert ids(graph.reach(e, graph.start(n, "b"), direction="both", through=n, limit=2)) == ["a", "b"]
    kinds = nodes(spark, [("a", "function", "a.ts", True), ("b", "class", "b.ts", True), ("c", "function", "c.ts", True)])
    assert ids(graph.traverse(e, kinds, "a")) == ["a", "b", "c"] and ids(graph.traverse(e, kinds, "a", graph.Traversal(node_kinds=["function"]))) == ["a"]
    assert ids(graph.traverse(e, kinds, "a", graph.Traversal(depth=1, include_start=False))) == ["b"]
    assert [tuple(r) for r in graph.find_path(e, n, "a", "c").orderBy("step").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert graph.find_path(e, n, "c", "a").count() == 0 and graph.find_path(e, n, "x", "a").count() == 0


def test_diamond_loop_and_impact(spark):
    n = nodes(spark, [("C", "class", "c.ts", True), ("m", "method", "c.ts", False), ("k", "method", "c.ts", False), ("u", "function", "u.ts", False), ("v", "function", "v.ts", False), ("w", "function", "w.ts", False)])
    e = edges(spark, [("C", "m", "contains"), ("C", "k", "contains"), ("u", "k", "calls"), ("v", "u", "calls"), ("w", "v", "calls"), ("u", "u", "calls"), ("u", "k", "calls")])
    assert {r.node_id: r.depth for r in graph.impact(e, n, "m", 2).collect()} == {"m": 0, "C": 1, "k": 1, "u": 2}
    assert {r.node_id: r.depth for r in graph.impact(e, n, "C", 1).collect()} == {"C": 0, "m": 0, "k": 0, "u": 1}
    assert ids(graph.dead_code(e, n), "id") == ["m", "w"]
    row = graph.node_metrics(e, n).filter("node_id = 'u'").first()
    assert (row.in_degree, row.out_degree, row.calls_in, row.calls_out) == (2, 3, 2, 3)


def test_affected_tests(spark):
    files = ["src/core.ts", "src/ui.ts", "tests/core.test.ts", "e2e/ui.spec.ts", "tests/harness.test.ts", "tests/ui.test.ts"]
    n = nodes(spark, [(f"file:{p}", "file", p, True) for p in files])
    e = edges(spark, [(f"file:{a}", f"file:{b}", "imports") for a, b in [("src/ui.ts", "src/core.ts"), ("tests/core.test.ts", "src/core.ts"), ("e2e/ui.spec.ts", "src/ui.ts")]])
    test = fx.is_affected_test(F.col("path"))
    assert [r.path for r in graph.affected_tests(e, n, ["src/core.ts", "tests/direct.test.ts"], test, 5).collect()] == ["e2e/ui.spec.ts", "tests/core.test.ts", "tests/direct.test.ts"]
    assert [r.path for r in graph.affected_tests(e, n, ["src/core.ts"], test, 1).collect()] == ["tests/core.test.ts"]


def test_file_cycles(spark):
    n = nodes(spark, [(f"file:{p}", "file", p, True) for p in "abcde"])
    e = edges(spark, [(f"file:{a}", f"file:{b}", "imports") for a, b in ["ab", "bc", "ca", "cd", "ee", "ea"]])
    assert sorted(map(tuple, graph.file_cycles(e, n).collect())) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_newest_rows(spark):
    rows = [("x", " Function", 1, "old"), ("x", "METHOD\t", 5, "new"), ("x", "METHOD\t", 5, "new"), (None, "class", 1, "q"), ("y", "class", None, "z")]
    df = spark.createDataFrame(rows, "id string, kind string, updated_at long, name string")
    assert sorted((r.id, r.kind, r.name) for r in model.current_nodes(df, ["kind", "name"]).collect()) == [("x", "method", "new"), ("y", "class", "z")]


def test_empty_inputs(spark):
    n, e = nodes(spark, []), edges(spark, [])
    for df in (graph.hops(e, n, "a", 3, True), graph.impact(e, n, "a"), graph.dead_code(e, n), graph.file_cycles(e, n), graph.node_metrics(e, n), search.full_text(n, "queue"), search.search(n, "queue"), search.fuzzy(n, "queue")):
        assert df.count() == 0


def ref_table(spark, rows):
    return spark.createDataFrame([(k, "src", *r) for k, r in enumerate(rows)], "ref_id long, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string")


def symbol_table(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean")


def test_name_resolution(spark):
    one = symbol_table(spark, [("f", "function", "myFunction", "myFunction", "test.ts", "typescript", 1, False)])
    got = resolve.resolve(ref_table(spark, [("myFunction", "calls", 1, "main.ts", "typescript"), (None, "calls", 1, "main.ts", "typescript"), ("console.log", "calls", 1, "main.ts", "typescript")]), one).collect()
    assert [(r.ref_id, r.target_id, r.confidence, r.resolved_by) for r in got] == [(0, "f", 0.9, "exact-match")]
    apps = symbol_table(spark, [(x, "function", "navigate", "navigate", f"apps/app_{x}/src/server.py", "python", 1, False) for x in "abc"])
    ref = ref_table(spark, [("navigate", "calls", 1, "apps/app_a/src/handler.py", "python")])
    row = resolve.resolve(ref, apps).first()
    assert (row.target_id, row.confidence) == ("a", 0.7)
    assert resolve.resolve(ref, apps.filter("id <> 'a'")).first().confidence <= 0.4


def test_re_export_chain(spark):
    known = symbol_table(spark, [("s", "function", "signIn", "signIn", "services/auth.ts", "typescript", 1, True)])
    mapping = spark.createDataFrame([("main.ts", "signIn", "all.ts", "signIn"), ("main.ts", "login", "index.ts", "login")], "file_path string, local_name string, module_path string, export_name string")
    exports = spark.createDataFrame([("all.ts", "*", "services/index.ts", "*"), ("services/index.ts", "signIn", "services/auth.ts", "signIn"), ("index.ts", "login", "services/auth.ts", "signIn"), ("all.ts", "*", "all.ts", "*")], "file_path string, export_name string, module_path string, source_name string")
    refs = ref_table(spark, [("signIn", "calls", 1, "main.ts", "typescript"), ("login", "calls", 2, "main.ts", "typescript"), ("other", "calls", 2, "main.ts", "typescript")])
    assert sorted((r.ref_id, r.target_id) for r in resolve.by_import(refs, mapping, known, exports).collect()) == [(0, "s"), (1, "s")]


def test_full_text_phrases(spark):
    rows = [("method:1", "method", "user_service", "A::user_service", "a.ts", "typescript", "The user service.", None, 1, True), ("function:2", "function", "service", "service", "b.ts", "typescript", None, None, 1, True)]
    n = spark.createDataFrame(rows, NODES)
    assert ids(search.full_text(n, "user_serv"), "id") == ["method:1"]
    assert ids(search.full_text(n, "method"), "id") == ["method:1"]  # ids match, with weight 0
    assert search.search(n, 'kind:function service').first().id == "function:2" and search.search(n, "AND OR").count() == 0


def test_sync_plans(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    kept = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, content_hash string")
    assert sorted(map(tuple, storage.sync_plan(disk, kept).collect())) == [("a", "added"), ("c", "modified"), ("d", "removed")]
    feed = spark.createDataFrame([("n", "??"), ("b", " D"), ("zz", " D"), ("c", " M")], "path string, code string")
    assert sorted(map(tuple, storage.change_plan(feed, kept).collect())) == [("b", "removed"), ("c", "modified"), ("n", "added")]


def test_store(spark, tmp_path):
    store = storage.Store(spark, str(tmp_path))
    store.upsert("t", spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), "id")
    store.upsert("t", spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"), "id")
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    store.append("t", spark.createDataFrame([("a", 1)], "id string, v int"))
    store.optimize("t")
    assert store.read("t").count() == 4
    store.clear("t")
    store.set_metadata("k", "v")
    assert store.read("t").count() == 0 and store.metadata() == {"k": "v"}


def test_evaluation(spark):
    found = spark.createDataFrame([("q", "x", 2), ("q", "z", 1)], "case_id string, symbol string, rank int")
    expected = spark.createDataFrame([("q", "x"), ("q", "y"), ("r", "x")], "case_id string, symbol string")
    assert {r.case_id: (r.recall, r.reciprocal_rank, r.passed) for r in stats.evaluation(found, expected).collect()} == {"q": (0.5, 0.5, True), "r": (0.0, 0.0, False)}
