import datetime as dt
import subprocess

import pytest

from graphloom.api import GraphSession
from graphloom.sources import files as sources
from graphloom.streaming import feed

PROJECT = {
    "src/base.ts": "export class Base {\n  name(): string { return 'b'; }\n}\nexport interface Thing {\n  id: number;\n}\n",
    "src/derived.ts": "import { Base, Thing } from './base';\nexport class Derived extends Base implements Thing {\n  id = 1;\n}\n",
    "src/utils.ts": "export function formatValue(x: number): string {\n  return String(x);\n}\nexport function processValue(x: number): string {\n  return formatValue(x);\n}\nfunction unusedHelper() {\n  return 1;\n}\n",
    "src/main.ts": "import { Derived } from './derived';\nimport { processValue } from './utils';\nexport function main() {\n  const d = new Derived();\n  return processValue(2) + d.name();\n}\n",
    "tests/main.test.ts": "import { main } from '../src/main';\nmain();\n",
    "node_modules/x/index.js": "function no() {}\n",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in PROJECT.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def links(graph):
    names = {r.id: r.name for r in graph.nodes.collect()}
    return {(names[r.source], names[r.target], r.kind) for r in graph.edges.collect()}


def test_project(spark, project, tmp_path):
    graph = GraphSession(spark, str(tmp_path / "store"))
    assert graph.index(str(project))["files"] == 5
    found = links(graph)
    assert {("processValue", "formatValue", "calls"), ("main", "processValue", "calls"), ("main", "Derived", "instantiates"), ("Derived", "Base", "extends"), ("Derived", "Thing", "implements")} <= found
    assert "unusedHelper" in {r.name for r in graph.dead_code().collect()} and "no" not in {r.name for r in graph.nodes.collect()}
    assert [r.name for r in graph.search("formatValue").limit(1).collect()] == ["formatValue"]
    derived = graph.symbols("Derived").first().id
    names = {r.id: r.name for r in graph.nodes.collect()}
    assert {names[r.node_id] for r in graph.hierarchy(derived).collect()} == {"Base", "Thing"}
    assert {names[r.node_id] for r in graph.callers("formatValue").collect()} == {"processValue"}
    assert graph.cycles().count() == 0
    report = graph.context("How does processValue format a value?")
    assert "processValue" in report and "return formatValue(x);" in report

    explored = graph.explore("How does processValue format a value?")
    assert "## src/utils.ts" in explored and "calls formatValue" in explored
    assert graph.listing().splitlines()[:2] == ["src/", "  base.ts"] and "typescript: 5 files" in graph.listing(form="grouped")

    import io
    import json

    from graphloom.server import serve

    call = lambda k, tool, **a: json.dumps({"jsonrpc": "2.0", "id": k, "method": "tools/call", "params": {"name": tool, "arguments": a}})
    asked = [json.dumps({"jsonrpc": "2.0", "id": 0, "method": "initialize"}), json.dumps({"method": "notifications/initialized"}), "{", call(1, "callers", symbol="formatValue"), call(2, "search", query="formatValue", limit="x"), call(3, "nosuch"), call(4, "impact", symbol="formatValue"), json.dumps({"id": 5, "method": "tools/list"})]
    out = io.StringIO()
    serve(graph, io.StringIO("\n".join(asked)), out)
    told = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [t["id"] for t in told] == [0, None, 1, 2, 3, 4, 5]
    assert "processValue" in told[2]["result"]["content"][0]["text"] and told[3]["result"]["isError"] and told[4]["error"]["code"] == -32602
    assert "processValue" in told[5]["result"]["content"][0]["text"] and len(told[6]["result"]["tools"]) == 9

    (project / "src/utils.ts").write_text(PROJECT["src/utils.ts"].replace("processValue", "handleValue"))
    (project / "src/extra.ts").write_text("import { formatValue } from './utils';\nexport function extra() { return formatValue(1); }\n")
    (project / "tests/main.test.ts").unlink()
    assert graph.sync(str(project)) == {"added": 1, "modified": 1, "removed": 1}
    assert graph.sync(str(project)) == {"added": 0, "modified": 0, "removed": 0}
    anew = GraphSession(spark, str(tmp_path / "anew"))
    anew.index(str(project))
    assert links(graph) == links(anew) and ("extra", "formatValue", "calls") in links(graph)
    assert graph.counts() == anew.counts()


def test_scans(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.ts").write_text("1")
    (tmp_path / "a/loop").symlink_to(tmp_path / "a")
    (tmp_path / "broken").symlink_to(tmp_path / "nowhere")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/y.ts").write_text("1")
    (tmp_path / "skip" / sources.IGNORE_MARKER).write_text("")
    assert sources.walk_files(str(tmp_path)) == ["a/x.ts"]
    assert [r.path for r in sources.list_files(spark, str(tmp_path), exclude=["b/**"]).collect()] == ["a/x.ts"]
    assert sources.git_visible_files(str(tmp_path)) is None
    if subprocess.run(["git", "init", "-q", str(tmp_path)]).returncode == 0:
        assert "a/x.ts" in sources.git_visible_files(str(tmp_path)) and ("a/x.ts", "added") in sources.git_changed_files(str(tmp_path))


def test_debounce(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", at(0)), ("a", at(1)), ("a", at(2)), ("a", at(9)), ("b", at(1)), ("b", None)], "path string, at timestamp")
    got = sorted((r.path, r.started.second, r.ended.second, r.events) for r in feed.debounce(rows, ["path"], "at").collect())
    assert got == [("a", 0, 2, 3), ("a", 9, 9, 1), ("b", 1, 1, 1)]


def test_stream(spark, tmp_path):
    schema = "path string, status string, at timestamp"
    at = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame([("a.ts", "modified", at), ("a.ts", "removed", at + dt.timedelta(1)), (".git/x", "modified", at), (None, "modified", at)], schema)
    frame.write.parquet(str(tmp_path / "in"))
    seen = []
    changes = feed.watch(spark, str(tmp_path / "in"), frame.schema)
    query = feed.synchronise(changes, lambda batch, _: seen.extend((r.path, r.status) for r in feed.latest_changes(batch).collect()), str(tmp_path / "state"), once=True)
    query.awaitTermination(120)
    assert seen == [("a.ts", "removed")]


def test_manifests(tmp_path):
    from graphloom.operators import extract, report
    from graphloom.sources import manifests

    (tmp_path / "tsconfig.json").write_text('{ // c\n "compilerOptions": {"baseUrl": "src", /* "x": 1, */ "paths": {"@/*": ["./*"], "@lib/*": ["lib/*"], "url": ["a//b"],},},}')
    assert manifests.load_aliases(str(tmp_path)) == [("@lib/*", "src/lib/*"), ("url", "src/a/b"), ("@/*", "src/*")]
    assert manifests.load_aliases(str(tmp_path / "none")) == []
    config = manifests.Config(include=["src/**"], patterns=[("todo", r"TODO\((\w+)\)", "constant"), ("bad", "(a+)+", "constant")])
    config.save(str(tmp_path / "c.json"))
    assert manifests.Config.load(str(tmp_path / "c.json")) == config and config.problems() == ["unsafe or invalid expression: bad"]
    registry = extract.default_registry()
    registry.register("patterns", manifests.pattern_extractor(config), framework=True)
    assert ("constant", "me") in {(n["kind"], n["name"]) for n in extract.extract_source("a.ts", "// TODO(me)\n", registry=registry).nodes}
    assert report.truncated("a\n" * 10, 11).startswith("a\na\na\na\na") and report.size_text(2048) == "2.0 KB"


def test_aliases_re_exports_and_ignored_files(spark, tmp_path):
    root = tmp_path / "aliased"
    texts = {
        "tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["packages/lib/*"]}}} // aliases\n',
        "packages/lib/parts.ts": "export function sum(a: number) {\n  return a;\n}\nexport function keep(a: number) {\n  return a;\n}\n",
        "packages/lib/more.ts": "export { sum as total } from './parts';\n",
        "packages/lib/index.ts": "export * from './more';\nexport { keep } from './parts';\n",
        "other/parts.ts": "export function total(a: number) {\n  return a;\n}\nexport function keep(a: number) {\n  return a;\n}\n",
        "app/run.ts": "import { total, keep } from '@lib/index';\nexport function run() {\n  return total(1) + keep(2);\n}\n",
        "app/secret.ts": "export function secret() {\n  return 1;\n}\n",
        ".gitignore": "app/secret.ts\n",
    }
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    graph = GraphSession(spark, str(tmp_path / "aliased-store"))
    graph.index(str(root))
    nodes = {r.id: r for r in graph.nodes.collect()}
    assert "secret" not in {n.name for n in nodes.values()}
    called = {(nodes[e.target].name, nodes[e.target].file_path) for e in graph.edges.collect() if e.kind == "calls" and nodes[e.source].name == "run"}
    assert called == {("sum", "packages/lib/parts.ts"), ("keep", "packages/lib/parts.ts")}
