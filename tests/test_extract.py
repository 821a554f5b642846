import pytest

from graphloom.operators import extract, frameworks

TS = "export class Greeter {\n  greet(name: string): string {\n    return name;\n  }\n}\nexport function run() {\n  const g = new Greeter();\n  return g.greet('x');\n}\n"
PY = 'class A:\n    """Doc."""\n    def one(self):\n        return self.two()\n    def two(self):\n        return 1\n\ndef go():\n    a = A()\n    return a.one()\n'


def kinds(path, source):
    found = extract.extract_source(path, source)
    return [(n["kind"], n["name"], n["start_line"]) for n in found.nodes], {(r["reference_name"], r["reference_kind"]) for r in found.refs}


def test_tables(spark):
    files = spark.createDataFrame([("a.ts", TS, "x"), ("b.py", PY, "x"), ("bad.py", "def (:", "x"), ("c.zzz", "?", "x"), ("d.ts", None, "x"), ("e.ts", "", "x")], "path string, content string, nodes string")
    raw = extract.extract(files)
    nodes = {r["kind"]: r["count"] for r in extract.explode_rows(raw, "nodes").groupBy("kind").count().collect()}
    assert nodes == {"file": 3, "class": 2, "function": 2, "method": 3}
    assert extract.explode_rows(raw, "edges").count() == 7
    assert {r.code for r in extract.explode_rows(raw, "errors").collect()} == {"parse_error", "unsupported_language", "read_error"}
    assert extract.extract(files.limit(0)).count() == 0


@pytest.mark.parametrize(
    "path,source,symbols,refs",
    [
        ("m.go", 'package main\nimport "fmt"\ntype S struct {\n}\nfunc (s *S) Run(a int) error {\n  fmt.Println(a)\n}\n', {("struct", "S", 3), ("method", "Run", 5), ("import", "fmt", 2)}, {("fmt.Println", "calls")}),
        ("l.rs", "pub struct P {}\ntrait T { fn f(&self); }\nimpl T for P {\n  fn f(&self) { helper(1) }\n}\n/* a /* b */ fn no() {} */\n", {("struct", "P", 1), ("trait", "T", 2), ("method", "f", 4)}, {("T", "implements"), ("helper", "calls")}),
        ("C.java", "public class C extends B implements I, J {\n  @Override\n  public int get(int a) { return foo(a); } // bar()\n  C() { new D(); }\n}\n", {("class", "C", 1), ("method", "get", 3), ("method", "C", 4)}, {("B", "extends"), ("I", "implements"), ("J", "implements"), ("D", "instantiates"), ("Override", "decorates")}),
        ("e.rb", "module M\n class K < Base\n  def go(a)\n   if a\n    run(a)\n   end\n  end\n end\nend\n", {("module", "M", 1), ("class", "K", 2), ("method", "go", 3)}, {("Base", "extends"), ("run", "calls")}),
        ("v.vue", '<template><Child/></template>\n<script setup lang="ts">\nfunction go() { ping(); defineProps(); }\n</script>\n', {("component", "v", 1), ("function", "go", 3)}, {("Child", "references"), ("ping", "calls")}),
        ("f.dfm", "object Form1: TForm1\n  OnCreate = FormCreate\n  object B: TButton\n    OnClick = BClick\n  end\nend\n", {("component", "Form1", 1), ("component", "B", 3)}, {("FormCreate", "references"), ("BClick", "references")}),
        ("t.liquid", "{% render 'card' %}\n{% assign x = 1 %}\n", {("import", "card", 1), ("variable", "x", 2)}, {("snippets/card.liquid", "imports")}),
        ("u.pas", "unit U;\ninterface\nuses SysUtils;\ntype\n  TFoo = class(TObject)\n    procedure Go(a: Integer);\n  end;\nimplementation\nprocedure TFoo.Go(a: Integer);\nbegin\n  Run(a);\nend;\nend.\n", {("module", "U", 1), ("class", "TFoo", 5), ("method", "Go", 6)}, {("TObject", "extends"), ("Run", "calls"), ("SysUtils", "imports")}),
    ],
)
def test_languages(path, source, symbols, refs):
    found, told = kinds(path, source)
    assert symbols <= set(found) and refs <= told
    assert not {n for _, n, _ in found} & {"no", "bar", "if", "return"}


def test_comments_keep_offsets():
    for language, source in [("typescript", "a // x\n/* y\nz */ b 'c // d'"), ("python", 'a # x\n"""doc"""\nb'), ("rust", "a /* x /* y */ z */ b")]:
        out = extract.blank_comments(source, language)
        assert len(out) == len(source) and out.count("\n") == source.count("\n") and "x" not in out and "y" not in out


def test_imports_and_re_exports():
    ts = "import d, { a as b, type T } from './m'\nimport * as ns from \"x\"\nconst { q: r } = require('y')\n// import z from 'z'\n"
    assert set(extract.import_mappings(ts, "typescript")) == {("d", "default", "./m"), ("b", "a", "./m"), ("T", "T", "./m"), ("ns", "*", "x"), ("r", "q", "y")}
    assert set(extract.import_mappings("from .a import (b,\n c as d)\nimport os.path, re as r\n", "python")) == {("b", "b", ".a"), ("d", "c", ".a"), ("os", "*", "os.path"), ("r", "*", "re")}
    assert set(extract.re_exports("export * from './a'\nexport { b as c } from './d'\n")) == {("*", "*", "./a"), ("c", "b", "./d")}
    assert extract.import_candidates("src/a/b.ts", "../c", "typescript")[0] == "src/c.ts"
    assert extract.import_candidates("src/a/b.py", "..c.d", "python")[0] == "src/c/d.py"
    assert extract.import_candidates("x.ts", "@lib/q", "typescript", [("@lib/*", "libs/*"), ("@*", "no/*")])[0] == "libs/q.ts"
    assert extract.detect_language("a.h", "class A {};") == "cpp" and extract.detect_language("a.h", "int x;") == "c" and extract.detect_language("Makefile") == "unknown"


@pytest.mark.parametrize(
    "path,source,route,handler",
    [
        ("routes/web.php", "<?php\nRoute::get('/users', [UserController::class, 'index']);\n", "GET /users", "index"),
        ("app.js", "app.get('/x', auth, handlers.list)\n", "GET /x", "list"),
        ("urls.py", "urlpatterns = [path('a/<int:id>', views.Detail.as_view())]\n", "a/<int:id>", "Detail"),
        ("f.py", "from flask import Flask\napp = Flask(__name__)\n@app.route('/f')\ndef show():\n    pass\n", "/f", "show"),
        ("C.java", '@RestController\nclass C {\n  @GetMapping("/j")\n  public List<X> all() { return null; }\n}\n', "GET /j", "all"),
        ("m.go", 'package m\nfunc f(r R) {\n  r.GET("/g", h.List)\n}\n', "GET /g", "List"),
        ("m.rs", '#[get("/r")]\nasync fn idx() {}\n', "GET /r", "idx"),
        ("C.cs", 'class C {\n  [HttpGet("c")]\n  public Task<X> Get(int id) { }\n}\n', "GET c", "Get"),
        ("config/routes.rb", "get '/b', to: 'books#show'\n", "GET /b", "show"),
    ],
)
def test_routes(path, source, route, handler):
    found = extract.extract_source(path, source)
    assert route in {n["name"] for n in found.nodes if n["kind"] == "route"}
    assert handler in {r["reference_name"] for r in found.refs if r["reference_kind"] == "references"}


def test_commented_routes_do_not_count():
    assert not [n for n in extract.extract_source("app.js", "// app.get('/x', list)\n").nodes if n["kind"] == "route"]


def test_file_routes():
    assert frameworks.file_route("pages/blog/[slug].tsx", "react") == "/blog/:slug" and frameworks.file_route("app/(shop)/[...all]/page.tsx", "react") == "/*all"
    assert frameworks.file_route("src/routes/a/[id]/+page.svelte", "svelte") == "/a/:id" and frameworks.file_route("pages/index.vue", "vue") == "/" and frameworks.file_route("lib/x.ts", "react") is None


def test_detection_and_conventions(spark):
    files = spark.createDataFrame([("package.json", '{"dependencies": {"express": "1"}}'), ("manage.py", ""), ("a.py", None)], "path string, content string")
    assert {r.framework for r in frameworks.detect_frameworks(files).collect()} == {"express", "django"}
    refs = spark.createDataFrame([(1, "src", "UserController", "javascript"), (2, "src", "other", "javascript")], "ref_id long, from_node_id string, reference_name string, language string")
    nodes = spark.createDataFrame([("a", "class", "UserController", "x/u.js"), ("b", "class", "UserController", "controllers/u.js")], "id string, kind string, name string, file_path string")
    assert [(r.ref_id, r.target_id) for r in frameworks.by_convention(refs, nodes, ["express"]).collect()] == [(1, "b")]


def test_plug_in():
    registry = extract.default_registry()
    registry.register("marker", lambda found, source: found.node("route", "extra", 1, 1, found.nodes[0]), framework=True)
    assert "extra" in {n["name"] for n in extract.extract_source("a.ts", TS, registry=registry).nodes}


MIXED = "class A {\n  go(): void {\n    this.b.run('x');\n  }\n}\nfunc (s *S) Run(a int) error {\n\treturn s.a.run()\n}\n// Note.\nfn f(a: &mut A) -> Option<u64> {\n    a.f()?;\n    Some(1)\n}\ndef load(cursor, limit=1):\n    \"\"\"Doc.\nclass B {\n    \"\"\"\n    for x in cursor.all():\n        yield x\n\n\nIt took 5 seconds.\n\nexport function last(a: B): C {\n  return bind(a);\n}\nclass D:\n    def m(self):\n        return self.n(\n"


def test_documents_of_several_languages(spark, tmp_path):
    from graphloom.plans import sources

    rows = [(1, MIXED, "s", "source"), (2, None, "s", "source"), (3, "", None, "source"), (4, "def a():\r    b()\r\rx = c()\r", None, "source"), (5, PY, "s", "readme")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, doc_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in sources.extract_symbols(spark, str(tmp_path)).collect()}
    assert found == {("s/1.ts", "class", "A", 1), ("s/1.ts", "method", "go", 2), ("s/1.go", "method", "Run", 6), ("s/1.rs", "function", "f", 10), ("s/1.py", "function", "load", 14), ("s/1.ts", "function", "last", 24), ("s/1.py", "class", "D", 27), ("s/1.py", "method", "m", 28), ("none/4.py", "function", "a", 1), ("none/4.py", "variable", "x", 4)}
    refs = {tuple(r) for r in sources.extract_references(spark, str(tmp_path)).collect()}
    assert {("s/1.py", "cursor.all", "calls", 18), ("s/1.ts", "bind", "calls", 25), ("none/4.py", "b", "calls", 2)} <= refs and not {r for r in refs if r[1] in ("load", "m")}
