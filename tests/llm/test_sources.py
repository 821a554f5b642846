import itertools

import pytest

from graphloom.llm import docpairs, origin, repair

FILE = "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, errors array<struct<message:string,file_path:string,line:int,col:int,severity:string,code:string>>"


def brute_repair(tokens, most=3):
    """Least edits by trying all of them."""
    def fits(t):
        stack = []
        for k, c in enumerate(t):
            if c in "[]":  # a head and its tail stand side by side
                if c == "[" and t[k + 1 : k + 2] != "]" or c == "]" and t[k - 1 : k] != "[":
                    return False
            elif c in "{\"":
                stack.append(c)
            elif c in "}'":
                if not stack or stack.pop() != {"}": "{", "'": '"'}[c]:
                    return False
            elif c in "MX":
                return False
        return not stack

    seen, level = {tokens}, {tokens}
    for cost in range(most + 1):
        if any(fits(t) for t in level):
            return cost
        level = {x for t in level for k in range(len(t) + 1) for x in [t[:k] + t[k + 1 :], *(t[:k] + c + t[k:] for c in "{}\"'[]")]} - seen
        seen |= level
    return None


@pytest.mark.parametrize("size", range(1, 5))
def test_repairs_cost_least(size):
    for t in itertools.product("s{}MX", repeat=size):
        t = "".join(t)
        assert repair.repair(t)[0] == brute_repair(t, 4), t


@pytest.mark.parametrize("size", range(1, 4))
def test_repairs_with_heads_cost_least(size):
    for t in itertools.product("s{}[]MX", repeat=size):
        t = "".join(t)
        assert repair.repair(t)[0] == brute_repair(t, 4), t


def test_what_is_settled_before_the_chart_costs_the_same(monkeypatch):
    import random

    r = random.Random(5)
    texts = ["".join(r.choice("ss{}[MX\"'") for _ in range(r.randrange(1, 14))) for _ in range(400)]
    whole = [repair.repair(t)[0] for t in texts]
    monkeypatch.setattr(repair, "CHART_TOKENS", 0)
    repair.repair.cache_clear()
    assert [repair.repair(t)[0] for t in texts] == whole
    repair.repair.cache_clear()


def test_costs_follow_what_a_diagnostic_counts():
    cost = lambda m: repair.repair(repair.message_skeleton(m))[0]
    assert [cost(m) for m in ("premature end of go source: 3 brackets still open", "unbalanced braces: 9 open, 4 closed", "unbalanced braces: 2 open, 4 closed", "Tree contains 2 ERROR and 300 MISSING nodes", "c grammar rejected 4 of 90 top-level items", "expected ')' but got '}'", "expected ';' after 'x'", "Aborted")] == [3, 5, 2, 302, 4, 2, 1, 0]


def test_places_of_edits():
    kind = lambda t: repair.kind_of(repair.repair(t)[1], len(t))
    assert [kind(t) for t in ("s", "s{s}", "s{s", 's"s', "sMs", "sXs", "s}s")] == ["", "", "truncation", "truncation", "conflict", "mismatch", "mismatch"]
    assert kind(repair.text_skeleton("int f() { return a[1]; }\n")) == "" and kind(repair.text_skeleton("int f() {\n return (1;\n")) == "truncation"
    assert kind(repair.text_skeleton("a\n<<<<<<< HEAD\nb\n=======\nc\n>>>>>>> x\n")) == "conflict"


BAD = ["unexpected end of file", "missing '}' before end of input", "conflict marker left in file near line 3", "SyntaxError: invalid syntax", "keyword 'fn' not known to the java grammar", "cannot be read as go: first error at byte 9", "Zeile 4: '}' unerwartet, ';' fehlt"]
FINE = ["Failed to read file: EACCES, permission denied", "Parse worker error: timed out after 55000 ms", "Unsupported language: scala", "File exceeds max size (4900000 > 1048576)", "Aborted", "Parser for go not available", "Path traversal blocked: ../merge-window", "Framework extractor 'routes' failed: lookup of 'dispatch-marker' is not a function"]


def error(message, severity="error", code=None):
    return (message, None, 1, None, severity, code)


def test_broken_sources(spark):
    rows = [(f"r/bad{k}.py", "h", "python", 1, 1, 1, 1, [error(m)]) for k, m in enumerate(BAD)] + [(f"r/fine{k}.py", "h", "python", 1, 1, 1, 1, [error(m)]) for k, m in enumerate(FINE)]
    rows += [("r/warn.py", "h", "python", 1, 1, 1, 1, [error(BAD[0], " Warning ")]), ("r/nosev.py", "h", "python", 1, 1, 1, 1, [error(BAD[0], None)]), ("r/nullentry.py", "h", "python", 1, 1, 1, 1, [None, error(None), error("", None, "read_error")])]
    rows += [("r/m.ts", "h", "python", 1, 1, 1, 1, None), ("r/h.h", "h", " CPP", 1, 1, 1, 1, []), ("r/u.ts", "h", "unknown", 1, 1, 1, 1, None), ("r/n.ts", "h", None, 1, 1, 1, 1, None), ("r/noext", "h", "python", 1, 1, 1, 1, None), ("r/x.zz", "h", "python", 1, 1, 1, 1, None), ("r/T.TS", "h", "TypeScript", 1, 1, 1, 1, None)]
    rows += [("r/old.py", "h", "python", 1, 1, 1, 1, [error(BAD[0])]), ("r/old.py", "h", "python", 1, 1, 2, 1, []), ("r/new.py", "h", "python", 1, 1, None, 1, []), ("r/new.py", "h", "python", 1, 1, 2, 1, [error(BAD[0])]), ("r/new.py", "h", "python", 1, 1, 2, 1, [error(BAD[0])]), (None, "h", "python", 1, 1, 2, 1, [error(BAD[0])])]
    types = spark.createDataFrame([(".py", "python"), (".ts", "typescript"), (".h", "c"), (".h", "cpp")], "ext string, lang_name string")
    files = spark.createDataFrame(rows, FILE)
    got = {r.path for r in repair.broken_sources(files, types).filter("broken").collect()}
    assert got == {f"r/bad{k}.py" for k in range(len(BAD))} | {"r/nosev.py", "r/m.ts", "r/new.py"}
    rates = {r.language: (r.files, r.broken, r.mismatch) for r in repair.broken_rates(files, types).collect()}
    assert rates["unknown"] == (1, 0, 0) and rates["typescript"] == (1, 0, 0)
    assert repair.broken_sources(files.limit(0), types).count() == 0 and {r.path for r in repair.broken_sources(files, types.limit(0)).filter("broken").collect()} == got - {"r/m.ts"}


TELLING = ["Blocks until the lease expires.", "Rotates the queue. Not safe for concurrent writers.", "@param frame the frame whose pipelines are counted, must not be dirty\n@return -1 if there is none", "<p>Hands out a copy.</p> Callers may change it.", "Liefert nur die Einträge, die seit dem letzten Lauf geändert wurden.", "meter が閉じられた後に呼ぶと例外を投げる。", "Возвращает только изменённые записи.", "TODO: rename later. Gives up after 9 attempts.", "Copyright (c) 2015 The Authors.\n\nRounds half up, as the reports expect.", "Returns null if missing.", "Returns true if empty.", "Returns -1.", "Idempotent.", "Not reentrant.", "Never returns null.", "Unsafe.", "Deprecated: use openQueue.", "Copyright check for uploads: rejects files whose hash is listed.", "Replace every tab in text with four spaces.", "Region codes map to warehouses here.", "Coverage of the polygon in square metres.", "Created lazily on first access.", "* Skips dirty cells\n* and logs how many were left out."]
EMPTY = [None, "", " \n\t", "setter", "Missing documentation", "Function rotateQueue.", "This function rotates the queue.", "Rotates the queue.", "return queue + 1;", "for x in queue:\n    print(x)", "const a = open(b);\nawait a.close();", "Copyright (c) 2015 The Authors. All rights reserved.", "SPDX-License-Identifier: MIT", "@param queue\n@returns", ":param queue:\n:return:", "Args:\n    queue:\n    index:\nReturns:\n", "see {@link other}", "See above.", "TODO: write docs", "eslint-disable-next-line no-empty", "-----------", "------ frozen cursor ------", "/** */", "<summary></summary>", "@inheritdoc", "\u200b", "#region helpers", "n/a", "Auto-generated method stub", "Deprecated.", "@deprecated", "Add a description here.", "Documentation to follow.", "Generated by the wizard. Replace this comment by a real one.", "Performs the operation.", "Returns the result.", "coverage: ignore", "region", "Copyright 2019 The Authors. You may use it under the terms in the LICENSE file."]


def test_comments_that_tell():
    assert [d for d in TELLING if not docpairs.tells(d, "rotateQueue", "(queue: Queue): void")] == []
    assert [d for d in EMPTY if docpairs.tells(d, "rotateQueue", "(queue: Queue): void")] == []


def test_documented_functions(spark):
    schema = "id string, kind string, name string, docstring string, signature string, updated_at long, node_id string"
    good = TELLING[0]
    rows = [("a", "function", "f", good, "()", 1, "x"), ("b", " METHOD\t", "f", good, "()", 1, "x"), ("c", "class", "f", good, "()", 1, "x"), ("d", "function", "f", good, " ", 1, "x"), ("e", "function", "f", good, None, 1, "x"), ("f", "function", "f", None, "()", 1, "x")]
    rows += [("g", "function", "f", good, "()", 1, "x"), ("g", "function", "f", "setter", "()", 2, "x"), ("h", "function", "f", "setter", "()", None, "x"), ("h", "function", "f", good, "()", 2, "x"), ("h", "function", "f", good, "()", 2, "x"), (None, "function", "f", good, "()", 1, "x"), ("i", None, None, good, "()", None, "x"), ("j", "function", None, "word " * 50_000, "()", 1, "x")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.node_id for r in docpairs.documented_functions(df).collect()) == ["a", "b", "h"]
    assert docpairs.documented_functions(df.limit(0)).count() == 0


def test_functions_of_source(spark):
    python = 'def f(a,\n      b):\n    """Adds the margin twice."""\n    return a\n\n# Keeps old entries alive.\n@cache\ndef g():\n    if x:\n        return 1\n\ndef h(): pass\n'
    found = {f[0]: f[2:] for f in docpairs.extract_functions(python, "python")}
    assert found["g"] == (8, 10, "Keeps old entries alive.") and found["h"][2] == ""
    go = "// Far away.\n\n\n\nfunc (s *S) Run(a int) error {\n\tif a {\n\t}\n}\n/* Sorts rows by age. */\nfunc sortRows(a []int) {\n}\n"
    found = {f[0]: f[2:] for f in docpairs.extract_functions(go, "go")}
    assert found["Run"] == (5, 8, "") and found["sortRows"][2] == "/* Sorts rows by age. */"
    ruby = "# Drops stale keys.\ndef purge(a)\n  if a\n    b\n  end\nend\n"
    assert docpairs.extract_functions(ruby, "ruby") == [("purge", "(a)", 2, 6, "Drops stale keys.")]
    df = spark.createDataFrame([(1, python), (2, None), (3, "")], "doc_id long, text string")
    assert {r.name for r in docpairs.source_functions(df).collect()} >= {"g"}


def functions(text, language):
    return {f[0]: f[1:] for f in docpairs.extract_functions(text, language)}


def test_functions_with_wrapped_signatures_and_other_forms():
    java = "/** Drops rows older than the limit. */\npublic void purge(\n    List<Row> rows,\n    int limit)\n{\n  if (a) {\n  }\n}\n"
    assert functions(java, "java")["purge"] == ("( List<Row> rows, int limit)", 2, 8, "/** Drops rows older than the limit. */")
    c = "// Keeps both ends.\nstatic int clamp(int a, int b)\n{\n    return a;\n}\n"
    assert functions(c, "c")["clamp"][1:] == (2, 5, "Keeps both ends.")
    script = "// Counts words twice.\nexport const count = async (a, b) => {\n  go(a);\n};\n// Halves it.\nconst half = x => x / 2;\n"
    found = functions(script, "javascript")
    assert found["count"] == ("(a, b)", 2, 4, "Counts words twice.") and found["half"] == ("x", 6, 6, "Halves it.")
    lua = "-- Splits at commas.\nlocal function split(s)\n  for i = 1, 3 do\n    if s then return end\n  end\nend\n-- Joins again.\nM.join = function(a, b)\n  return a\nend\n"
    found = functions(lua, "lua")
    assert found["split"] == ("(s)", 2, 6, "Splits at commas.") and found["join"] == ("(a, b)", 8, 10, "Joins again.")
    assert functions(lua, None)["split"] == found["split"]
    julia = "# Sorts in place.\nfunction order!(xs)\n  while true\n    break\n  end\nend\n"
    assert functions(julia, "julia")["order!"] == ("(xs)", 2, 6, "Sorts in place.")
    python = "async def load(\n    path: str,\n    *, limit=3,\n) -> dict[str, int]:\n    \"\"\"Reads at most limit lines.\"\"\"\n    return {}\n\nx = load(1)\n"
    assert functions(python, "python") == {"load": ("( path: str, *, limit=3, ) -> dict[str, int]", 1, 6, "Reads at most limit lines.")}
    assert functions("while (x) {\n  call(a);\n}\nfoo(\nbar(\n", "c") == {}


def test_origins(spark):
    generated = ["r/a/x.pb.go", "r/a/x_pb2.py", "r/a/moc_x.cpp", "r/a/lex.yy.c", "r/a/y.tab.c", "r/a/zz_generated.deepcopy.go", "r/a/XGrpc.java", "r/a/X.Designer.cs", "r/a/x.g.dart", "r/generated/deep/in/x.ts", "r/a/build/generated/source/x.kt", "r/x/obj/Debug/y.cs", "r/dist/x.py", "r/a/x_generated.go"]
    minified = ["r/a/x.min.js", "r/a/x-min.js", "r/a/x.packed.js", "r/a/x.bundle.js", "r/a/x.1d4d1887.js", "r/a/x.a78c0bea.chunk.js", "r/a/x.ccdefafd.js"]
    vendored = ["r/node_modules/q/src/x.js", "r/third_party/x.c", "r/ThirdParty/a/b/x.c", "r/Pods/x.swift", "r/lib/site-packages/x.py", "r/Godeps/_workspace/src/x.go", "vendor/x.go"]
    hand = ["r/generators/x.py", "r/vendor_portal/x.ts", "r/modules_node/x.js", "r/objects/x.c", "r/distribution/x.c", "r/a/minify_step.js", "r/a/minimap.js", "r/a/codegen_options.py", "r/a/pb_client.py", "r/a/vendor.go", "r/a/chunk_reader.js", "x.py", "r/build/x.py", "r/pods/x.go", "r/a/designer_view.cs"]
    rows = [(p, "h", "x", 2000, 1, 1, 5, None) for p in generated + minified + vendored + hand]
    rows += [("r/a/blob.go", "h", "go", 1_700_000, 1, 1, 2, None), ("r/a/zero.go", "h", "go", 700_000, 1, 1, 0, None), ("r/a/big.go", "h", "go", 141_895, 1, 1, 254, None), ("r/a/nocount.go", "h", "go", 1_700_000, 1, 1, None, None), ("r/a/nosize.go", "h", "go", None, 1, 1, 1, None), ("r/a/small.go", "h", "go", 49_000, 1, 1, 1, None)]
    rows += [("r/a/was.go", "h", "go", 1_700_000, 1, 1, 2, None), ("r/a/was.go", "h", "go", 1_000, 1, 9, 2, None), ("r/a/was.go", "h", "go", 1_000, 1, 9, 2, None), (None, "h", "go", 1, 1, 1, 1, None)]
    files = spark.createDataFrame(rows, FILE)
    got = {r.path: r.label for r in origin.label_files(files).collect()}
    assert {p for p, label in got.items() if label == "handwritten"} == {*hand, "r/a/big.go", "r/a/nocount.go", "r/a/nosize.go", "r/a/small.go", "r/a/was.go"}
    assert {p for p, label in got.items() if label == "blob"} == {"r/a/blob.go", "r/a/zero.go"}
    assert {p for p, label in got.items() if label == "minified"} == set(minified) and {p for p, label in got.items() if label == "vendored"} == set(vendored)
    assert origin.label_files(files.limit(0)).count() == 0


def exact_marginals(files):
    """p_handwritten of files (path, size, node_count) by summing over all labels of all files and directories."""
    import math
    import re

    import numpy as np

    def evidence(path, size, count):
        width = math.log(origin.SURE_RATIO / origin.DOUBT_RATIO)
        grade = 0.0
        if size is not None and count is not None:
            grade = (math.log(size / max(count, 1)) - math.log(math.sqrt(origin.SURE_RATIO * origin.DOUBT_RATIO))) / width * 2 * origin.SIZE
            grade = -origin.SIZE if size <= origin.LARGE_BYTES else max(-origin.SIZE, min(origin.SIZE, grade))
        mark = lambda p: origin.FILE_NAME if re.search(p, path) else -origin.FILE_NAME
        return [0.0, mark(origin.GENERATED_FILE), mark(origin.MINIFIED_FILE), 0.0, grade, 0.0]

    def name(folder, label):
        last = folder.rsplit("/", 1)[-1]
        if label == origin.VENDORED and re.fullmatch(origin.VENDORED_DIR, last) or label == origin.OUTPUT and re.fullmatch(origin.GENERATED_DIR, last):
            return math.exp(origin.DIR_NAME)
        return None

    parent = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    folders = {""}
    for path, *_ in files:
        while path:
            path = parent(path)
            folders.add(path)
    folders, labels = sorted(folders), range(len(origin.LABELS))
    weight, fit = [np.exp(evidence(*f)) for f in files], np.array(origin.POTENTIAL)
    total, hand = 0.0, np.zeros(len(files))
    for choice in itertools.product(labels, repeat=len(folders)):
        own = dict(zip(folders, choice))
        p = origin.NESTED[origin.HAND][own[""]]
        for f in folders:
            p *= name(f, own[f]) or (origin.NESTED[own[parent(f)]][own[f]] if f else 1.0)
        parts = [fit[own[parent(f[0])]] * w for f, w in zip(files, weight)]
        p *= np.prod([x.sum() for x in parts])
        total += p
        hand += [p * x[origin.HAND] / x.sum() for x in parts]
    return hand / total


BELIEFS = [
    [("f1.go", 60_000, 15), ("f2.go", 90_000, 18), ("f3.go", 10, 1)],
    [("r/vendor/a/x.go", 10, 1), ("r/y.go", 70_000, 14), ("r/vendor/x.pb.go", 10, 1)],
    [("r/q/big.go", 700_000, None), *((f"r/q/b{k}.go", 90_000 + k, 1) for k in range(4))],
    [("r/dist/d/x.min.js", 10, 1), ("r/dist/y.js", 60_000, 20), ("r/z.js", 60_000, 20)],
]


@pytest.mark.parametrize("files", BELIEFS)
def test_beliefs_are_exact(spark, files):
    rows = [(p, "h", "x", size, 1, 1, count, None) for p, size, count in files]
    got = {r.path: r.p_handwritten for r in origin.label_files(spark.createDataFrame(rows, FILE)).collect()}
    assert [got[f[0]] for f in files] == pytest.approx(list(exact_marginals(files)), rel=1e-9)


def test_siblings_and_parents_decide_where_a_file_tells_nothing(spark, monkeypatch):
    monkeypatch.setattr(origin, "HOT_FILES", 10)  # the salted join as well
    paths = [f"r/pb/m{k}.pb.go" for k in range(30)] + ["r/pb/client.go"]
    paths += [f"r/js/m{k}.min.js" for k in range(30)] + ["r/js/plain.js"]
    paths += [f"r/mixed/m{k}.pb.go" for k in range(3)] + ["r/mixed/client.go"]  # three marked ones make no rule
    paths += [f"r/vendor/lib/deep/er/m{k}.c" for k in range(5)] + ["r/src/m.c"]
    rows = [(p, "h", "x", 2000, 1, 1, 5, None) for p in paths]
    rows += [(f"r/data/t{k}.py", "h", "x", 900_000, 1, 1, 1, None) for k in range(12)] + [("r/data/nocount.py", "h", "x", 900_000, 1, 1, None, None), ("r/data/doubt.py", "h", "x", 60_000, 1, 1, 17, None), ("r/data/small.py", "h", "x", 4_000, 1, 1, 9, None), ("r/src/doubt.py", "h", "x", 60_000, 1, 1, 17, None)]
    got = {r.path: r.label for r in origin.label_files(spark.createDataFrame(rows, FILE)).collect()}
    want = {"r/pb/client.go": "generated", "r/js/plain.js": "generated", "r/mixed/client.go": "handwritten", "r/vendor/lib/deep/er/m3.c": "vendored", "r/src/m.c": "handwritten"}
    want |= {"r/data/nocount.py": "blob", "r/data/doubt.py": "blob", "r/data/small.py": "handwritten", "r/src/doubt.py": "handwritten"}
    assert {p: got[p] for p in want} == want
