"""Extraction: source files to symbols, links, references and errors, as a table function.

Python is parsed with its own grammar. Brace languages and Ruby are read by a declaration scanner over text whose
comments and strings are blanked, which is approximate: it sees declarations, members, calls, constructions, heritage
and imports, not types of expressions. Component and form formats are read by patterns. Files run in parallel, whole,
in Arrow batches; a file that fails gives an error row, never a failed task.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Languages by file extension.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx", ".py": "python", ".pyw": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp",
    ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".rake": "ruby", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart", ".scala": "scala", ".sc": "scala", ".svelte": "svelte",
    ".vue": "vue", ".liquid": "liquid", ".pas": "pascal", ".dpr": "pascal", ".dfm": "pascal", ".fmx": "pascal",
}
MAX_BYTES = 1 << 20
_CPP_HEADER = re.compile(r"\b(namespace|class|template\s*<|public:|private:|protected:|virtual|using\s+\w+\s*=|std::)")


def detect_language(path: str, source: str | None = None) -> str:
    """Language by extension; a .h file that shows C++ in its first 8 KiB is C++."""
    dot = path.rfind(".")
    language = EXTENSIONS.get(path[dot:].lower(), "unknown") if dot > path.rfind("/") else "unknown"
    if path.lower().endswith(".h") and source and _CPP_HEADER.search(source[:8192]):
        return "cpp"
    return language


def symbol_id(path: str, kind: str, name: str, line: int) -> str:
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


@dataclass
class Found:
    """Rows of one file."""

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)

    def node(self, kind: str, name: str, start: int, end: int, parent: dict | None, signature: str | None = None, docstring: str | None = None, exported: bool = False, **more) -> dict:
        scope = f"{parent['qualified_name']}::" if parent and parent["kind"] != "file" else ""
        row = {"id": symbol_id(self.path, kind, name, start) if kind != "file" else f"file:{self.path}", "kind": kind, "name": name, "qualified_name": scope + name, "file_path": self.path, "language": self.language, "start_line": start, "end_line": end}
        row |= {"docstring": docstring, "signature": signature, "visibility": more.get("visibility"), "is_exported": exported, "is_async": more.get("is_async", False), "is_static": more.get("is_static", False), "is_abstract": more.get("is_abstract", False)}
        self.nodes.append(row)
        if parent:
            self.edges.append({"source": parent["id"], "target": row["id"], "kind": "contains", "line": start})
        return row

    def ref(self, source: dict, name: str, kind: str, line: int, column: int = 0) -> None:
        if name:
            self.refs.append({"from_node_id": source["id"], "reference_name": name, "reference_kind": kind, "line": line, "col": column, "file_path": self.path, "language": self.language})


# Python


def extract_python(found: Found, source: str) -> None:
    tree = ast.parse(source)
    lines = source.count("\n") + 1
    top = found.node("file", found.path.rsplit("/", 1)[-1], 1, lines, None, exported=True)

    def dotted(x: ast.AST) -> str:
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Attribute):
            left = dotted(x.value)
            return x.attr if left in ("self", "cls", "super", "") else f"{left}.{x.attr}"
        return dotted(x.func) if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == "super" else ""

    def decorators(node: ast.AST, own: dict) -> None:
        for d in node.decorator_list:
            found.ref(own, dotted(d.func if isinstance(d, ast.Call) else d).rsplit(".", 1)[-1], "decorates", d.lineno)

    def visit(body: list[ast.stmt], parent: dict, inside_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
                own = found.node("method" if inside_class else "function", node.name, node.lineno, node.end_lineno or node.lineno, parent, f"({ast.unparse(node.args)}){returns}", ast.get_docstring(node), not node.name.startswith("_"), is_async=isinstance(node, ast.AsyncFunctionDef), is_static=static)
                decorators(node, own)
                calls(node.body, own)
                visit([n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], own, False)
            elif isinstance(node, ast.ClassDef):
                own = found.node("class", node.name, node.lineno, node.end_lineno or node.lineno, parent, None, ast.get_docstring(node), not node.name.startswith("_"))
                decorators(node, own)
                for base in node.bases:
                    found.ref(own, dotted(base), "extends", base.lineno)
                visit(node.body, own, True)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                module = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "")
                for alias in node.names:
                    name = alias.name if isinstance(node, ast.Import) else module
                    own = found.node("import", name, node.lineno, node.end_lineno or node.lineno, parent, ast.unparse(node))
                    if isinstance(node, ast.ImportFrom):
                        found.ref(top, alias.name if alias.name != "*" else module, "imports", node.lineno)
                    if isinstance(node, ast.ImportFrom):
                        break
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(t, ast.Name):
                        kind = "property" if inside_class else "constant" if t.id.isupper() else "variable"
                        value = ast.unparse(node.value)[:100] if node.value else ""
                        found.node(kind, t.id, node.lineno, node.end_lineno or node.lineno, parent, f"= {value}{'...' if len(value) >= 100 else ''}" if value else None)
                calls([node], parent)
            elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                calls([n for n in ast.iter_child_nodes(node) if isinstance(n, ast.expr)], parent)
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(node, part, []), parent, inside_class)
                for h in getattr(node, "handlers", []):
                    visit(h.body, parent, inside_class)
            else:
                calls([node], parent)

    def calls(body: list, own: dict) -> None:
        todo = list(body)
        while todo:
            node = todo.pop(0)
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(node, ast.Call):
                found.ref(own, dotted(node.func), "calls", node.lineno, node.col_offset)
            todo[:0] = list(ast.iter_child_nodes(node))

    visit(tree.body, top, False)


# Brace languages and Ruby

_KEYWORDS = frozenset("if for while switch catch return else do try match with when foreach using lock sizeof typeof new delete throw await yield in of instanceof function fn func fun def class super this self import require defined unless until case elsif and or not print".split())
_TYPES = re.compile(
    r"(?P<head>(?:@[\w.]+(?:\([^()]*\))?\s*)*)(?P<mods>(?:\b(?:export|default|public|private|protected|internal|static|final|abstract|sealed|open|data|partial|pub|declare|unsafe|inner|case|value|const)\b(?:\([\w:]+\))?\s+)*)"
    r"\b(?P<word>class|interface|struct|enum(?:\s+class)?|trait|protocol|namespace|module|object|union|record|extension|mixin|impl)\s+(?P<name>[A-Za-z_$][\w$]*)(?P<rest>[^{};]*)\{"
)
_GO_TYPES = re.compile(r"\btype\s+(?P<name>\w+)\s+(?P<word>struct|interface)\s*\{")
_ALIAS = re.compile(r"^[ \t]*(?:export\s+|pub\s+|public\s+)*(?:type|typealias|using)\s+(?P<name>\w+)(?:<[^=;]*>)?\s*=", re.M)
_FUNCTION = re.compile(
    r"(?P<mods>(?:\b(?:export|default|public|private|protected|internal|static|final|abstract|async|override|virtual|inline|suspend|open|pub|unsafe|const|extern|synchronized|operator|tailrec|external|mutating)\b(?:\([\w:]+\))?\s+)*)"
    r"\b(?:function\s*\*?|fn|func|fun|sub)\s*(?P<recv>\(\s*\w*\s*\*?\s*\w+(?:\[[^\]]*\])?\s*\))?\s*(?:<[^<>()]*>\s*)?(?P<rtype>\w+\.)?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>|\[[^\[\]]*\])?\s*(?P<sig>\([^{}]*?\)[^{};=]*?)(?=\{|=|;|\n)"
)
_MEMBER = re.compile(
    r"(?:(?<=[{};\n])|^)[ \t]*(?P<mods>(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|inline|const|readonly|synchronized|export|constexpr|explicit|extern|unsafe|new|get|set)\s+)*)"
    r"(?P<type>(?:[A-Za-z_][\w:.<>\[\],?*& ]*?[ \t*&>\]])?)(?P<name>~?[A-Za-z_$#][\w$]*)\s*(?:<[^<>()]*>)?\s*(?P<sig>\([^(){};]*(?:\([^()]*\)[^(){};]*)*\)[^{};=()]*)(?P<open>\{|;)",
    re.M,
)
_ARROW = re.compile(r"(?P<mods>(?:\bexport\s+)?)\b(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?P<sig>\([^{}]*?\)|[A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\]. |]+)?\s*=>")
_VARIABLE = re.compile(r"^[ \t]*(?P<mods>(?:export\s+|pub\s+|static\s+)*)(?:const|let|var|val)\s+(?:mut\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;\n]+)?=\s*(?P<value>[^;\n]*)", re.M)
_CALL = re.compile(r"(?<![\w$])(?P<new>new\s+)?(?P<name>[A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.|::|->)\s*[A-Za-z_$][\w$]*)*)\s*(?:<[\w, ]+>)?\s*\(")
_TYPE_KINDS = {"class": "class", "interface": "interface", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "protocol": "interface", "namespace": "namespace", "module": "module", "object": "class", "record": "class", "extension": "class", "mixin": "class"}
_IMPORTS = {
    "typescript": re.compile(r"^\s*(?:import|export)\b[^;'\"]*?(?:from\s*)?['\"](?P<m>[^'\"]+)['\"]|\brequire\(\s*['\"](?P<m2>[^'\"]+)['\"]\s*\)", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<m>[\w.]+(?:\.\*)?)\s*;?", re.M),
    "go": re.compile(r"^\s*(?:import\s+)?(?:\w+\s+|_\s+|\.\s+)?\"(?P<m>[\w./-]+)\"\s*$", re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+(?P<m>[\w:]+)", re.M),
    "c": re.compile(r"^\s*#\s*include\s*[<\"](?P<m>[^>\"]+)[>\"]", re.M),
    "csharp": re.compile(r"^\s*using\s+(?:static\s+)?(?P<m>[\w.]+)\s*;", re.M),
    "php": re.compile(r"^\s*use\s+(?P<m>[\w\\]+)", re.M),
    "swift": re.compile(r"^\s*import\s+(?P<m>\w+)", re.M),
    "dart": re.compile(r"^\s*import\s+['\"](?P<m>[^'\"]+)['\"]", re.M),
    "ruby": re.compile(r"^\s*require(?:_relative)?\s*\(?['\"](?P<m>[^'\"]+)['\"]", re.M),
}
_FAMILY = {"tsx": "typescript", "jsx": "typescript", "javascript": "typescript", "kotlin": "java", "scala": "java", "cpp": "c"}


def blank_comments(source: str, language: str, strings: bool = True) -> str:
    """The text with comments, and strings if asked, replaced by blanks; offsets and line ends stay."""
    hash_comments = language in ("python", "ruby", "php")
    parts = [r"/\*.*?(?:\*/|\Z)"] if language not in ("python", "ruby") else []
    if language == "rust":
        parts = []
    parts += [r"//[^\n]*"] if language not in ("python", "ruby") else []
    parts += [r"#(?!\[)[^\n]*"] if hash_comments else []
    if language == "ruby":
        parts.insert(0, r"^=begin\b.*?^=end\b")
    text = r'"""(?:\\.|[^\\])*?"""|' + r"'''(?:\\.|[^\\])*?'''|" if language in ("python", "kotlin", "scala", "swift", "java") else ""
    text += r'"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`' + (r"|'(?:\\.|[^'\\\n])*'" if language not in ("rust", "c", "cpp", "java", "csharp", "go", "kotlin", "scala", "swift") else r"|'(?:\\.|[^'\\\n])'")
    if language == "rust":  # nested comments
        out, k, depth = list(source), 0, 0
        while k < len(source):
            if source.startswith("/*", k):
                depth += 1
                out[k : k + 2] = "  "
                k += 2
            elif depth and source.startswith("*/", k):
                depth -= 1
                out[k : k + 2] = "  "
                k += 2
            else:
                if depth and source[k] != "\n":
                    out[k] = " "
                k += 1
        source = "".join(out)
    pattern = re.compile(f"(?P<text>{text})|(?P<note>{'|'.join(parts)})", re.S | re.M)

    def blank(m: re.Match) -> str:
        if m["text"] is not None and not strings:
            triple = language == "python" and m[0][:3] in ('"""', "'''")
            return re.sub(r"[^\n]", " ", m[0]) if triple else m[0]
        if m["text"] is not None:
            return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]
        return re.sub(r"[^\n]", " ", m[0])

    return pattern.sub(blank, source)


def _close(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def extract_braces(found: Found, source: str) -> None:
    text, language = blank_comments(source, found.language), found.language
    starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(at: int) -> int:
        import bisect

        return bisect.bisect_right(starts, at)

    top = found.node("file", found.path.rsplit("/", 1)[-1], 1, len(starts), None, exported=True)
    items: list[tuple[int, int, str, str, str, str, re.Match]] = []  # (start, end, kind, name, signature, mods, match)
    bodies: list[tuple[int, int]] = []
    for pattern in (_TYPES, _GO_TYPES):
        for m in pattern.finditer(text):
            word = m["word"].split()[0]
            end = _close(text, m.end() - 1)
            if word == "impl":
                bodies.append((m.start(), end))
                items.append((m.start(), end, "impl", m["name"], "", "", m))
                continue
            items.append((m.start("word") if pattern is _TYPES else m.start(), end, _TYPE_KINDS[word], m["name"], "", m.groupdict().get("mods") or "", m))
            if _TYPE_KINDS[word] in ("class", "interface", "struct", "trait", "enum"):
                bodies.append((m.start(), end))
    taken = {i[6].start("name") for i in items}
    for m in _FUNCTION.finditer(text):
        if m.start("name") in taken or m["name"] in _KEYWORDS:
            continue
        brace = re.compile(r"\s*\{").match(text, m.end())
        end = _close(text, brace.end() - 1) if brace else m.end()
        inside = any(a < m.start() < b for a, b in bodies)
        receiver = re.search(r"(\w+)(?:\[[^\]]*\])?\s*\)$", m["recv"])[1] if m["recv"] and re.search(r"(\w+)(?:\[[^\]]*\])?\s*\)$", m["recv"]) else ""
        items.append((m.start(), end, "method" if inside or receiver else "function", m["name"], " ".join(m["sig"].split()), m["mods"] + (f" recv:{receiver}" if receiver else ""), m))
        taken.add(m.start("name"))
    for m in _ARROW.finditer(text):
        brace = re.compile(r"\s*\{").match(text, m.end())
        end = _close(text, brace.end() - 1) if brace else (text.find("\n", m.end()) if "\n" in text[m.end() :] else len(text))
        items.append((m.start(), end, "function", m["name"], " ".join(m["sig"].split()), m["mods"], m))
        taken.add(m.start("name"))
    c_like = language in ("c", "cpp", "java", "csharp", "dart", "php")
    for m in _MEMBER.finditer(text):
        name = m["name"]
        if m.start("name") in taken or name in _KEYWORDS or (m["open"] == ";" and not any(a < m.start("name") < b for a, b in bodies)) or m["type"].strip() in ("return", "new", "else", "throw", "await", "in"):
            continue
        owner = max((b for b in bodies if b[0] < m.start("name") < b[1]), key=lambda b: b[0], default=None)
        if owner and text.count("{", owner[0], m.start("name")) - text.count("}", owner[0], m.start("name")) != 1:
            continue
        if not owner and (not c_like or not m["type"].strip() or text.count("{", 0, m.start("name")) != text.count("}", 0, m.start("name"))):
            continue
        if m["open"] == ";" and not (m["type"].strip() or m["mods"]):
            continue
        end = _close(text, m.end() - 1) if m["open"] == "{" else m.end()
        items.append((m.start("name"), end, "method" if owner else "function", name, " ".join(m["sig"].split()), m["mods"], m))
        taken.add(m.start("name"))
    functions = [(a, b) for a, b, kind, *_ in items if kind in ("function", "method")]
    for m in _ALIAS.finditer(text):
        if m.start("name") not in taken:
            items.append((m.start("name"), m.end(), "type_alias", m["name"], "", "", m))
    for m in _VARIABLE.finditer(text):
        if m.start("name") not in taken and not any(a < m.start("name") < b for a, b in functions) and not any(a < m.start("name") < b for a, b in bodies):
            value = source[m.start("value") : m.end("value")].strip()
            kind = "constant" if m["name"].isupper() else "variable"
            items.append((m.start("name"), m.end(), kind, m["name"], f"= {value[:100]}{'...' if len(value) >= 100 else ''}" if value else "", m["mods"], m))
    items.sort(key=lambda i: (i[0], -i[1]))
    stack: list[tuple[int, int, dict]] = [(0, len(text) + 1, top)]
    placed: list[tuple[int, int, dict]] = []
    types = {}
    for start, end, kind, name, signature, mods, m in items:
        while stack[-1][1] <= start:
            stack.pop()
        parent = stack[-1][2]
        if kind == "impl":
            target = re.match(r"\s*for\s+(\w+)", m["rest"])
            own = types.get(target[1] if target else name)
            if own and target:
                found.ref(own, name, "implements", line(start))
            stack.append((start, end, own or parent))
            continue
        above = source[:start].rstrip()
        note = re.search(r"/\*\*(.*?)\*/$|((?:^[ \t]*//[^\n]*\n?)+)\Z", above, re.S | re.M)
        doc = re.sub(r"^[ \t]*(?:\*|///?|//)?[ \t]?", "", (note[1] or note[2] or ""), flags=re.M).strip() if note else None
        visibility = next((v for v in ("public", "private", "protected", "internal") if v in mods.split()), None)
        exported = "export" in mods or "pub" in mods.split() or visibility == "public" or (language == "go" and name[:1].isupper())
        own = found.node(kind, name, line(start), line(end), parent, signature or None, doc or None, exported, visibility=visibility, is_async="async" in mods, is_static="static" in mods, is_abstract="abstract" in mods)
        if " recv:" in f" {mods}" and "recv:" in mods:
            own["qualified_name"] = f"{mods.split('recv:')[1]}::{name}"
        if kind in _TYPE_KINDS.values() and "rest" in m.groupdict():
            types[name] = own
            rest = re.sub(r"<[^<>]*>|\([^()]*\)", "", m["rest"])
            for word, link in (("extends", "extends"), ("implements", "implements"), (r"(?<!:):(?!:)", "extends"), ("with", "implements")):
                for part in re.findall(rf"{word if word.startswith('(') else chr(92) + 'b' + word + chr(92) + 'b'}\s*([\w$.:,\s]+?)(?=\bextends\b|\bimplements\b|\bwith\b|\bwhere\b|$)", rest):
                    for base in part.split(","):
                        base = re.sub(r"\b(public|private|protected|virtual)\b", "", base).strip()
                        if base:
                            found.ref(own, re.split(r"::|\.", base)[-1], link, line(start))
        elif kind in _TYPE_KINDS.values():
            types[name] = own
        lead = re.search(r"((?:@[\w.]+(?:\([^()]*\))?\s*)+)$", text[: m.start()].rstrip() + " ") if "head" not in m.groupdict() else None
        for d in re.findall(r"@([\w.]+)", (lead[1] if lead else "") + (m.groupdict().get("head") or "")):
            found.ref(own, d.rsplit(".", 1)[-1], "decorates", line(start))
        placed.append((start, end, own))
        if kind not in ("variable", "constant", "type_alias"):
            stack.append((start, end, own))
    scopes = [p for p in placed if p[2]["kind"] in ("function", "method")]
    names = {p[6].start("name") for p in items}
    for m in _CALL.finditer(text):
        if m.start("name") in names or m["name"] in _KEYWORDS:
            continue
        own = max((s for s in scopes if s[0] < m.start() < s[1]), key=lambda s: s[0], default=(0, 0, top))[2]
        name = re.sub(r"\s*(?:\?\.|->)\s*", ".", re.sub(r"\s+", "", m["name"]))
        name = re.sub(r"^(?:this|self|super|cls|\$this|Self)(?:\.|::)", "", name)
        if name in _KEYWORDS:
            continue
        found.ref(own, re.split(r"::|\.", name)[-1] if m["new"] else name, "instantiates" if m["new"] else "calls", line(m.start()), m.start() - starts[line(m.start()) - 1])
    plain = blank_comments(source, language, strings=False)
    pattern = _IMPORTS.get(_FAMILY.get(language, language))
    for m in pattern.finditer(plain) if pattern else ():
        module = m["m"] or m.groupdict().get("m2")
        found.node("import", module, line(m.start()), line(m.end() - 1), top, m[0].strip()[:200])
        found.ref(top, module, "imports", line(m.start()))


def extract_ruby(found: Found, source: str) -> None:
    lines = blank_comments(source, "ruby").split("\n")
    top = found.node("file", found.path.rsplit("/", 1)[-1], 1, len(lines), None, exported=True)
    stack: list[dict | None] = [top]
    for k, text in enumerate(lines, 1):
        own = next(s for s in reversed(stack) if s)
        if m := re.match(r"\s*(class|module)\s+([\w:]+)(?:\s*<\s*([\w:]+))?", text):
            node = found.node("class" if m[1] == "class" else "module", m[2], k, k, own, exported=True)
            if m[3]:
                found.ref(node, m[3], "extends", k)
            stack.append(node)
        elif m := re.match(r"\s*def\s+(?:self\.)?([\w?!=]+)\s*(\(.*\))?", text):
            kind = "method" if own["kind"] in ("class", "module") else "function"
            stack.append(found.node(kind, m[1], k, k, own, m[2] or "()", exported=True))
        else:
            for m in re.finditer(r"(?<![\w.:])((?:[A-Z]\w*(?:::[A-Z]\w*)*|\w+)\.)?([a-z_]\w*[?!]?)\s*\(|([A-Z]\w*(?:::\w+)*)\.new\b", text):
                if m[3]:
                    found.ref(own, m[3].split("::")[-1], "instantiates", k)
                elif m[2] not in _KEYWORDS and m[2] != "new":
                    found.ref(own, (m[1] or "").replace("self.", "") + m[2], "calls", k)
            if m := re.match(r"\s*require(?:_relative)?\s*\(?", text):
                pass
            if re.match(r"\s*(if|unless|while|until|case|begin|for)\b", text) or re.search(r"\bdo\b\s*(\|[^|]*\|)?\s*$", text):
                stack.append(None)
        if re.match(r"\s*end\b", text) and len(stack) > 1:
            done = stack.pop()
            if done:
                done["end_line"] = k
    for m in _IMPORTS["ruby"].finditer(source):
        k = source.count("\n", 0, m.start()) + 1
        found.node("import", m["m"], k, k, top, m[0].strip())
        found.ref(top, m["m"], "imports", k)


def extract_component(found: Found, source: str) -> None:
    """Svelte and Vue: the component, its scripts read as TypeScript at their lines, and the component tags of the template."""
    name = found.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    top = found.node("file", found.path.rsplit("/", 1)[-1], 1, source.count("\n") + 1, None, exported=True)
    component = found.node("component", name, 1, source.count("\n") + 1, top, exported=True)
    rest = source
    for m in re.finditer(r"<script\b([^>]*)>(.*?)</script>", source, re.S):
        shift = source.count("\n", 0, m.start(2))
        part = Found(found.path, "typescript" if "ts" in m[1] else "javascript")
        extract_braces(part, m[2])
        old = part.nodes[0]["id"]
        renamed = {}
        for n in part.nodes[1:]:
            n |= {"start_line": n["start_line"] + shift, "end_line": n["end_line"] + shift, "language": found.language}
            renamed[n["id"]] = n["id"] = symbol_id(found.path, n["kind"], n["name"], n["start_line"])
        found.nodes += part.nodes[1:]
        ids = {symbol_id(found.path, n["kind"], n["name"], n["start_line"] - shift): n["id"] for n in part.nodes[1:]} | {old: component["id"]}
        found.edges += [e | {"source": ids[e["source"]], "target": ids[e["target"]], "line": e["line"] + shift} for e in part.edges]
        found.refs += [r | {"from_node_id": ids[r["from_node_id"]], "line": r["line"] + shift, "language": found.language} for r in part.refs if not re.match(r"\$(state|derived|effect|props|bindable|inspect|host)\b|define(Props|Emits|Expose|Slots|Model|Options)$", r["reference_name"])]
        rest = rest.replace(m[0], "\n" * m[0].count("\n"))
    rest = re.sub(r"<style\b.*?</style>", lambda m: "\n" * m[0].count("\n"), rest, flags=re.S)
    for m in re.finditer(r"<([A-Z]\w*)", rest):
        found.ref(component, m[1], "references", rest.count("\n", 0, m.start()) + 1)
    for m in re.finditer(r"\{+[^{}]*?\b([a-z_$]\w*)\(", rest):
        if m[1] not in _KEYWORDS:
            found.ref(component, m[1], "calls", rest.count("\n", 0, m.start()) + 1)


def extract_liquid(found: Found, source: str) -> None:
    """Liquid: snippets and sections that a template brings in, its assignments and the name in its schema."""
    top = found.node("file", found.path.rsplit("/", 1)[-1], 1, source.count("\n") + 1, None, exported=True)
    for m in re.finditer(r"\{%-?\s*(render|include|section)\s+['\"]([^'\"]+)['\"]", source):
        k = source.count("\n", 0, m.start()) + 1
        own = found.node("import", m[2], k, k, top, m[0])
        found.node("component", m[2], k, k, own)
        found.ref(top, f"{'sections' if m[1] == 'section' else 'snippets'}/{m[2]}.liquid", "imports", k)
    for m in re.finditer(r"\{%-?\s*assign\s+(\w+)\s*=", source):
        k = source.count("\n", 0, m.start()) + 1
        found.node("variable", m[1], k, k, top)
    for m in re.finditer(r"\{%-?\s*schema\s*-?%\}(.*?)\{%-?\s*endschema", source, re.S):
        named = re.search(r'"name"\s*:\s*"([^"]+)"', m[1])
        k = source.count("\n", 0, m.start()) + 1
        found.node("constant", named[1] if named else "schema", k, source.count("\n", 0, m.end()) + 1, top)


def extract_form(found: Found, source: str) -> None:
    """Delphi forms: nested components and the handlers of their events."""
    top = found.node("file", found.path.rsplit("/", 1)[-1], 1, source.count("\n") + 1, None, exported=True)
    stack: list[dict | None] = [top]
    for k, text in enumerate(source.split("\n"), 1):
        own = next(s for s in reversed(stack) if s)
        if m := re.match(r"\s*(?:object|inherited|inline)\s+(\w+)\s*:\s*(\w+)", text):
            stack.append(found.node("component", m[1], k, k, own, m[2]))
        elif re.match(r"\s*item\s*$", text) or re.search(r"=\s*<\s*$", text):
            stack.append(None)
        elif re.match(r"\s*end>?\s*$", text) and len(stack) > 1:
            done = stack.pop()
            if done:
                done["end_line"] = k
        elif m := re.match(r"\s*On\w+\s*=\s*(\w+)\s*$", text):
            found.ref(own, m[1], "references", k)


def extract_pascal(found: Found, source: str) -> None:
    """Units, used units, types, routines with their bodies, and calls; names are compared without case."""
    text = re.sub(r"\{[^}]*\}|\(\*.*?\*\)|//[^\n]*|'(?:[^'\n]|'')*'", lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)
    line = lambda at: text.count("\n", 0, at) + 1
    top = found.node("file", found.path.rsplit("/", 1)[-1], 1, source.count("\n") + 1, None, exported=True)
    unit = re.search(r"(?i)^\s*(?:unit|program|library)\s+([\w.]+)\s*;", text, re.M)
    scope = found.node("module", unit[1], line(unit.start(1)), source.count("\n") + 1, top, exported=True) if unit else top
    for m in re.finditer(r"(?i)\buses\b([^;]*);", text):
        for name in re.findall(r"[\w.]+", re.sub(r"(?i)\bin\b[^,]*", "", m[1])):
            found.node("import", name, line(m.start()), line(m.end()), scope)
            found.ref(top, name, "imports", line(m.start()))
    types, border = {}, (re.search(r"(?i)^\s*implementation\b", text, re.M) or re.search(r"\Z", text)).start()
    kinds = {"class": "class", "interface": "interface", "record": "struct", "dispinterface": "interface", "object": "class"}
    for m in re.finditer(r"(?i)^[ \t]*(\w+)(?:<[^>]*>)?\s*=\s*(?:packed\s+)?(class|interface|record|dispinterface|object)\b(?!\s*(?:of\b|;))\s*(?:\(([^)]*)\))?", text, re.M):
        end = re.compile(r"(?i)\bend\s*;").search(text, m.end())
        own = types[m[1].lower()] = found.node(kinds[m[2].lower()], m[1], line(m.start(1)), line(end.end() if end else m.end()), scope, exported=m.start() < border)
        for k, base in enumerate(x.strip() for x in (m[3] or "").split(",") if x.strip()):
            found.ref(own, base, "extends" if not k else "implements", line(m.start()))
    spots, declared = [], {}
    for m in re.finditer(r"(?i)^[ \t]*(?:class\s+)?(procedure|function|constructor|destructor|operator)\s+(?:(\w+)\.)?(\w+)\s*(\([^)]*\))?\s*(:\s*[\w.<>]+)?\s*;", text, re.M):
        owner = types.get((m[2] or "").lower()) or next((t for t in types.values() if t["start_line"] < line(m.start(3)) <= t["end_line"]), None)
        key = ((owner or {}).get("name", "").lower(), m[3].lower())
        own = declared.get(key)
        if own is None:
            signature = " ".join(((m[4] or "") + (m[5] or "")).split()) or None
            own = declared[key] = found.node("method" if owner else "function", m[3], line(m.start(3)), line(m.end()), owner or scope, signature, exported=m.start() < border)
        if m.start() > border or border == len(text):
            spots.append((m.end(), own))
    for k, (at, own) in enumerate(spots):
        stop = spots[k + 1][0] if k + 1 < len(spots) else len(text)
        own["end_line"] = max(own["end_line"], line(text.rfind("end", at, stop) if text.rfind("end", at, stop) > 0 else at))
        for c in re.finditer(r"\b([A-Za-z_]\w*(?:\.\w+)*)\s*\(", text[at:stop]):
            if c[1].lower() not in ("if", "while", "procedure", "function", "and", "or", "not", "array", "set", "constructor", "destructor") and not re.search(r"(?i)(procedure|function|constructor|destructor)\s+$", text[at : at + c.start()][-20:]):
                found.ref(own, c[1], "calls", line(at + c.start()))


@dataclass
class Registry:
    """Extractors by language, and additional ones that add rows to any file; all may be replaced."""

    languages: dict[str, Callable[[Found, str], None]] = field(default_factory=dict)
    frameworks: dict[str, Callable[[Found, str], None]] = field(default_factory=dict)

    def register(self, name: str, extractor: Callable[[Found, str], None], framework: bool = False) -> None:
        (self.frameworks if framework else self.languages)[name] = extractor


def default_registry() -> Registry:
    from graphloom.operators.frameworks import FRAMEWORKS

    braces = "typescript tsx javascript jsx go rust java c cpp csharp php swift kotlin dart scala".split()
    return Registry({"python": extract_python, "ruby": extract_ruby, "svelte": extract_component, "vue": extract_component, "liquid": extract_liquid, "pascal": extract_pascal} | dict.fromkeys(braces, extract_braces), dict(FRAMEWORKS))


def extract_source(path: str, source: str | None, language: str | None = None, registry: Registry | None = None) -> Found:
    """Rows of one file; too large, unsupported or broken files give an error row instead of an exception."""
    registry = registry or default_registry()
    language = language or detect_language(path, source)
    found = Found(path, language)
    extractor = extract_form if path.lower().endswith((".dfm", ".fmx")) else registry.languages.get(language)
    try:
        if source is None:
            found.errors.append({"message": "Failed to read file", "file_path": path, "line": None, "severity": "error", "code": "read_error"})
        elif len(source) > MAX_BYTES:
            found.errors.append({"message": f"File exceeds max size ({len(source)} > {MAX_BYTES})", "file_path": path, "line": None, "severity": "error", "code": "size_exceeded"})
        elif extractor is None:
            found.errors.append({"message": f"Unsupported language: {language}", "file_path": path, "line": None, "severity": "error", "code": "unsupported_language"})
        else:
            extractor(found, source)
            for more in registry.frameworks.values():
                more(found, source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        found = Found(path, language, errors=[{"message": f"Parse error: {e}", "file_path": path, "line": getattr(e, "lineno", None), "severity": "error", "code": "parse_error"}])
    return found


NODE_SCHEMA = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean"
EDGE_SCHEMA = "source string, target string, kind string, line int"
REF_SCHEMA = "from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string"
ERROR_SCHEMA = "message string, file_path string, line int, severity string, code string"


def extract(files: DataFrame, path_col: str = "path", content_col: str = "content", language_col: str | None = None, registry: Registry | None = None) -> DataFrame:
    """(path, language, nodes, edges, refs, errors), arrays of rows, one row for each file of files.

    A null content is a read error; empty files give their file symbol. Use explode_rows() for flat tables.
    """
    schema = f"path string, language string, nodes array<struct<{_inner(NODE_SCHEMA)}>>, edges array<struct<{_inner(EDGE_SCHEMA)}>>, refs array<struct<{_inner(REF_SCHEMA)}>>, errors array<struct<{_inner(ERROR_SCHEMA)}>>"
    chosen = registry or default_registry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [extract_source(p, c, lang or None, chosen) for p, c, lang in zip(batch["path"], batch["content"], batch["language"])]
            yield pd.DataFrame({"path": [f.path for f in rows], "language": [f.language for f in rows], "nodes": [f.nodes for f in rows], "edges": [f.edges for f in rows], "refs": [f.refs for f in rows], "errors": [f.errors for f in rows]})

    language = files[language_col] if language_col else F.lit(None).cast("string")
    return files.select(files[path_col].alias("path"), files[content_col].cast("string").alias("content"), language.alias("language")).mapInPandas(run, schema)


def _inner(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (p.split() for p in schema.split(", ")))


def explode_rows(extracted: DataFrame, column: str) -> DataFrame:
    """One table of an extraction: nodes, edges, refs or errors."""
    return extracted.select(F.explode(column).alias("r")).select("r.*")


# Texts of several languages

#: The first lines of declarations that tell a language, in the order in which they are tried.
_HEADERS = [(name, re.compile(pattern)) for name, pattern in (
    ("python", r"(?:async\s+)?def\s+\w+\s*(?:\[[^\]]*\]\s*)?\((?:.*:\s*(?:#.*|\.\.\.|pass|return\b.*)?$|[^)]*$)|class\s+\w+\s*(?:\([^{}]*\))?\s*:\s*(?:#.*|\.\.\.|pass)?$|from\s+[\w.]+\s+import\b|import\s+[\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*\s*(?:#.*)?$|if\s+__name__\b"),
    ("ruby", r"def\s+[\w.]+[?!=]?\s*(?:\(.*\)\s*)?(?:#.*)?$|(?:class|module)\s+[A-Z][\w:]*(?:\s*<\s*[\w:]+)?\s*(?:#.*)?$|require(?:_relative)?\s+['\"]"),
    ("swift", r"(?:\w+\s+)*func\s+\w+\s*(?:<[^<>]*>\s*)?\((?:[^()]*\w\s*:|.*->)"),
    ("go", r"func\s*[(\w]|package\s+\w+\s*$|type\s+\w+\s+(?:struct|interface)\b|import\s*(?:\(|\")|(?:var|const)\s*\("),
    ("rust", r"(?:pub(?:\([\w:]+\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"\w+\")?)\s+)*fn\s+\w|pub\s+(?:struct|enum|trait|mod|use|type|const|static)\b|impl\b|mod\s+\w+\s*[{;]|use\s+\w+(?:::|\s*;)"),
    ("kotlin", r"(?:\w+\s+)*fun\s+(?:<[^<>]*>\s*)?[\w.]+\s*\(|(?:data|sealed)\s+class\b"),
    ("java", r"package\s+[\w.]+\s*;|import\s+(?:static\s+)?[\w.]+(?:\.\*)?\s*;|(?:public|protected|private|final)\s+(?:(?:static|final|abstract)\s+)*(?:class|interface|enum|record)\b"),
    ("csharp", r"using\s+(?:static\s+)?[\w.]+\s*;|namespace\s+[\w.]+\s*[;{]?\s*$"),
    ("php", r"<\?php|use\s+\w+\\"),
    ("cpp", r"#\s*(?:include|define|ifn?def|pragma)\b|template\s*<|using\s+namespace\b"),
    ("typescript", r"export\b|(?:async\s+)?function\b|(?:const|let|var)\s+[\w${\[]|import\b.*['\"]|declare\b|type\s+\w+.*="),
    ("", r"(?:abstract\s+)?(?:class|interface|enum|struct|trait)\s+\w+[^:]*\{"),
)]
_WITH_CLASSES = frozenset("java csharp kotlin swift scala dart php cpp rust".split())
_ENDING = {name: ending for ending, name in reversed(EXTENSIONS.items())}


def _parses(lines: list[str]) -> bool:
    try:
        ast.parse("\n".join(lines))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _python_lines(lines: list[str]) -> list[str | None]:
    """The lines of a part that begins as Python, None for those that are not: where the whole does not parse, each
    statement stands for itself, and one that begins as Python and breaks off keeps what parses from its start."""
    if _parses(lines):
        return list(lines)
    out: list[str | None] = []
    chunks: list[list[str]] = []
    for text in lines:
        open_text = chunks and ("\n".join(chunks[-1]).count('"""') % 2 or "\n".join(chunks[-1]).count("'''") % 2)
        joined = chunks and (not text.strip() or text[0].isspace() or text[0] in ")]}" or re.match(r"(?:else|elif|except|finally)\b", text) or all(re.match(r"[@#\s]|$", x) for x in chunks[-1]) or open_text)
        chunks[-1].append(text) if joined else chunks.append([text])
    for chunk in chunks:
        if _parses(chunk):
            out += chunk
            continue
        kept: list[str] = []
        if any(_HEADERS[0][1].match(x) for x in chunk):
            for k in range(len(chunk), 0, -1):
                short = [*chunk[: k - 1], chunk[k - 1] + " pass"] if chunk[k - 1].rstrip().endswith(":") else chunk[:k]
                if _parses(short):
                    kept = short
                    break
        out += kept + [None] * (len(chunk) - len(kept))
    return out


def language_sections(source: str) -> list[tuple[str, str]]:
    """(language, text) of the languages of a text: its lines, with those of the other languages left empty.

    A line at the left margin that begins a declaration sets the language until the next; comments and annotations before
    it go with it. What tells no language goes with what is before, or else is TypeScript. Every line belongs to one.
    """
    lines = re.split(r"\r\n?|\n", source)
    owner, current, waiting, comment, quote = [], "typescript", 0, False, ""
    for text in lines:
        found = None
        if not comment and not quote and text and not text[0].isspace():
            found = next((name for name, pattern in _HEADERS if pattern.match(text)), None)
            if found == "":
                found = current if current in _WITH_CLASSES - {"rust"} or (current == "rust" and not text.startswith(("class", "interface", "abstract"))) else "typescript"
        if found:
            owner[len(owner) - waiting :] = [found] * waiting
            current, waiting = found, 0
        elif comment or (not quote and re.match(r"//|/\*|#|@", text)) or (waiting and not text.strip()):
            waiting += 1
        else:
            waiting = 0
        if found or not waiting:
            if current == "python":
                for mark in re.findall(r'"""|\'\'\'', text):
                    quote = mark if not quote else "" if mark == quote else quote
        comment = "*/" not in text if comment else text.startswith("/*") and "*/" not in text
        owner.append(current)
    kept = list(lines)
    k = 0
    while k < len(lines):
        end = k
        while end < len(lines) and owner[end] == owner[k]:
            end += 1
        if owner[k] == "python":
            for at, text in enumerate(_python_lines(lines[k:end]), k):
                owner[at], kept[at] = ("python", text) if text is not None else ("typescript", lines[at])
        k = end
    names = dict.fromkeys(o for o, text in zip(owner, kept) if text.strip()) or {"typescript": None}
    return [(name, "\n".join(text if o == name else "" for o, text in zip(owner, kept))) for name in names]


def split_languages(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, content): a row for each language of each text without an extension, whose path gets that of the language."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path + _ENDING[name], text) for path, content in zip(batch["path"], batch["content"]) for name, text in language_sections(content or "")]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return files.select(files[path_col].alias("path"), files[content_col].cast("string").alias("content")).mapInPandas(run, "path string, content string")


# Imports and re-exports


def import_mappings(source: str, language: str) -> list[tuple[str, str, str]]:
    """(local name, exported name, module) of the imports of a file; * for namespaces, default for default imports."""
    text, out = blank_comments(source, language, strings=False), []
    if language in ("typescript", "tsx", "javascript", "jsx", "svelte", "vue"):
        for m in re.finditer(r"\bimport\s+(?:type\s+)?(?:(?P<default>[\w$]+)\s*,?\s*)?(?:\{(?P<named>[^}]*)\}|\*\s+as\s+(?P<space>[\w$]+))?\s*from\s*['\"](?P<module>[^'\"]+)['\"]", text):
            if m["default"]:
                out.append((m["default"], "default", m["module"]))
            if m["space"]:
                out.append((m["space"], "*", m["module"]))
            for part in (m["named"] or "").split(","):
                names = re.split(r"\s+as\s+", re.sub(r"^\s*type\s+", "", part).strip())
                if names[0]:
                    out.append((names[-1], names[0], m["module"]))
        for m in re.finditer(r"\b(?:const|let|var)\s+(?:(?P<whole>[\w$]+)|\{(?P<named>[^}]*)\})\s*=\s*require\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)", text):
            if m["whole"]:
                out.append((m["whole"], "default", m["module"]))
            for part in (m["named"] or "").split(","):
                names = [x.strip() for x in part.split(":")]
                if names[0]:
                    out.append((names[-1], names[0], m["module"]))
    elif language == "python":
        for m in re.finditer(r"^[ \t]*from\s+(?P<module>[.\w]+)\s+import\s+(?:\((?P<many>[^)]*)\)|(?P<few>[^\n#]*))", text, re.M):
            for part in (m["many"] or m["few"] or "").split(","):
                names = re.split(r"\s+as\s+", part.strip())
                if names[0]:
                    out.append((names[-1], names[0], m["module"]))
        for m in re.finditer(r"^[ \t]*import\s+(?P<list>[^\n#]+)", text, re.M):
            for part in m["list"].split(","):
                names = re.split(r"\s+as\s+", part.strip())
                if names[0]:
                    out.append((names[-1] if len(names) > 1 else names[0].split(".")[0], "*", names[0]))
    elif language == "go":
        for m in re.finditer(r"^[ \t]*(?:import\s+)?(?:(?P<alias>[\w.]+)\s+)?\"(?P<module>[\w./-]+)\"\s*$", text, re.M):
            out.append((m["alias"] or m["module"].rsplit("/", 1)[-1], "*", m["module"]))
    elif language == "php":
        for m in re.finditer(r"^[ \t]*use\s+(?P<module>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", text, re.M):
            last = m["module"].rsplit("\\", 1)[-1]
            out.append((m["alias"] or last, last, m["module"]))
    return out


def re_exports(source: str) -> list[tuple[str, str, str]]:
    """(exported name or *, name in the module, module) of the re-exports of a JavaScript or TypeScript file."""
    out = []
    for m in re.finditer(r"\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+(?P<space>[\w$]+))?|\{(?P<named>[^}]*)\})\s*from\s*['\"](?P<module>[^'\"]+)['\"]", blank_comments(source, "typescript", strings=False)):
        if m["named"] is None:
            out.append((m["space"] or "*", "*", m["module"]))
        for part in (m["named"] or "").split(","):
            names = re.split(r"\s+as\s+", part.strip())
            if names[0]:
                out.append((names[-1], names[0], m["module"]))
    return out


#: What a relative import may stand for, in order.
IMPORT_ENDINGS = {"typescript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"], "javascript": [".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"], "python": [".py", "/__init__.py"]}
IMPORT_ENDINGS |= {"tsx": IMPORT_ENDINGS["typescript"], "jsx": IMPORT_ENDINGS["javascript"], "svelte": IMPORT_ENDINGS["typescript"], "vue": IMPORT_ENDINGS["typescript"]}


def import_candidates(importer: str, module: str, language: str, aliases: list[tuple[str, str]] = ()) -> list[str]:
    """Files that an import may mean, best first: relative to the importer, or through aliases (pattern, replacement)."""
    import posixpath

    bases = []
    if language == "python" and not module.startswith("."):
        bases = [module.replace(".", "/")]
    elif module.startswith("."):
        folder = posixpath.dirname(importer)
        if language == "python":
            dots = len(module) - len(module.lstrip("."))
            bases = [posixpath.normpath(posixpath.join(folder, *[".."] * (dots - 1), module.lstrip(".").replace(".", "/")))]
        else:
            bases = [posixpath.normpath(posixpath.join(folder, module))]
    else:
        for pattern, target in sorted(aliases, key=lambda a: (-len(a[0].split("*")[0]), "*" in a[0])):
            head, star, tail = pattern.partition("*")
            if module == pattern and not star:
                bases.append(target)
                break
            if star and module.startswith(head) and module.endswith(tail) and len(module) >= len(head) + len(tail):
                bases.append(target.replace("*", module[len(head) : len(module) - len(tail)]))
                break
        for prefix in ("@/", "~/", "@src/", "src/", "@app/", "app/"):
            if module.startswith(prefix):
                bases.append("src/" + module[len(prefix) :])
    return [b + e for b in bases for e in [*IMPORT_ENDINGS.get(language, []), ""]]


_MAPPING = "path string, local_name string, export_name string, module string, candidates array<string>"


def import_table(files: DataFrame, path_col: str = "path", content_col: str = "content", language_col: str | None = None, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Imports of all files: (path, local_name, export_name, module, candidates); aliases are (pattern, target) of module paths."""
    return _import_rows(files, path_col, content_col, language_col, aliases, import_mappings)


def export_table(files: DataFrame, path_col: str = "path", content_col: str = "content", language_col: str | None = None, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Re-exports of all files, in the columns of import_table(): local_name is the exported name or *, export_name the name in the module."""
    return _import_rows(files, path_col, content_col, language_col, aliases, lambda text, language: re_exports(text) if _FAMILY.get(language, language) == "typescript" else [])


def _import_rows(files: DataFrame, path_col: str, content_col: str, language_col: str | None, aliases: list[tuple[str, str]], names: Callable[[str, str], list[tuple[str, str, str]]]) -> DataFrame:
    aliases = list(aliases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, language in zip(batch["path"], batch["content"], batch["language"]):
                language = language or detect_language(path, content)
                rows += [(path, a, b, m, import_candidates(path, m, language, aliases)) for a, b, m in names(content or "", language)]
            yield pd.DataFrame(rows, columns=["path", "local_name", "export_name", "module", "candidates"])

    language = files[language_col] if language_col else F.lit(None).cast("string")
    return files.select(files[path_col].alias("path"), files[content_col].cast("string").alias("content"), language.alias("language")).mapInPandas(run, _MAPPING)
