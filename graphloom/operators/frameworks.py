"""Web and UI frameworks: how a project shows that it uses one, routes and components in its files, naming conventions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VERBS = "get|post|put|patch|delete|options|head|all"


@dataclass(frozen=True)
class Convention:
    """Names of one form mean symbols of some kinds, preferably below some directories."""

    pattern: str
    kinds: Sequence[str]
    folders: str
    confidence: float


@dataclass(frozen=True)
class Framework:
    """detect: (path pattern, content pattern) of a file that shows the framework; routes: patterns with verb, path and handler."""

    name: str
    languages: Sequence[str]
    detect: Sequence[tuple[str, str]]
    routes: Sequence[str] = ()
    conventions: Sequence[Convention] = ()


JS = ["javascript", "typescript", "jsx", "tsx"]
CLASSES, CODE = ["class", "struct", "interface"], ["function", "method"]
#: The frameworks.
FRAMEWORKS_TABLE = [
    Framework("laravel", ["php"], [(r"(^|/)artisan$", ""), (r"Http/Kernel\.php$", "")], [rf"Route::(?P<verb>{_VERBS}|any|match|resource|apiResource)\(\s*['\"](?P<path>[^'\"]*)['\"]\s*(?:,\s*(?P<handler>\[[^\]]*\]|['\"][^'\"]+['\"]|[\w\\]+::class))?"], [Convention(r"^[A-Z]\w*Controller$", CLASSES, r"Controllers/", 0.9), Convention(r"^[A-Z]\w*$", CLASSES, r"Models?/", 0.85)]),
    Framework("express", JS, [(r"(^|/)package\.json$", r"\"(express|fastify|koa)\""), (r"\.[cm]?[jt]s$", r"require\(['\"]express['\"]\)|from ['\"]express['\"]")], [rf"\b(?:app|router|server|\w*[rR]outer)\.(?P<verb>{_VERBS}|use)\(\s*['\"`](?P<path>/[^'\"`]*)['\"`]\s*,\s*(?:[\w.]+\s*,\s*)*(?P<handler>[\w.]+)?"], [Convention(r"\w+Controller$", [*CLASSES, *CODE], r"controllers?/", 0.85), Convention(r"\w+Service$", [*CLASSES, *CODE], r"services?/", 0.8), Convention(r"\w+([mM]iddleware|Guard|Auth)$", CODE, r"middlewares?/", 0.8)]),
    Framework("react", JS, [(r"(^|/)package\.json$", r"\"(react|next|react-native)\""), (r"\.[jt]sx$", "")], [r"<Route\s+[^>]*path=['\"{](?P<path>[^'\"}]+)['\"}][^>]*?(?:component|element)=\{<?(?P<handler>\w+)"], [Convention(r"^use[A-Z]\w*$", CODE, r"hooks?/", 0.85), Convention(r"^[A-Z]\w*(Context|Provider)$", ["variable", "constant", "function", "component"], r"contexts?/", 0.8), Convention(r"^[A-Z]\w*$", ["component", "function", "class"], r"components?/", 0.8)]),
    Framework("svelte", ["svelte", *JS], [(r"(^|/)package\.json$", r"\"(svelte|@sveltejs/kit)\""), (r"\.svelte$", "")], [], [Convention(r"^[A-Z]\w*$", ["component"], r"lib/|components?/", 0.8), Convention(r"^\w+[sS]tore$", ["variable", "constant", "function"], r"stores?/", 0.85)]),
    Framework("vue", ["vue", *JS], [(r"(^|/)package\.json$", r"\"(vue|nuxt)\""), (r"\.vue$", "")], [r"\bpath\s*:\s*['\"](?P<path>/[^'\"]*)['\"]\s*,[^{}]*?component\s*:\s*(?P<handler>\w+)"], [Convention(r"^use[A-Z]\w*$", CODE, r"composables?/", 0.85), Convention(r"^[A-Z]\w*$", ["component"], r"components?/|pages/", 0.8)]),
    Framework("django", ["python"], [(r"(requirements[^/]*\.txt|pyproject\.toml|setup\.py)$", r"(?i)django"), (r"(^|/)manage\.py$", "")], [r"\b(?:re_path|path|url)\(\s*r?['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?P<handler>(?:include\([^)]*\)|[\w.]+)(?:\.as_view\([^)]*\))?)"], [Convention(r"^[A-Z]\w*(View|ViewSet)$", CLASSES, r"views", 0.8), Convention(r"^[A-Z]\w*Form$", CLASSES, r"forms", 0.8), Convention(r"^[A-Z]\w*$", ["class"], r"models", 0.8)]),
    Framework("flask", ["python"], [(r"(requirements[^/]*\.txt|pyproject\.toml)$", r"(?i)flask"), (r"\.py$", r"Flask\(__name__\)")], [r"@\w+\.route\(\s*['\"](?P<path>[^'\"]*)['\"][^)]*?(?:methods\s*=\s*\[\s*['\"](?P<verb>\w+)['\"][^\]]*\])?[^)]*\)(?:\s*@[^\n]*)*\s*(?:async\s+)?def\s+(?P<handler>\w+)"], [Convention(r"\w+(_bp|_blueprint|Blueprint)$", ["variable", "constant"], r"", 0.8)]),
    Framework("fastapi", ["python"], [(r"(requirements[^/]*\.txt|pyproject\.toml)$", r"(?i)fastapi"), (r"\.py$", r"FastAPI\(")], [rf"@\w+\.(?P<verb>{_VERBS})\(\s*['\"](?P<path>[^'\"]*)['\"][^)]*\)(?:\s*@[^\n]*)*\s*(?:async\s+)?def\s+(?P<handler>\w+)"], [Convention(r"^\w*router$", ["variable", "constant"], r"routers?|api", 0.8), Convention(r"^get_\w+$", CODE, r"dep", 0.75)]),
    Framework("rails", ["ruby"], [(r"(^|/)Gemfile$", r"\brails\b"), (r"config/routes\.rb$", "")], [r"^\s*(?P<verb>get|post|put|patch|delete|match|root|resources|resource)\s+(?:to:\s*)?[:'\"](?P<path>[\w/:.*()-]+)['\"]?(?:\s*(?:=>|,\s*to:)\s*['\"](?P<handler>[\w/]+#\w+)['\"])?"], [Convention(r"^[A-Z]\w*Controller$", ["class"], r"controllers/", 0.85), Convention(r"^[A-Z]\w*(Helper|Service)$", ["class", "module"], r"helpers/|services/", 0.8), Convention(r"^[A-Z]\w*$", ["class"], r"models/", 0.8)]),
    Framework("spring", ["java", "kotlin"], [(r"(pom\.xml|build\.gradle(\.kts)?)$", r"spring"), (r"\.(java|kt)$", r"@(SpringBootApplication|RestController|Controller)\b")], [r"@(?P<verb>Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"(?P<path>[^\"]*)\"[^)]*\)(?:\s*@[^\n]*)*\s*(?:public|private|protected|fun)?\s*(?:[\w<>\[\],.? ]+?\s+)?(?P<handler>\w+)\s*\("], [Convention(r"^[A-Z]\w*(Service|Repository|Controller)(Impl)?$", CLASSES, r"service|repositor|controller", 0.85), Convention(r"^[A-Z]\w*(Component|Config|Configuration)$", CLASSES, r"component|config", 0.8), Convention(r"^[A-Z]\w*$", CLASSES, r"entit|model|domain", 0.7)]),
    Framework("go-routers", ["go"], [(r"(^|/)go\.mod$", ""), (r"\.go$", r"net/http|gin-gonic|labstack/echo|gorilla/mux|go-chi")], [r"\.(?P<verb>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|HandleFunc|Handle)\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?:[\w.]+\(\)\s*,\s*)*(?P<handler>[\w.]+)?"], [Convention(r"\w+Handler$", [*CODE, *CLASSES], r"handlers?/", 0.8), Convention(r"\w+Service$", CLASSES, r"services?/", 0.8), Convention(r"\w+Middleware$", CODE, r"middleware", 0.75), Convention(r"^[A-Z]\w*$", ["struct"], r"models?/", 0.7)]),
    Framework("rust-web", ["rust"], [(r"(^|/)Cargo\.toml$", "")], [r"#\[(?P<verb>get|post|put|patch|delete|head)\(\s*\"(?P<path>[^\"]*)\"[^\]]*\](?:\s*#\[[^\]]*\])*\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)", r"\.route\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?:\w+::)*(?P<verb>get|post|put|patch|delete)\((?P<handler>[\w:]+)"], [Convention(r"\w+_handler$", CODE, r"handlers?/", 0.8), Convention(r"^[A-Z]\w*Service$", CLASSES, r"services?/", 0.8), Convention(r"^[A-Z]\w*$", ["struct", "enum"], r"", 0.7)]),
    Framework("aspnet", ["csharp"], [(r"\.csproj$", r"Microsoft\.AspNetCore|Sdk\.Web"), (r"(Program|Startup)\.cs$", r"WebApplication|IApplicationBuilder")], [r"\[Http(?P<verb>Get|Post|Put|Patch|Delete)(?:\(\s*\"(?P<path>[^\"]*)\"[^)]*\))?\](?:\s*\[[^\]]*\])*\s*(?:public|private|protected|internal)\s+(?:[\w<>\[\],.? ]+?\s+)(?P<handler>\w+)\s*\(", r"\.Map(?P<verb>Get|Post|Put|Patch|Delete)\(\s*\"(?P<path>[^\"]*)\"\s*,\s*(?P<handler>[\w.]+)?"], [Convention(r"^[A-Z]\w*(Controller|Service|Repository)$", CLASSES, r"Controllers?/|Services?/|Repositor", 0.85), Convention(r"^[A-Z]\w*(Dto|DTO|Request|Response)$", CLASSES, r"Dtos?/|DTOs?/|Contracts/", 0.8), Convention(r"^[A-Z]\w*$", CLASSES, r"Models?/|Entities/", 0.7)]),
    Framework("swiftui", ["swift"], [(r"\.swift$", r"import SwiftUI")], [r"(?P<verb>)struct\s+(?P<handler>(?P<path>\w+))\s*:\s*[^{]*\bView\b"], [Convention(r"^[A-Z]\w*(View|ViewModel)$", CLASSES, r"Views?/|ViewModels?/", 0.85), Convention(r"^[A-Z]\w*Model$", CLASSES, r"Models?/", 0.7)]),
    Framework("uikit", ["swift"], [(r"\.swift$", r"import UIKit")], [r"(?P<verb>)class\s+(?P<handler>(?P<path>\w+))\s*:\s*[^{]*\bUI(?:View|Table|Collection|Navigation|Tab)\w*"], [Convention(r"^[A-Z]\w*(ViewController|Cell)$", ["class"], r"", 0.85), Convention(r"^[A-Z]\w*(View|Delegate)$", CLASSES, r"", 0.8)]),
    Framework("vapor", ["swift"], [(r"Package\.swift$", r"vapor"), (r"\.swift$", r"import Vapor")], [r"\b(?:app|routes|group|\w+)\.(?P<verb>get|post|put|patch|delete)\((?P<path>(?:\s*\"[^\"]*\"\s*,?)*)\s*(?:use:\s*(?P<handler>[\w.]+))?\)"], [Convention(r"^[A-Z]\w*Controller$", CLASSES, r"Controllers?/", 0.85), Convention(r"^[A-Z]\w*Middleware$", CLASSES, r"Middleware", 0.8), Convention(r"^[A-Z]\w*$", CLASSES, r"Models?/", 0.75)]),
]
BY_NAME = {f.name: f for f in FRAMEWORKS_TABLE}


def handler_name(text: str | None) -> str:
    """The name of the function that a route leads to."""
    if not text:
        return ""
    if m := re.search(r"['\"]([\w\\]+)[@#](\w+)['\"]|([\w/]+)#(\w+)", text):
        return m[2] or m[4]
    if m := re.match(r"\[\s*[\w\\]+::class\s*,\s*['\"](\w+)['\"]\s*\]", text):
        return m[1]
    text = re.sub(r"\.as_view\b.*$|::class$", "", re.sub(r"^include\(\s*['\"]?|['\"]?\s*\)$", "", text.strip("'\"")))
    return re.split(r"::|[.\\/]", text)[-1]


def file_route(path: str, framework: str) -> str | None:
    """The route that a page's place stands for: [x] is :x, [...x] is *x, [[x]] is :x?, (group) nothing, index the directory."""
    rules = {
        "react": r"(?:^|/)(?:(?:src/)?pages/(?!_|api/_)(?P<a>.*)\.[jt]sx?$|(?:src/)?app/(?P<b>.*?)/?(?:page|route)\.[jt]sx?$)", "svelte": r"(?:^|/)src/routes/?(?P<a>.*?)/?\+(?:page|server)(?:\.server)?\.(?:svelte|[jt]s)$",
        "vue": r"(?:^|/)(?:pages/(?P<a>.*)\.vue|server/(?P<b>(?:api|routes)/.*?)(?:\.(?:get|post|put|patch|delete))?\.[jt]s)$",
    }
    m = re.search(rules[framework], path) if framework in rules else None
    if not m:
        return None
    route = next((g for g in m.groups() if g is not None), "")
    route = re.sub(r"\((?:[^()]*)\)/?", "", route)
    route = re.sub(r"(^|/)index$", "", route)
    route = re.sub(r"\[\[(?:\.\.\.)?(\w+)\]\]", r":\1?", route)
    route = re.sub(r"\[\.\.\.(\w+)\]", r"*\1", route)
    route = re.sub(r"\[(\w+)\]", r":\1", route)
    return "/" + route.strip("/")


def extract_routes(found, source: str, only: str | None = None) -> None:
    """Adds route symbols with references to their handlers, and routes that a file's place stands for."""
    from graphloom.operators.extract import blank_comments

    top = next((n for n in found.nodes if n["kind"] == "file"), None)
    if top is None:
        return
    text = None
    for framework in FRAMEWORKS_TABLE:
        if (only and framework.name != only) or found.language not in framework.languages:
            continue
        if framework.detect and not any(re.search(p, found.path) and c and re.search(c, source) for p, c in framework.detect) and framework.name in ("flask", "fastapi", "swiftui", "uikit", "vapor"):
            continue
        for pattern in framework.routes:
            text = text if text is not None else blank_comments(source, found.language, strings=False)
            for m in re.finditer(pattern, text, re.M):
                parts = m.groupdict()
                line = text.count("\n", 0, m.start()) + 1
                verb = (parts.get("verb") or "").upper()
                path = re.sub(r"[\"\s]", "", parts.get("path") or "").replace(",", "/") if framework.name == "vapor" else parts.get("path") or ""
                kind = "component" if framework.name in ("swiftui", "uikit") else "route"
                name = path if kind == "component" else f"{verb} {path}".strip()
                own = found.node(kind, name, line, line, top, m[0].split("\n")[0][:100])
                handler = handler_name(parts.get("handler"))
                if kind == "route" and handler and handler not in ("function", "async", "func"):
                    found.ref(own, handler, "references", line)
        if framework.name in ("react", "svelte", "vue") and (route := file_route(found.path, framework.name)):
            found.node("route", route, 1, 1, top)


FRAMEWORKS = {"routes": extract_routes}


def detect_frameworks(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Names of the frameworks that some file shows: (framework)."""
    flags = []
    for f in FRAMEWORKS_TABLE:
        ok = reduce(lambda a, b: a | b, [F.col(path_col).rlike(p) & (F.col(content_col).rlike(c) if c else F.lit(True)) for p, c in f.detect])
        flags.append(F.when(F.coalesce(ok, F.lit(False)), f.name))
    return files.select(F.explode(F.array_compact(F.array(*flags))).alias("framework")).distinct()


def by_convention(refs: DataFrame, nodes: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """References whose name follows a convention of a framework of their language: (ref_id, target_id, confidence, resolved_by).

    A symbol of that very name and a fitting kind holds, preferably below the usual directories, then by id. Symbols are
    never resolved to the reference's own source.
    """
    result = None
    name: Column = F.col("reference_name")
    symbols = nodes.select("id", F.col("kind").alias("n_kind"), F.col("name").alias("n_name"), F.col("file_path").alias("n_path"))
    for framework in (BY_NAME[f] for f in frameworks):
        for order, c in enumerate(framework.conventions):
            asked = refs.filter(F.col("language").isin(list(framework.languages)) & name.rlike(c.pattern))
            rows = asked.join(symbols.filter(F.col("n_kind").isin(list(c.kinds))), name == F.col("n_name")).filter(F.col("id") != F.col("from_node_id"))
            part = rows.select("ref_id", F.col("id").alias("target_id"), F.lit(c.confidence).alias("confidence"), (~F.col("n_path").rlike(c.folders)).cast("int").alias("away"), F.lit(order).alias("o"))
            result = part if result is None else result.unionAll(part)
    if result is None:
        return refs.select("ref_id", F.lit("").alias("target_id"), F.lit(0.0).alias("confidence"), F.lit("framework").alias("resolved_by")).limit(0)
    best = W.partitionBy("ref_id").orderBy(F.desc("confidence"), "away", "o", "target_id")
    return result.withColumn("r", F.row_number().over(best)).filter("r = 1").select("ref_id", "target_id", "confidence", F.lit("framework").alias("resolved_by"))
