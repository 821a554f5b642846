"""Resolution of textual references to symbols, set at a time.

Each strategy is a join that yields (ref_id, target_id, confidence, resolved_by), at most one row a reference; the
cascade runs them in stages and takes resolved references out before the next. Equally good symbols are told apart by
id. Inputs are references (ref_id, from_node_id, reference_name, reference_kind, line, file_path, language) and clean
symbols with COLUMNS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.session import cut_lineage

COLUMNS = ["kind", "name", "qualified_name", "file_path", "language", "start_line", "is_exported"]
REF_COLUMNS = ["ref_id", "from_node_id", "reference_name", "reference_kind", "line", "file_path", "language"]
CLASS_LIKE, CALLABLE = ["class", "struct", "interface"], ["function", "method"]

#: Names that belong to a language or its standard library, by language.
JS_NAMES = "console window document global process Promise Array Object String Number Boolean Date Math JSON RegExp Error Map Set setTimeout setInterval clearTimeout clearInterval fetch require module exports __dirname __filename".split()
JS_HOOKS = "useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect useImperativeHandle useDebugValue".split()
PYTHON_NAMES = "print len range str int float list dict set tuple open input type isinstance hasattr getattr setattr super self cls None True False".split()
PYTHON_TYPES = "list dict set tuple str int float bool bytes bytearray frozenset object super".split()
PYTHON_METHODS = (
    "append extend insert remove pop clear sort reverse copy update keys values items get add discard union intersection difference split join strip lstrip rstrip replace lower upper startswith endswith find index count encode decode "
    "format isdigit isalpha isalnum read write readline readlines close flush seek"
).split()
GO_PACKAGES = (
    "fmt os io net http log math sort sync time path bytes strings strconv errors context json xml csv html template regexp reflect runtime testing flag bufio crypto encoding filepath hash mime rand signal sql syscall unicode unsafe "
    "atomic binary debug exec heap ring scanner tar zip gzip zlib tls url user pprof trace ast build parser printer token types cgo plugin race ioutil utilruntime utilwait utilnet"
).split()
GO_NAMES = (
    "make new len cap append copy delete close panic recover print println complex real imag error nil true false iota int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune any"
).split()
PASCAL_PREFIXES = "System. Winapi. Vcl. Fmx. Data. Datasnap. Soap. Xml. Web. REST. FireDAC. IBX. IdHTTP IdTCP IdSSL".split()
PASCAL_NAMES = (
    "System SysUtils Classes Types Variants StrUtils Math DateUtils IOUtils Generics.Collections Generics.Defaults Rtti TypInfo SyncObjs RegularExpressions SysInit Windows Messages Graphics Controls Forms Dialogs StdCtrls ExtCtrls ComCtrls "
    "Menus ActnList WriteLn Write ReadLn Read Inc Dec Ord Chr Length SetLength High Low Assigned FreeAndNil Format IntToStr StrToInt FloatToStr StrToFloat Trim UpperCase LowerCase Pos Copy Delete Insert Now Date Time DateToStr StrToDate "
    "Raise Exit Break Continue Abort True False nil Self Result Create Destroy Free TObject TComponent TPersistent TInterfacedObject TList TStringList TStrings TStream TMemoryStream TFileStream Exception EAbort EConvertError EAccessViolation "
    "IInterface IUnknown"
).split()


def _head(name: Column) -> Column:
    """The part before the first dot, empty without one."""
    return F.when(F.instr(name, ".") > 1, F.substring_index(name, ".", 1)).otherwise("")


def _tail(name: Column) -> Column:
    """All after the first dot, empty without one."""
    return F.when(F.instr(name, ".") > 1, F.substring(name, F.instr(name, ".") + 1, F.length(name))).otherwise("")


def without_builtins(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References that do not name a built-in or a standard library; a Python method of a known class stays."""
    name, language = F.col("reference_name"), F.col("language")
    known = nodes.select(F.col("name").alias("__known")).distinct()
    rows = refs.withColumn("__class", fx.capitalized(_head(name))).join(known, F.col("__class") == F.col("__known"), "left")
    js = language.isin("typescript", "javascript", "tsx", "jsx") & (name.isin(JS_NAMES + JS_HOOKS) | name.rlike(r"^(console|Math|JSON)\."))
    python = (language == "python") & (name.isin(PYTHON_NAMES + PYTHON_METHODS) | _head(name).isin(PYTHON_TYPES) | (_tail(name).isin(PYTHON_METHODS) & F.col("__known").isNull()))
    go = (language == "go") & (_head(name).isin(GO_PACKAGES) | name.isin(GO_NAMES))
    pascal = (language == "pascal") & (reduce(lambda a, b: a | b, [name.startswith(p) for p in PASCAL_PREFIXES]) | name.isin(PASCAL_NAMES))
    return rows.filter(~F.coalesce(js | python | go | pascal, F.lit(False))).select(refs.columns)


def with_possible_match(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References of which the name, a side of its first dot or ::, its receiver as a class, or its file name exists."""
    name = F.col("reference_name")
    colon = F.instr(name, "::")
    probes = F.array(name, _head(name), _tail(name), fx.capitalized(_head(name)), F.when(colon > 1, F.substring_index(name, "::", 1)), F.when(colon > 1, F.substring(name, colon + 2, F.length(name))), F.when(F.instr(name, "/") > 1, F.substring_index(name, "/", -1)))
    asked = refs.select("ref_id", F.explode(F.array_distinct(probes)).alias("name")).filter("name <> ''")
    possible = asked.join(nodes.select("name").distinct(), "name", "left_semi").select("ref_id").distinct()
    return refs.join(possible, "ref_id", "left_semi")


def _result(rows: DataFrame, order: list[Column], confidence: Column, by: Column) -> DataFrame:
    """The first row of each reference."""
    first = rows.withColumn("__r", F.row_number().over(W.partitionBy("ref_id").orderBy(*order))).filter("__r = 1")
    return first.select("ref_id", F.col("id").alias("target_id"), confidence.cast("double").alias("confidence"), by.alias("resolved_by"))


def _symbols(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("kind").alias("n_kind"), F.col("name").alias("n_name"), F.col("qualified_name").alias("n_qualified"), F.col("file_path").alias("n_path"), F.col("language").alias("n_language"), F.col("start_line").alias("n_line"), F.col("is_exported").alias("n_exported"))


def by_file_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names with a slash against file symbols of that base name: equal path 0.95, path end 0.85, the only one 0.7."""
    every = refs.filter(F.col("reference_name").contains("/")).select("ref_id", "reference_name")
    asked = every.select("reference_name").distinct().withColumn("__base", F.substring_index("reference_name", "/", -1)).filter("__base <> ''")
    rows = asked.join(_symbols(nodes).filter("n_kind = 'file'"), F.col("__base") == F.col("n_name"))
    name = F.col("reference_name")
    rank = F.when((F.col("n_qualified") == name) | (F.col("n_path") == name), 1).when(F.col("n_qualified").endswith(name) | F.col("n_path").endswith(name), 2).otherwise(3)
    best = rows.groupBy("reference_name").agg(F.min(F.struct(rank.alias("rank"), "id")).alias("b"), F.count("*").alias("n")).filter("b.rank < 3 OR n = 1")
    confidence = F.when(F.col("b.rank") == 1, 0.95).when(F.col("b.rank") == 2, 0.85).otherwise(0.7)
    return every.join(best, "reference_name").select("ref_id", F.col("b.id").alias("target_id"), confidence.alias("confidence"), F.lit("file-path").alias("resolved_by"))


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names with a dot or ::. One symbol of that qualified name 0.95; else one of its last part whose qualified name ends with it 0.85."""
    asked = refs.filter(F.col("reference_name").rlike(r"::|\."))
    names = asked.select("reference_name").distinct()
    whole = nodes.groupBy(F.col("qualified_name").alias("reference_name")).agg(F.min("id").alias("target_id"), F.count("*").alias("n")).filter("n = 1").join(names, "reference_name", "left_semi").select("reference_name", "target_id", F.lit(0.95).alias("confidence"))
    last = names.join(whole, "reference_name", "left_anti").withColumn("__last", F.regexp_extract("reference_name", r"([^:.]*)$", 1)).filter("__last <> ''")
    ends = last.join(_symbols(nodes), F.col("__last") == F.col("n_name")).filter(F.col("n_qualified").endswith(F.col("reference_name")))
    found = whole.unionAll(ends.groupBy("reference_name").agg(F.min("id").alias("target_id")).withColumn("confidence", F.lit(0.85)))
    return asked.join(found, "reference_name").select("ref_id", "target_id", "confidence", F.lit("qualified-name").alias("resolved_by"))


def by_method_call(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """receiver.method: a class of that name with the method in its file 0.85; with a capital 0.8; else by the methods of that name.

    The only method, in the reference's language, 0.7; of several the one whose qualified name shares most words with the
    receiver, a point more for the same language and two at least, 0.65. Methods of the same language come before others.
    Everything depends on name and language alone, so each such pair is resolved once.
    """
    pattern = r"^(\w+)(?:\.|::)(\w+)$"
    every = refs.filter(F.col("reference_name").rlike(pattern)).select(F.col("ref_id").alias("__ref"), "reference_name", "language")
    asked = every.select("reference_name", "language").distinct().withColumn("ref_id", F.struct("reference_name", "language")).withColumn("__object", F.regexp_extract("reference_name", pattern, 1)).withColumn("__method", F.regexp_extract("reference_name", pattern, 2))
    symbols = _symbols(nodes)
    classes = symbols.filter(F.col("n_kind").isin(CLASS_LIKE)).select(F.col("id").alias("c_id"), F.col("n_name").alias("c_name"), F.col("n_path").alias("c_path"), F.col("n_language").alias("c_language"))
    methods = symbols.filter("n_kind = 'method'")

    def in_class(rows: DataFrame, receiver: Column, confidence: float, by: str) -> DataFrame:
        owned = rows.withColumn("__receiver", receiver).join(classes, (F.col("__receiver") == F.col("c_name")) & (F.col("language") == F.col("c_language")))
        found = owned.join(methods, (F.col("c_path") == F.col("n_path")) & (F.col("__method") == F.col("n_name"))).filter(F.col("n_qualified").contains(F.col("c_name")))
        return _result(found, [F.col("c_id"), F.col("n_line"), F.col("id")], F.lit(confidence), F.lit(by))

    direct = in_class(asked, F.col("__object"), 0.85, "qualified-name")
    rest = asked.join(direct, "ref_id", "left_anti")
    capital = in_class(rest.filter(fx.capitalized(F.col("__object")) != F.col("__object")), fx.capitalized(F.col("__object")), 0.8, "instance-method")
    rest = rest.join(capital, "ref_id", "left_anti")
    rows = rest.join(methods, F.col("__method") == F.col("n_name")).withColumn("__same", F.coalesce(F.col("n_language") == F.col("language"), F.lit(False)))
    each = W.partitionBy("ref_id")
    rows = rows.withColumn("__any", F.max("__same").over(each)).filter("__same OR NOT __any").withColumn("__n", F.count("*").over(each))
    words = lambda c: F.transform(fx.camel_words(c), lambda w: F.lower(w))
    own = words(F.col("n_qualified"))
    shared = F.size(F.filter(words(F.col("__object")), lambda w: F.array_contains(own, w)))
    rows = rows.withColumn("__score", shared + F.col("__same").cast("int"))
    rows = rows.filter("(__n = 1 AND __same) OR (__n > 1 AND __score >= 2)")
    named = _result(rows, [F.desc("__score"), F.col("id")], F.when(F.col("__n") == 1, 0.7).otherwise(0.65), F.lit("instance-method"))
    found = direct.unionAll(capital).unionAll(named)
    same = (every["reference_name"] == F.col("ref_id.reference_name")) & every["language"].eqNullSafe(F.col("ref_id.language"))
    return every.join(found, same).select(F.col("__ref").alias("ref_id"), "target_id", "confidence", "resolved_by")


#: Leading directories that count for nearness: more give no more points.
NEAR_LEVELS = 6


def _prefix(path: Column, level: Column) -> Column:
    """The first directories of a path, null where it has not so many."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > level, F.array_join(F.slice(parts, 1, level), "/"))


def _fit(wanted: Column, kind: Column) -> Column:
    return F.when((wanted == "calls") & kind.isin(CALLABLE), 25).when((wanted == "instantiates") & kind.isin(CLASS_LIKE), 25).when((wanted == "decorates") & kind.isin(CALLABLE), 25).when((wanted == "decorates") & kind.isin("class", "interface"), 15).otherwise(0)


def by_exact_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols of the same name: the only one 0.9, or 0.5 in another language; of several the best by points, 0.7 within two shared directories, else 0.4.

    Points are 15 a shared leading directory (80 at most), 50 for the language or else -80, 25 or 15 for a fitting kind, 10
    for an export, and 100 for the file with up to 20 more the nearer the line; the best must have more than -1.

    References never meet all symbols of their name: symbols are first reduced to one for each name, leading directories,
    language, kind and export, and a reference meets the few of its own directories at each level. Only symbols of the
    reference's own file are compared one by one.
    """
    symbols = _symbols(nodes).filter("n_name IS NOT NULL").withColumn("n_exported", F.coalesce("n_exported", F.lit(False)))
    counts = symbols.groupBy(F.col("n_name").alias("reference_name")).agg(F.count("*").alias("n"), F.min("id").alias("only_id"), F.min("n_language").alias("only_language"))
    asked = refs.join(counts, "reference_name")
    language = F.col("language")
    single = asked.filter("n = 1").select("ref_id", F.col("only_id").alias("target_id"), F.when(F.col("only_language").eqNullSafe(language), 0.9).otherwise(0.5).alias("confidence"))

    several = asked.filter("n > 1")
    levels = F.explode(F.sequence(F.lit(0), F.lit(NEAR_LEVELS)))
    group = ["n_name", "level", "prefix", "n_language", "n_kind", "n_exported"]
    near = symbols.withColumn("level", levels).withColumn("prefix", F.when(F.col("level") == 0, "").otherwise(_prefix(F.col("n_path"), F.col("level")))).filter("prefix IS NOT NULL").groupBy(*group).agg(F.min("id").alias("id"))
    spread = several.withColumn("own_level", levels).withColumn("own_prefix", F.when(F.col("own_level") == 0, "").otherwise(_prefix(F.col("file_path"), F.col("own_level")))).filter("own_prefix IS NOT NULL")
    kin = spread.join(near, (F.col("reference_name") == F.col("n_name")) & (F.col("own_level") == F.col("level")) & (F.col("own_prefix") == F.col("prefix")))
    base = F.when(F.col("n_language").eqNullSafe(language), 50).otherwise(-80) + _fit(F.col("reference_kind"), F.col("n_kind")) + F.when(F.col("n_exported"), 10).otherwise(0)
    shared = F.least(F.col("level") * 15, F.lit(80))
    away = kin.select("ref_id", "id", (base + shared).cast("double").alias("score"), shared.alias("shared"))

    inside = several.join(symbols, (F.col("reference_name") == F.col("n_name")) & (F.col("file_path") == F.col("n_path")))
    line = F.when(F.coalesce(F.col("n_line") != 0, F.lit(False)), F.greatest(F.lit(0.0), 20 - F.abs(F.col("n_line") - F.coalesce("line", F.lit(0))) / 10)).otherwise(0.0)
    here_shared = fx.path_proximity(F.col("file_path"), F.col("n_path"))
    here = inside.select("ref_id", "id", (base + here_shared + 100 + line).cast("double").alias("score"), here_shared.alias("shared"))

    best = away.unionAll(here).filter("score > -1").groupBy("ref_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "id", "shared")).alias("b"))
    many = best.select("ref_id", F.col("b.id").alias("target_id"), F.when(F.col("b.shared") >= 30, 0.7).otherwise(0.4).alias("confidence"))
    return single.unionAll(many).select("ref_id", "target_id", "confidence", F.lit("exact-match").alias("resolved_by"))


def by_near_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The only function, method or class of the name without case, in the language 0.5, or else in any other 0.3.

    Symbols are counted by name and language first, so a reference meets two counts and no symbols.
    """
    symbols = nodes.filter(F.col("kind").isin("function", "method", "class")).select("id", F.lower("name").alias("low"), F.col("language").alias("n_language"))
    by_language = symbols.groupBy("low", "n_language").agg(F.count("*").alias("same"), F.min("id").alias("same_id"))
    by_name = by_language.groupBy(F.col("low").alias("any_low")).agg(F.sum("same").alias("n"), F.min("same_id").alias("any_id"))
    rows = refs.select("ref_id", F.lower("reference_name").alias("asked"), "language").join(by_name, F.col("asked") == F.col("any_low"))
    rows = rows.join(by_language, (F.col("asked") == F.col("low")) & F.col("language").eqNullSafe(F.col("n_language")), "left")
    found = rows.filter("same = 1 OR (same IS NULL AND n = 1)")
    return found.select("ref_id", F.coalesce("same_id", "any_id").alias("target_id"), F.when(F.col("same").isNotNull(), 0.5).otherwise(0.3).alias("confidence"), F.lit("fuzzy").alias("resolved_by"))


STRATEGIES = [by_file_path, by_qualified_name, by_method_call, by_exact_name, by_near_name]


def resolve(refs: DataFrame, nodes: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """The cascade: (ref_id, target_id, confidence, resolved_by), one row for each resolved reference.

    Built-ins and names that nothing could match go first. Candidates of earlier stages (frameworks, imports) at 0.9 or
    more end the search; below, the surer of them and of the first strategy that finds a symbol holds, the earlier on
    ties. Null names resolve to nothing; repeated references resolve each; empty tables give no rows.
    """
    nodes = cut_lineage(nodes.select("id", *COLUMNS))  # every strategy reads it
    left = with_possible_match(without_builtins(refs.filter("reference_name IS NOT NULL").select(REF_COLUMNS), nodes), nodes)
    if earlier is not None:
        earlier = earlier.withColumn("__r", F.row_number().over(W.partitionBy("ref_id").orderBy(F.desc("confidence"), "resolved_by", "target_id"))).filter("__r = 1").drop("__r")
        left = left.join(earlier.filter("confidence >= 0.9"), "ref_id", "left_anti")
    left, found = cut_lineage(left), None
    for strategy in STRATEGIES:
        part = cut_lineage(strategy(left, nodes))
        found = part if found is None else found.unionAll(part)
        left = left.join(part, "ref_id", "left_anti")
    if earlier is None:
        return found
    both = earlier.withColumn("__o", F.lit(0)).unionAll(found.withColumn("__o", F.lit(1)))
    order = W.partitionBy("ref_id").orderBy(F.desc("confidence"), "__o")
    return both.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__o", "__r")


def resolved_edges(refs: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of resolved references: (ref_id, source, target, kind, line, metadata).

    extends becomes implements where a class-like symbol extends an interface or protocol; calls becomes instantiates
    where the target is a class or struct.
    """
    kinds = nodes.select("id", "kind")
    rows = refs.join(resolved, "ref_id").join(kinds.select(F.col("id").alias("target_id"), F.col("kind").alias("t_kind")), "target_id", "left").join(kinds.select(F.col("id").alias("from_node_id"), F.col("kind").alias("s_kind")), "from_node_id", "left")
    abstract = ["interface", "protocol"]
    kind = F.when((F.col("reference_kind") == "extends") & F.col("t_kind").isin(abstract) & ~F.coalesce(F.col("s_kind").isin(abstract), F.lit(True)), "implements").when((F.col("reference_kind") == "calls") & F.col("t_kind").isin("class", "struct"), "instantiates").otherwise(F.col("reference_kind"))
    return rows.select("ref_id", F.col("from_node_id").alias("source"), F.col("target_id").alias("target"), kind.alias("kind"), "line", F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("resolvedBy"), F.col("resolved_by")).alias("metadata"))


def by_import(refs: DataFrame, mappings: DataFrame, nodes: DataFrame, exports: DataFrame | None = None, depth: int = 9) -> DataFrame:
    """References whose first name part is imported: (ref_id, target_id, 0.9, import).

    mappings is (file_path, local_name, module_path, export_name) with module_path already a file; exports is re-exports
    (file_path, export_name or *, module_path, source_name) and is followed for at most depth files, each once. The
    symbol is the exported one of that name in the file reached; a dotted rest names a symbol in the same file.
    """
    head = F.substring_index(F.substring_index("reference_name", ".", 1), "::", 1)
    asked = refs.withColumn("local_name", head).join(mappings, ["file_path", "local_name"]).select("ref_id", "reference_name", F.col("module_path").alias("at"), F.col("export_name").alias("want"))
    asked = asked.withColumn("rest", F.regexp_extract("reference_name", r"(?:\.|::)(\w+)$", 1))
    symbols = nodes.filter("is_exported").select("id", F.col("file_path").alias("at"), F.col("name").alias("want"))
    found, level = None, asked.withColumn("seen", F.array("at"))
    for _ in range(depth):
        hit = level.join(symbols, ["at", "want"]).groupBy("ref_id").agg(F.min("id").alias("target_id"))
        found = hit if found is None else found.unionAll(hit.join(found, "ref_id", "left_anti"))
        found = cut_lineage(found)
        if exports is None:
            break
        left = level.join(found, "ref_id", "left_anti")
        step = exports.select(F.col("file_path").alias("at"), F.col("export_name").alias("e_name"), F.col("module_path").alias("next"), F.col("source_name").alias("e_source"))
        level = left.join(step, "at").filter("e_name = want OR e_name = '*'").filter(~F.array_contains("seen", F.col("next")))
        level = cut_lineage(level.select("ref_id", "reference_name", F.col("next").alias("at"), F.when(F.col("e_name") == "*", F.col("want")).otherwise(F.col("e_source")).alias("want"), "rest", F.array_append("seen", F.col("next")).alias("seen")))
        if level.isEmpty():
            break
    return found.select("ref_id", "target_id", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))
