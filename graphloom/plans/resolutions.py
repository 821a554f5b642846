"""Queries of reference resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import resolve
from graphloom.plans import views
from graphloom.plans.views import N, sql
from graphloom.sources.tables import read

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, folder, "unresolved_refs").select(resolve.REF_COLUMNS), views.nodes(spark, folder, *resolve.COLUMNS)


_U = "u AS (SELECT ref_id, from_node_id, reference_name AS rn, reference_kind AS rk, line, file_path AS rp, language AS rl FROM unresolved_refs WHERE reference_name IS NOT NULL)"
_DIRS = "string_split({0}, '/')[:-2]"
_NEAR = f"least(15 * len(list_filter(range(1, least(len({_DIRS.format('u.rp')}), len({_DIRS.format('n.file_path')})) + 1), lambda i: {_DIRS.format('u.rp')}[1:i] = {_DIRS.format('n.file_path')}[1:i])), 80)"
_SCORE = f"""(CASE WHEN n.file_path = u.rp THEN 100 ELSE 0 END + coalesce({_NEAR}, 0) + CASE WHEN n.language IS NOT DISTINCT FROM u.rl THEN 50 ELSE -80 END
  + CASE WHEN rk = 'calls' AND kind IN ('function', 'method') THEN 25 WHEN rk = 'instantiates' AND kind IN ('class', 'struct', 'interface') THEN 25 WHEN rk = 'decorates' AND kind IN ('function', 'method') THEN 25
    WHEN rk = 'decorates' AND kind IN ('class', 'interface') THEN 15 ELSE 0 END + CASE WHEN n.is_exported THEN 10 ELSE 0 END
  + CASE WHEN n.file_path = u.rp AND n.start_line <> 0 THEN greatest(0.0, 20 - abs(n.start_line - coalesce(u.line, 0)) / 10) ELSE 0.0 END)"""


def _pick(rows: str, order: str, confidence: str, by: str) -> str:
    return f"SELECT ref_id, id AS target_id, ({confidence})::double AS confidence, {by} AS resolved_by FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY {order}) = 1"


_FILE = f"""file_path_hits AS ({_pick('''SELECT * FROM (SELECT ref_id, id, CASE WHEN qualified_name = rn OR file_path = rn THEN 1 WHEN ends_with(qualified_name, rn) OR ends_with(file_path, rn) THEN 2 WHEN count(*) OVER (PARTITION BY ref_id) = 1 THEN 3 END AS k
  FROM left0 u JOIN n ON n.kind = 'file' AND n.name = regexp_extract(rn, '[^/]*$') WHERE contains(rn, '/')) WHERE k IS NOT NULL''', 'k, id', 'CASE k WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.7 END', "'file-path'")})"""
_QUALIFIED = f"""q1 AS (SELECT ref_id, id, 0.95::double AS c FROM (SELECT ref_id, id, count(*) OVER (PARTITION BY ref_id) AS k FROM left1 u JOIN n ON n.qualified_name = rn WHERE regexp_matches(rn, '::|\\.')) WHERE k = 1),
  q2 AS (SELECT ref_id, min(id) AS id, 0.85::double AS c FROM left1 u JOIN n ON n.name = regexp_extract(rn, '[^:.]*$') AND ends_with(n.qualified_name, rn) WHERE regexp_matches(rn, '::|\\.') AND ref_id NOT IN (SELECT ref_id FROM q1) GROUP BY 1),
  qualified_hits AS (SELECT ref_id, id AS target_id, c AS confidence, 'qualified-name' AS resolved_by FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2))"""
_WORDS = "list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s._:/\\\\]+'), lambda w: len(w) > 1), lambda w: lower(w))"
_METHOD = f"""mu AS (SELECT *, regexp_extract(rn, '^(\\w+)(?:\\.|::)(\\w+)$', 1) AS obj, regexp_extract(rn, '^(\\w+)(?:\\.|::)(\\w+)$', 2) AS meth FROM left2 WHERE regexp_matches(rn, '^(\\w+)(?:\\.|::)(\\w+)$')),
  m1 AS ({_pick("SELECT u.ref_id, m.id, c.id AS cid, m.start_line AS sl FROM mu u JOIN n c ON c.name = obj AND c.kind IN ('class', 'struct', 'interface') AND c.language = rl JOIN n m ON m.kind = 'method' AND m.file_path = c.file_path AND m.name = meth AND contains(m.qualified_name, c.name)", 'cid, sl, id', '0.85', "'qualified-name'")}),
  m2 AS ({_pick("SELECT u.ref_id, m.id, c.id AS cid, m.start_line AS sl FROM mu u JOIN n c ON c.name = upper(obj[1]) || obj[2:] AND c.name <> obj AND c.kind IN ('class', 'struct', 'interface') AND c.language = rl JOIN n m ON m.kind = 'method' AND m.file_path = c.file_path AND m.name = meth AND contains(m.qualified_name, c.name) WHERE u.ref_id NOT IN (SELECT ref_id FROM m1)", 'cid, sl, id', '0.8', "'instance-method'")}),
  m3 AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS k FROM (SELECT *, max(same::int) OVER (PARTITION BY ref_id) AS anyone FROM (SELECT u.ref_id, n.id, coalesce(n.language = rl, false) AS same,
    len(list_filter({_WORDS.format('obj')}, lambda w: list_contains({_WORDS.format('n.qualified_name')}, w))) + coalesce(n.language = rl, false)::int AS sc FROM mu u JOIN n ON n.kind = 'method' AND n.name = meth WHERE u.ref_id NOT IN (SELECT ref_id FROM m1) AND u.ref_id NOT IN (SELECT ref_id FROM m2))) WHERE same OR anyone = 0),
  method_hits AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL {_pick('SELECT * FROM m3 WHERE (k = 1 AND same) OR (k > 1 AND sc >= 2)', 'sc DESC, id', 'CASE WHEN k = 1 THEN 0.7 ELSE 0.65 END', "'instance-method'")})"""
_EXACT = f"""exact_hits AS ({_pick(f"SELECT * FROM (SELECT ref_id, id, count(*) OVER (PARTITION BY ref_id) AS k, n.language IS NOT DISTINCT FROM rl AS same, coalesce({_NEAR}, 0) >= 30 AS near, {_SCORE} AS sc FROM left3 u JOIN n ON n.name = rn) WHERE k = 1 OR sc > -1", 'sc DESC, id', 'CASE WHEN k = 1 THEN CASE WHEN same THEN 0.9 ELSE 0.5 END WHEN near THEN 0.7 ELSE 0.4 END', "'exact-match'")})"""
_FUZZY = f"""fuzzy_hits AS ({_pick("SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ref_id) AS k FROM (SELECT *, max(same::int) OVER (PARTITION BY ref_id) AS anyone FROM (SELECT ref_id, id, n.language IS NOT DISTINCT FROM rl AS same FROM left4 u JOIN n ON lower(n.name) = lower(rn) AND n.kind IN ('function', 'method', 'class'))) WHERE same OR anyone = 0) WHERE k = 1", 'id', 'CASE WHEN same THEN 0.5 ELSE 0.3 END', "'fuzzy'")})"""


def _alone(level: int, tables: str, hits: str) -> str:
    return sql(f"SELECT * FROM {hits}", N, _U, recursive=f"left{level} AS (SELECT * FROM u), {tables}")


#: References that symbols themselves would be called by, as (kind of symbol, SQL of the name); no given reference has such names.
_OWN_NAMES = {
    "path": ("file", r"regexp_extract(file_path, '([^/]+/[^/]+)$', 1)"),
    "qualified": ("method", "qualified_name"),
    "call": ("method", r"regexp_extract(qualified_name, '(\w+)(::|[.])\w+$', 1) || '.' || name"),
}


def _with_own(spark: SparkSession, folder: str, form: str) -> tuple[DataFrame, DataFrame]:
    """All given references, and one more for each symbol of a kind under a name of its own."""
    refs, nodes = _inputs(spark, folder)
    kind, name = _OWN_NAMES[form]
    own = nodes.filter(F.col("kind") == kind).selectExpr("id AS ref_id", "id AS from_node_id", f"{name.replace(chr(92), chr(92) * 2)} AS reference_name", "'calls' AS reference_kind", "start_line AS line", "file_path", "language")
    return refs.withColumn("ref_id", F.col("ref_id").cast("string")).unionByName(own), nodes


def _alone_with_own(form: str, level: int, tables: str, hits: str) -> str:
    kind, name = _OWN_NAMES[form]
    u = f"""u AS (SELECT ref_id::varchar AS ref_id, from_node_id, reference_name AS rn, reference_kind AS rk, line, file_path AS rp, language AS rl FROM unresolved_refs WHERE reference_name IS NOT NULL
      UNION ALL SELECT id, id, {name}, 'calls', start_line, file_path, language FROM n WHERE kind = '{kind}' AND ({name}) IS NOT NULL)"""
    return sql(f"SELECT * FROM {hits}", N, u, recursive=f"left{level} AS (SELECT * FROM u), {tables}")


@query(_alone_with_own("path", 0, _FILE, "file_path_hits"))
def resolve_file_path(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.by_file_path(*_with_own(spark, folder, "path"))


@query(_alone_with_own("qualified", 1, _QUALIFIED, "qualified_hits"))
def resolve_qualified(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.by_qualified_name(*_with_own(spark, folder, "qualified"))


@query(_alone_with_own("call", 2, _METHOD, "method_hits"))
def resolve_method(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.by_method_call(*_with_own(spark, folder, "call"))


@query(_alone(3, _EXACT, "exact_hits"))
def resolve_exact(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.by_exact_name(*_inputs(spark, folder))


@query(_alone(4, _FUZZY, "fuzzy_hits"))
def resolve_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.by_near_name(*_inputs(spark, folder))


def _names(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_HEAD = "CASE WHEN strpos(rn, '.') > 1 THEN string_split(rn, '.')[1] ELSE '' END"
_TAIL = "CASE WHEN strpos(rn, '.') > 1 THEN substr(rn, strpos(rn, '.') + 1) ELSE '' END"
_BUILTIN = f"""coalesce((rl IN ('typescript', 'javascript', 'tsx', 'jsx') AND (rn IN {_names(resolve.JS_NAMES + resolve.JS_HOOKS)} OR regexp_matches(rn, '^(console|Math|JSON)\\.')))
  OR (rl = 'python' AND (rn IN {_names(resolve.PYTHON_NAMES + resolve.PYTHON_METHODS)} OR {_HEAD} IN {_names(resolve.PYTHON_TYPES)} OR ({_TAIL} IN {_names(resolve.PYTHON_METHODS)} AND upper(({_HEAD})[1]) || ({_HEAD})[2:] NOT IN (SELECT name FROM n WHERE name IS NOT NULL))))
  OR (rl = 'go' AND ({_HEAD} IN {_names(resolve.GO_PACKAGES)} OR rn IN {_names(resolve.GO_NAMES)}))
  OR (rl = 'pascal' AND ({' OR '.join(f"starts_with(rn, '{p}')" for p in resolve.PASCAL_PREFIXES)} OR rn IN {_names(resolve.PASCAL_NAMES)})), false)"""
_GATE = f"""probe AS (SELECT ref_id, unnest([rn, {_HEAD}, {_TAIL}, upper(({_HEAD})[1]) || ({_HEAD})[2:], CASE WHEN strpos(rn, '::') > 1 THEN string_split(rn, '::')[1] END, CASE WHEN strpos(rn, '::') > 1 THEN substr(rn, strpos(rn, '::') + 2) END,
  CASE WHEN strpos(rn, '/') > 1 THEN regexp_extract(rn, '[^/]*$') END]) AS p FROM u WHERE NOT {_BUILTIN}),
  left0 AS (SELECT * FROM u WHERE ref_id IN (SELECT ref_id FROM probe WHERE p <> '' AND p IN (SELECT name FROM n)))"""
_STAGES = f"""{_GATE}, {_FILE}, left1 AS (SELECT * FROM left0 WHERE ref_id NOT IN (SELECT ref_id FROM file_path_hits)), {_QUALIFIED}, left2 AS (SELECT * FROM left1 WHERE ref_id NOT IN (SELECT ref_id FROM qualified_hits)), {_METHOD},
  left3 AS (SELECT * FROM left2 WHERE ref_id NOT IN (SELECT ref_id FROM method_hits)), {_EXACT}, left4 AS (SELECT * FROM left3 WHERE ref_id NOT IN (SELECT ref_id FROM exact_hits)), {_FUZZY},
  hits AS (SELECT * FROM file_path_hits UNION ALL SELECT * FROM qualified_hits UNION ALL SELECT * FROM method_hits UNION ALL SELECT * FROM exact_hits UNION ALL SELECT * FROM fuzzy_hits)"""


@query(sql("SELECT * FROM hits", N, _U, recursive=_STAGES))
def resolve_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.resolve(*_inputs(spark, folder))


@query(sql("SELECT resolved_by, confidence, count(*) AS refs FROM hits GROUP BY 1, 2", N, _U, recursive=_STAGES))
def resolution_counts(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.resolve(*_inputs(spark, folder)).groupBy("resolved_by", "confidence").agg(F.count("*").alias("refs"))


@query(
    sql(
        """SELECT h.ref_id, u.from_node_id AS source, h.target_id AS target, CASE WHEN rk = 'extends' AND t.kind IN ('interface', 'protocol') AND s.kind NOT IN ('interface', 'protocol') THEN 'implements'
        WHEN rk = 'calls' AND t.kind IN ('class', 'struct') THEN 'instantiates' ELSE rk END AS kind FROM hits h JOIN u USING (ref_id) LEFT JOIN n t ON t.id = h.target_id LEFT JOIN n s ON s.id = u.from_node_id""",
        N, _U, recursive=_STAGES,
    )
)
def edge_promotion(spark: SparkSession, folder: str) -> DataFrame:
    refs, nodes = _inputs(spark, folder)
    return resolve.resolved_edges(refs, resolve.resolve(refs, nodes), nodes).select("ref_id", "source", "target", "kind")
