"""Generated, minified or vendored source files (problem 4): belief propagation over the directory tree.

Every file and every directory has a hidden label, and the tree is a Markov random field: the name of a node and the
size of a file against its number of symbols are evidence about that node alone, and POTENTIAL tells how well a label
goes with the label of the directory above. No evidence is beyond doubt and no path is matched as a whole: a directory
named `vendor` may start a vendored tree under any other, what lies below is vendored because its label has to agree with
those above it, and a file without any mark goes with its siblings once nearly all of them are marked. Messages go up from files to the root, level by level,
as sums that tasks pre-aggregate, and come back down; with that each marginal holds the node's own evidence, its
parents and its siblings. The tree has no loops, so the marginals are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.model import newest
from graphloom.session import cut_lineage

#: Labels in the result, of HAND to OUTPUT: generated files mostly carry a mark, tool output below a named directory mostly none.
LABELS = ["handwritten", "generated", "minified", "vendored", "blob", "generated"]
HAND, MARKED, MINIFIED, VENDORED, BLOB, OUTPUT = range(6)
#: Directory names that follow a custom; without case, but for the last pattern of each.
GENERATED_DIR = r"(?i:generated|__generated__|generated[-_](?:sources?|src|protos?|code|files)|gen[-_]src|auto[-_]?gen(?:erated)?|codegen[-_]output|dist|\.dart_tool|\.next|\.nuxt|__pycache__|target/(?:debug|release|classes)|(?:obj|bin)/(?:debug|release))"
VENDORED_DIR = r"(?i:vendor|vendored|(?:third|3rd)[-_]?part(?:y|ies)|node_modules|bower_components|jspm_packages|web_modules|site-packages|dist-packages|godeps|carthage/(?:checkouts|build))|Pods"
#: File names that follow a custom.
GENERATED_FILE = (
    r"(?:^|/)(?:(?:moc|qrc|ui)_[^/]+\.(?:cpp|cc|cxx|c|h|hpp)|lex\.[^/]+\.(?:c|cc|cpp)|[^/]+\.tab\.(?:c|h|cc|cpp|hpp)|zz_generated\.[^/]+|[^/]+_pb2(?:_grpc)?\.pyi?|[^/]+(?:Grpc|OuterClass)\.java|"
    r"[^/]+\.(?:pb|grpc)(?:\.gw)?\.[A-Za-z]+|[^/]+[._-](?i:gen|generated|autogen|auto)\.[A-Za-z]+|[^/]+\.(?:g|freezed|gr|mocks)\.[A-Za-z]+|[^/]+\.(?i:designer)\.[A-Za-z]+)$"
)
MINIFIED_FILE = r"(?:^|/)[^/]+(?:[._-](?i:min)|\.(?i:packed|bundle|chunk)|\.[0-9a-f]{8,})\.(?:js|mjs|cjs|jsx|ts|css)$"
#: A file counts as large above so many bytes.
LARGE_BYTES = 50_000
#: Bytes a symbol of a large file: usual below the first, a blob above the second, in doubt between.
DOUBT_RATIO, SURE_RATIO = 2_000.0, 8_000.0
#: Log odds of a directory name, a file name and a size that speak for a label; a mark that is absent counts against it alike.
DIR_NAME, FILE_NAME, SIZE = 10.0, 8.0, 8.0

#: How well a file of a label (column) goes with the label of its directory (row). A directory of MARKED or MINIFIED
#: files is one where they are the rule: each marked file speaks for it by 1 / 0.4, each other one against it by 0.024.
#: HAND, VENDORED and OUTPUT have equal sums over HAND, VENDORED and OUTPUT and are equal elsewhere, so that content, of
#: whatever number, leaves the choice among them to the names of directories and to what is above.
POTENTIAL = [
    [1.0, 0.4, 0.4, 0.01, 0.2, 0.005],
    [0.004, 1.0, 0.4, 0.002, 0.1, 0.018],
    [0.004, 0.4, 1.0, 0.002, 0.1, 0.018],
    [0.005, 0.4, 0.4, 1.0, 0.2, 0.01],
    [0.05, 0.2, 0.2, 0.01, 1.0, 0.01],
    [0.005, 0.4, 0.4, 0.01, 0.2, 1.0],
]
#: The same for a directory and the one above it.
NESTED = [
    [1.0, 0.02, 0.02, 0.003, 0.02, 0.003],
    [0.05, 1.0, 0.05, 0.003, 0.02, 0.003],
    [0.05, 0.05, 1.0, 0.003, 0.02, 0.003],
    [0.003, 0.02, 0.02, 1.0, 0.02, 0.003],
    [0.05, 0.02, 0.02, 0.003, 1.0, 0.003],
    [0.003, 0.02, 0.02, 0.003, 0.02, 1.0],
]
#: Files of one directory beyond which the join that brings its message back to them is salted.
HOT_FILES = 200_000
COLUMNS, TOLD, EVIDENCE = ([f"{c}{k}" for k in range(len(LABELS))] for c in "mte")


def _pass(df: DataFrame, fit: list[list[float]], up: bool, values: list[str], out: list[str], starts: list[int] = ()) -> DataFrame:
    """df with columns out, the message of log values through an edge: up from content to directory, or down.

    starts has the labels k for which a column s<k> tells that the content's name starts a tree of that label: there it goes
    with any directory.
    """
    df = df.withColumn("__top", F.greatest(*values))
    df = df.withColumns({f"__w{k}": F.exp(F.col(v) - F.col("__top")) for k, v in enumerate(values)})
    many = range(len(values))

    def weighed(own: int, other: int) -> Column:
        above, below = (own, other) if up else (other, own)
        weight = F.lit(fit[above][below])
        return F.col(f"__w{other}") * (F.when(F.col(f"s{below}"), 1.0).otherwise(weight) if below in starts else weight)

    sums = {name: F.col("__top") + F.log(sum((weighed(a, b) for b in many[1:]), weighed(a, 0))) for a, name in enumerate(out)}
    return df.withColumns(sums).drop("__top", *[f"__w{k}" for k in many])


def _file_evidence(path: Column, size: Column, count: Column, large_bytes: int) -> list[Column]:
    """Log likelihood of a file's name and size under each label, against handwritten."""
    generated, minified = path.rlike(GENERATED_FILE), path.rlike(MINIFIED_FILE)
    ratio = size / F.greatest(count, F.lit(1))
    width = math.log(SURE_RATIO / DOUBT_RATIO)
    grade = (F.log(F.greatest(ratio, F.lit(1e-3))) - math.log(math.sqrt(SURE_RATIO * DOUBT_RATIO))) / width * 2 * SIZE
    blob = F.when(size.isNull() | count.isNull(), 0.0).when(size <= large_bytes, -SIZE).otherwise(F.greatest(F.lit(-SIZE), F.least(F.lit(SIZE), grade)))
    mark = lambda there: F.when(there, FILE_NAME).otherwise(-FILE_NAME)
    return [F.lit(0.0), mark(generated), mark(minified & ~generated), F.lit(0.0), blob, F.lit(0.0)]


def label_files(files: DataFrame, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """Label of every path, by its newest row: (path, label string, p_handwritten double, handwritten boolean).

    The newest row is the one of the largest indexed_at. label is the most probable of handwritten, generated, minified,
    vendored and blob; size is evidence for files above large_bytes only. A null size or node_count says nothing; rows
    with a null path do not count; repeated rows and ties are allowed; an empty table gives no rows; further columns are
    not read.

    One shuffle by path; then the tree shrinks to directories, whose messages are summed with pre-aggregation level by
    level (as many levels as the deepest path has). Files meet their directory's message in one join, which is salted
    where a directory holds more than HOT_FILES of them, so no directory is gathered into one task.
    """
    rows = newest(files, "path", "indexed_at", ["size", "node_count"])
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    evidence = _file_evidence(F.col("path"), F.col("size").cast("double"), F.col("node_count").cast("double"), large_bytes)
    leaves = rows.select("path", folder.alias("dir"), *[e.cast("double").alias(name) for e, name in zip(evidence, EVIDENCE)])
    leaves = cut_lineage(_pass(leaves, POTENTIAL, True, EVIDENCE, TOLD))

    sums = [F.sum(t).alias(m) for t, m in zip(TOLD, COLUMNS)]
    depth_of = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    waiting = cut_lineage(leaves.groupBy("dir").agg(F.count("*").alias("files"), *sums).withColumn("depth", depth_of))
    deepest, most = waiting.agg(F.max("depth"), F.max("files")).first()

    parent = F.regexp_extract("dir", r"^(.*)/[^/]*$", 1)
    last = F.regexp_extract("dir", r"((?:[^/]*/)?[^/]*)$", 1)  # a custom may take two names
    vendored, output = (last.rlike(rf"(?:^|/)(?:{pattern})$") for pattern in (VENDORED_DIR, GENERATED_DIR))
    starts = {VENDORED: vendored, OUTPUT: output & ~vendored}
    named = {COLUMNS[k]: F.when(there, DIR_NAME).otherwise(0.0) for k, there in starts.items()}
    levels: list[DataFrame] = []
    arriving: DataFrame | None = None
    for depth in range(deepest or 0, -1, -1):
        here = waiting.filter(F.col("depth") == depth).select("dir", *COLUMNS)
        if arriving is not None:
            here = here.unionAll(arriving).groupBy("dir").agg(*[F.sum(m).alias(m) for m in COLUMNS])
        belief = here.withColumns({m: F.col(m) + own for m, own in named.items()} | {"parent": parent} | {f"s{k}": there for k, there in starts.items()})
        levels.append(cut_lineage(_pass(belief, NESTED, True, COLUMNS, TOLD, list(starts))))
        arriving = levels[-1].select(F.col("parent").alias("dir"), *TOLD).groupBy("dir").agg(*sums)

    prior = [math.log(p) for p in NESTED[HAND]]
    beliefs = upper = levels[-1].select("dir", *[(F.col(m) + p).alias(m) for m, p in zip(COLUMNS, prior)])
    for belief in reversed(levels[:-1]):
        over = upper.select(F.col("dir").alias("parent"), *[F.col(m).alias(f"p_{m}") for m in COLUMNS])
        rest = belief.join(over, "parent").withColumns({f"p_{m}": F.col(f"p_{m}") - F.col(t) for m, t in zip(COLUMNS, TOLD)})  # without what it told itself
        down = _pass(rest, NESTED, False, [f"p_{m}" for m in COLUMNS], [f"d_{m}" for m in COLUMNS], list(starts))
        upper = cut_lineage(down.select("dir", *[(F.col(m) + F.col(f"d_{m}")).alias(m) for m in COLUMNS]))
        beliefs = beliefs.unionAll(upper)

    keys, salts = ["dir"], -(-(most or 0) // HOT_FILES)
    if salts > 1:
        keys = ["dir", "salt"]
        leaves = leaves.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
        beliefs = beliefs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))))
    rest = leaves.join(beliefs, keys).withColumns({m: F.col(m) - F.col(t) for m, t in zip(COLUMNS, TOLD)})
    down = _pass(rest, POTENTIAL, False, COLUMNS, [f"d_{m}" for m in COLUMNS])
    final = cut_lineage(down.select("path", *[(F.col(e) + F.col(f"d_{m}")).alias(m) for e, m in zip(EVIDENCE, COLUMNS)])).withColumn("top", F.greatest(*COLUMNS))  # one stage would grow too large to compile
    label = F.coalesce(*[F.when(F.col(m) == F.col("top"), name) for m, name in zip(COLUMNS, LABELS)])
    p = F.exp(F.col(COLUMNS[HAND]) - F.col("top")) / sum((F.exp(F.col(m) - F.col("top")) for m in COLUMNS[1:]), F.exp(F.col(COLUMNS[HAND]) - F.col("top")))
    return final.select("path", label.alias("label"), p.alias("p_handwritten")).withColumn("handwritten", F.col("p_handwritten") >= 0.5)
