"""The library's front: a code graph in a folder of tables."""

from __future__ import annotations

import fcntl
import json
from collections.abc import Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import columns as fx
from graphloom.functions.text import file_glob
from graphloom.operators import context, extract, frameworks, graph, report, resolve, scans, search, stats, storage
from graphloom.sources import files as sources
from graphloom.sources.manifests import load_aliases

TABLES = ("nodes", "edges", "refs", "files", "sources")


class GraphSession:
    """Index, synchronise and query one project. Tables live in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, store: str, registry: extract.Registry | None = None):
        self.spark, self.store, self.registry = spark, storage.Store(spark, store), registry
        self.folder = Path(store)

    @contextmanager
    def _locked(self):
        with open(self.folder / ".lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    # Building

    def index(self, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> dict[str, int]:
        """Reads, extracts and resolves a whole project anew."""
        self._note_aliases(root)
        return self.index_rows(sources.read_files(self.spark, root, include, exclude))

    def index_rows(self, texts: DataFrame) -> dict[str, int]:
        """Like index(), from rows (path, content, size, modified_at, content_hash)."""
        with self._locked():
            self.store.write("sources", texts)
            self._extract(self.store.read("sources"), replace=True)
            self._resolve()
            return self.counts()

    def sync(self, root: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> dict[str, int]:
        """Takes in what changed since; the result equals a full index."""
        self._note_aliases(root)
        return self.sync_rows(sources.read_files(self.spark, root, include, exclude))

    def _note_aliases(self, root: str) -> None:
        self.store.set_metadata("aliases", json.dumps(load_aliases(root)))

    def sync_rows(self, texts: DataFrame) -> dict[str, int]:
        with self._locked():
            plan = storage.sync_plan(texts, self.store.read("files")).cache()
            found = {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}
            if found:
                changed = texts.join(plan.filter("status <> 'removed'"), "path", "left_semi")
                gone = plan.select("path")
                kept = self.store.read("sources").join(gone, "path", "left_anti")
                self.store.write("sources", kept.unionByName(changed.select(kept.columns)))
                self._extract(self.store.read("sources").join(gone, "path", "left_semi"), replace=False, gone=gone)
                self._resolve()
            plan.unpersist()
            return {s: found.get(s, 0) for s in ("added", "modified", "removed")}

    def _extract(self, texts: DataFrame, replace: bool, gone: DataFrame | None = None) -> None:
        raw = extract.extract(texts, registry=self.registry).cache()
        nodes = extract.explode_rows(raw, "nodes").dropDuplicates(["id"])
        nodes = nodes.filter(" AND ".join(f"coalesce({c}, '') <> ''" for c in ("id", "kind", "name", "file_path", "language")))
        edges = storage.valid_edges(extract.explode_rows(raw, "edges"), nodes).withColumn("file_path", F.lit(None).cast("string"))
        owner = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("p"))
        edges = edges.drop("file_path").join(owner, "source").withColumnRenamed("p", "file_path")
        refs = storage.valid_references(extract.explode_rows(raw, "refs"), nodes)
        counts = raw.select("path", "language", F.size("nodes").alias("node_count"), "errors")
        rows = texts.select("path", "content_hash", "size", "modified_at").join(counts, "path")
        for name, fresh, column in (("nodes", nodes, "file_path"), ("contains", edges, "file_path"), ("refs", refs, "file_path"), ("files", rows, "path")):
            if not replace:
                old = self.store.read(name).join(gone.select(F.col("path").alias(column)), column, "left_anti")
                fresh = old.unionByName(fresh)
            self.store.write(name, fresh)
        raw.unpersist()

    def _resolve(self) -> None:
        """Resolves all references again, so links across files never go stale."""
        nodes = self.store.read("nodes")
        refs = self.store.read("refs").withColumn("ref_id", F.xxhash64("from_node_id", "reference_name", "reference_kind", "line", "col"))
        shown = [r["framework"] for r in frameworks.detect_frameworks(self.store.read("sources")).collect()]  # at most as many as frameworks exist
        earlier = frameworks.by_convention(refs, nodes, shown) if shown else None
        imports = self._imports(nodes, refs)
        earlier = imports if earlier is None else earlier.unionAll(imports)
        found = resolve.resolve(refs, nodes, earlier)
        links = resolve.resolved_edges(refs, found, nodes)
        contains = self.store.read("contains").select("source", "target", "kind", "line")
        every = contains.unionByName(links.select("source", "target", "kind", "line"))
        self.store.write("edges", every.withColumn("edge_id", F.xxhash64("source", "target", "kind", "line")))
        self.store.write("unresolved", refs.join(found, "ref_id", "left_anti"))

    def _imports(self, nodes: DataFrame, refs: DataFrame) -> DataFrame:
        """References resolved by imports, through path aliases and re-exports."""
        texts, aliases = self.store.read("sources"), [tuple(a) for a in json.loads(self.store.metadata().get("aliases", "[]"))]
        known = nodes.filter("kind = 'file'").select(F.col("file_path").alias("module_path"))

        def files_of(table: DataFrame) -> DataFrame:
            tried = table.select("path", "local_name", "export_name", "module", F.posexplode("candidates").alias("rank", "module_path"))
            hit = tried.join(known, "module_path", "left_semi").groupBy("path", "local_name", "export_name", "module").agg(F.min_by("module_path", "rank").alias("module_path"))
            return hit.withColumnRenamed("path", "file_path").drop("module")

        exports = files_of(extract.export_table(texts, aliases=aliases)).select("file_path", F.col("local_name").alias("export_name"), "module_path", F.col("export_name").alias("source_name"))
        return resolve.by_import(refs, files_of(extract.import_table(texts, aliases=aliases)), nodes, exports)

    # Reading

    @property
    def nodes(self) -> DataFrame:
        return self.store.read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self.store.read("edges")

    @property
    def files(self) -> DataFrame:
        return self.store.read("files")

    def counts(self) -> dict[str, int]:
        return {"nodes": self.nodes.count(), "edges": self.edges.count(), "files": self.files.count(), "unresolved": self.store.read("unresolved").count()}

    def stats(self) -> DataFrame:
        return stats.totals(self.nodes, self.edges, self.files)

    def search(self, query: str, kinds: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
        kinds = ["type_alias" if k == "type" else k for k in kinds] if kinds else None
        return search.search(self.nodes, query, kinds=kinds, limit=max(1, min(limit, 100)))

    def symbols(self, name: str) -> DataFrame:
        return search.symbol_matches(self.nodes, name)

    def node(self, node_id: str) -> DataFrame:
        return scans.node_by_id(self.nodes, node_id)

    def callers(self, name: str, limit: int = 20) -> DataFrame:
        return context.relationships(self.edges, self.nodes, self._ids(name), True, limit)

    def callees(self, name: str, limit: int = 20) -> DataFrame:
        return context.relationships(self.edges, self.nodes, self._ids(name), False, limit)

    def _ids(self, name: str, most: int = 50) -> list[str]:
        return [r["id"] for r in self.symbols(name).select("id").orderBy("id").limit(most).collect()]

    def impact(self, node_id: str, depth: int = 2) -> DataFrame:
        return graph.impact(self.edges, self.nodes, node_id, max(1, min(depth, 10)))

    def path(self, source: str, target: str) -> DataFrame:
        return graph.find_path(self.edges, self.nodes, source, target)

    def hierarchy(self, node_id: str) -> DataFrame:
        return graph.type_hierarchy(self.edges, self.nodes, node_id)

    def dead_code(self) -> DataFrame:
        return graph.dead_code(self.edges, self.nodes)

    def cycles(self) -> DataFrame:
        return graph.file_cycles(self.edges, self.nodes)

    def affected(self, changed: Sequence[str], depth: int = 5, pattern: str | None = None) -> DataFrame:
        test = F.col("path").rlike(file_glob(pattern)) if pattern else fx.is_affected_test(F.col("path"))
        return graph.affected_tests(self.edges, self.nodes, changed, test, depth)

    def file_list(self, prefix: str = "", limit: int | None = None) -> DataFrame:
        return scans.files_under(self.files, prefix, limit)

    def context(self, question: str, most: int = 20, form: str = "markdown") -> str:
        """The answer to a question as a report with code."""
        found = context.relevant(self.nodes, self.edges, question, most=max(1, min(most, 100)))
        return context.report(question, found, context.code_blocks(found.nodes, self.store.read("sources")), form)

    def explore(self, question: str, most_files: int = 8) -> str:
        """An exploration of a question: the best files with their code, and how their symbols relate."""
        return report.explore(question, self.nodes, self.edges, self.store.read("sources"), self.files.count(), max(1, min(most_files, 20)))

    def listing(self, prefix: str = "", form: str = "tree", limit: int = 500) -> str:
        return report.file_listing(self.files, prefix, form, limit)

    def optimize(self, partitions: int = 1) -> None:
        for name in ("nodes", "edges", "refs", "files"):
            self.store.optimize(name, partitions)
