"""Storage rules: upserts, cascading deletes, integrity and synchronisation plans over DataFrames."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 4


def upsert(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of fresh replace stored rows of the same key; of several fresh rows of one key the last by all columns holds."""
    own = fresh.groupBy(key).agg(F.max(F.struct(*[c for c in stored.columns if c != key])).alias("own")).select(key, "own.*").select(stored.columns)
    return stored.join(own.select(key), key, "left_anti").unionAll(own)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose ends both exist; the bag keeps its repeats."""
    ids = nodes.select("id")
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def valid_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References whose symbol exists."""
    return refs.join(nodes.select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi")


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Links that stay when nodes go: none of their ends is among gone (id)."""
    ids = gone.select("id")
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti").join(ids.select(F.col("id").alias("target")), "target", "left_anti")


def without_references(refs: DataFrame, done: DataFrame) -> DataFrame:
    """References left when those of the same symbol, name and kind as done go, with all their repeats."""
    key = ["from_node_id", "reference_name", "reference_kind"]
    return refs.join(done.select(*key).distinct(), key, "left_anti")


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Files whose hash differs: (path, stored_hash, current_hash)."""
    return stored.select("path", F.col("content_hash").alias("stored_hash")).join(current.select("path", F.col("content_hash").alias("current_hash")), "path").filter("stored_hash <> current_hash")


def sync_plan(disk: DataFrame, tracked: DataFrame, unchanged: bool = False) -> DataFrame:
    """(path, status): added, modified or removed files, and unchanged ones if asked for."""
    both = disk.select("path", F.col("content_hash").alias("d"), F.lit(1).alias("on_disk")).join(tracked.select("path", F.col("content_hash").alias("t"), F.lit(1).alias("known")), "path", "full_outer")
    status = F.when(F.col("known").isNull(), "added").when(F.col("on_disk").isNull(), "removed").when(~F.col("d").eqNullSafe(F.col("t")), "modified").otherwise("unchanged")
    found = both.select("path", status.alias("status"))
    return found if unchanged else found.filter("status <> 'unchanged'")


def change_plan(changes: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, status) of a change feed (path, code): ?? adds, a code with D removes tracked files, anything else modifies."""
    known = tracked.select("path", F.lit(True).alias("known"))
    rows = changes.join(known, "path", "left")
    status = F.when(F.col("code") == "??", "added").when(F.col("code").contains("D"), F.when(F.col("known"), "removed")).otherwise("modified")
    return rows.select("path", status.alias("status")).filter("status IS NOT NULL")


class Store:
    """Tables in a folder, one Parquet directory a version; a pointer file is swapped, so readers see whole versions."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def _pointer(self, name: str) -> Path:
        return self.folder / f"{name}.json"

    def exists(self, name: str) -> bool:
        return self._pointer(name).exists()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.folder / json.loads(self._pointer(name).read_text())["path"]))

    def write(self, name: str, df: DataFrame, partitions: int | None = None) -> None:
        """Replaces a table; partitions compacts its files."""
        path = f"{name}-{uuid.uuid4().hex}"
        (df.repartition(partitions) if partitions else df).write.parquet(str(self.folder / path))
        fresh = self.folder / f".{path}.json"
        fresh.write_text(json.dumps({"path": path, "schema_version": SCHEMA_VERSION}))
        os.replace(fresh, self._pointer(name))

    def upsert(self, name: str, fresh: DataFrame, key: str) -> None:
        self.write(name, upsert(self.read(name), fresh, key) if self.exists(name) else fresh.dropDuplicates([key]))

    def append(self, name: str, fresh: DataFrame) -> None:
        self.write(name, self.read(name).unionByName(fresh) if self.exists(name) else fresh)

    def clear(self, name: str) -> None:
        self.write(name, self.read(name).limit(0))

    def optimize(self, name: str, partitions: int = 1) -> None:
        self.write(name, self.read(name), partitions)

    def set_metadata(self, key: str, value: str) -> None:
        path = self.folder / "metadata.json"
        held = json.loads(path.read_text()) if path.exists() else {}
        fresh = self.folder / f".metadata-{uuid.uuid4().hex}.json"
        fresh.write_text(json.dumps(held | {key: value}))
        os.replace(fresh, path)

    def metadata(self) -> dict[str, str]:
        path = self.folder / "metadata.json"
        return json.loads(path.read_text()) if path.exists() else {}
