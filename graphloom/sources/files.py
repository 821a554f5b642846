"""Source files of a project: git and directory scans, include rules, and reading in bulk."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import file_glob
from graphloom.operators.extract import EXTENSIONS, MAX_BYTES

#: Directories that hold no source of the project, and the marker file of an ignored directory.
EXCLUDED_DIRS = "node_modules .git .hg .svn dist build out target vendor bower_components __pycache__ .venv venv .tox .mypy_cache .pytest_cache .next .nuxt .svelte-kit coverage .gradle .idea .vscode Pods DerivedData .dart_tool".split()
IGNORE_MARKER = ".graphloomignore"


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def git_visible_files(root: str) -> set[str] | None:
    """Tracked files, submodules included, and untracked ones that are not ignored; None outside a repository."""
    if _git(root, "rev-parse", "--is-inside-work-tree") is None:
        return None
    tracked = _git(root, "ls-files", "-z", "--recurse-submodules") or ""
    untracked = _git(root, "ls-files", "-z", "--others", "--exclude-standard") or ""
    return {p for p in (tracked + untracked).split("\0") if p}


def git_changed_files(root: str) -> list[tuple[str, str]]:
    """(path, status) of the work tree: added, modified or removed."""
    out = []
    for entry in filter(None, (_git(root, "status", "--porcelain", "-z", "--no-renames", "-uall") or "").split("\0")):
        code, path = entry[:2], entry[3:]
        out.append((path, "added" if code == "??" else "removed" if "D" in code else "modified"))
    return out


def walk_files(root: str, excluded: Sequence[str] = EXCLUDED_DIRS) -> list[str]:
    """Files below a directory; links are followed once, excluded and marked directories are skipped, broken links too."""
    out, seen = [], set()

    def visit(folder: str, prefix: str) -> None:
        real = os.path.realpath(folder)
        if real in seen or os.path.exists(os.path.join(folder, IGNORE_MARKER)):
            return
        seen.add(real)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if e.is_dir() and e.name not in excluded:
                visit(e.path, f"{prefix}{e.name}/")
            elif e.is_file():
                out.append(prefix + e.name)

    visit(root, "")
    return out


def included(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Whether a path matches an include glob and no exclude glob; without include globs, any known source extension."""
    ok = path.rlike("|".join(file_glob(g) for g in include)) if include else F.lower(path).rlike(r"\.(" + "|".join(re.escape(e[1:]) for e in EXTENSIONS) + ")$")
    bad = "|".join(file_glob(g) for g in exclude)
    return ok & ~path.rlike(bad) if bad else ok


def list_files(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Paths of the sources of a project: (path), from git where there is a repository, else from the directory."""
    found = git_visible_files(root)
    paths = sorted(found) if found is not None else walk_files(root)
    return spark.createDataFrame([(p,) for p in paths], "path string").filter(included(F.col("path"), include, exclude))


def read_files(spark: SparkSession, root: str, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Contents of the sources below a directory: (path, content, size, modified_at, content_hash); too large ones have a null content.

    Files are listed and read by the executors, so root must be on storage that all of them reach. Where root is a
    repository, files that git ignores are left out.
    """
    base = Path(root).resolve().as_uri()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.expr(f"substring(path, locate('{Path(root).resolve().as_posix()}', path) + {len(Path(root).resolve().as_posix()) + 1})")
    rows = rows.withColumn("path", path).filter(included(F.col("path"), include, exclude))
    inside = "|".join(re.escape(d) for d in EXCLUDED_DIRS)
    rows = rows.filter(~F.col("path").rlike(rf"(^|/)({inside})/"))
    if git_visible_files(root) is not None:
        rows = rows.join(list_files(spark, root, include, exclude), "path", "left_semi")
    text = F.when(F.col("length") <= MAX_BYTES, F.make_valid_utf8(F.col("content").cast("string")))
    return rows.select("path", text.alias("content"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"))
