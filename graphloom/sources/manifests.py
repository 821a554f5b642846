"""Project files that steer an index: configuration, path aliases and package manifests. All are small and read on the driver."""

from __future__ import annotations

import json
import posixpath
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from graphloom.functions.text import is_safe_regex

#: Files that name a project's dependencies.
MANIFESTS = "package.json requirements.txt pyproject.toml setup.py Pipfile go.mod Cargo.toml pom.xml build.gradle build.gradle.kts Gemfile composer.json Package.swift pubspec.yaml".split()


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)


def load_aliases(root: str) -> list[tuple[str, str]]:
    """(pattern, target) of the paths of tsconfig.json or jsconfig.json, the most specific first; none if unreadable."""
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            options = json.loads(strip_jsonc((Path(root) / name).read_text())).get("compilerOptions", {})
        except (OSError, ValueError, AttributeError):
            continue
        base = options.get("baseUrl") or "."
        found = [(pattern, posixpath.normpath(posixpath.join(base, t))) for pattern, targets in (options.get("paths") or {}).items() if pattern.count("*") <= 1 for t in targets if isinstance(t, str)]
        return sorted(found, key=lambda a: (-len(a[0].split("*")[0]), "*" in a[0]))
    return []


def read_manifests(root: str) -> dict[str, str]:
    """Texts of the manifests at the root of a project."""
    return {n: (Path(root) / n).read_text(errors="replace") for n in MANIFESTS if (Path(root) / n).is_file()}


@dataclass
class Config:
    """Settings of a project; patterns are (name, expression, kind) and become symbols of their own."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    max_bytes: int = 1 << 20
    patterns: list[tuple[str, str, str]] = field(default_factory=list)

    def problems(self) -> list[str]:
        out = [f"unsafe or invalid expression: {name}" for name, expression, _ in self.patterns if not is_safe_regex(expression)]
        return out + (["max_bytes must be positive"] if self.max_bytes <= 0 else [])

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> Config:
        """The settings of a file, the defaults without one; unknown fields are ignored."""
        try:
            held = json.loads(Path(path).read_text())
        except (OSError, ValueError):
            return cls()
        return cls(**{k: held[k] for k in ("include", "exclude", "max_bytes") if k in held}, patterns=[tuple(p) for p in held.get("patterns", [])])


def pattern_extractor(config: Config):
    """An extractor that turns matches of the settings' patterns into symbols; for Registry.register(framework=True)."""
    chosen = [(name, re.compile(expression, re.M), kind) for name, expression, kind in config.patterns if is_safe_regex(expression)]

    def run(found, source: str) -> None:
        for name, expression, kind in chosen:
            for m in expression.finditer(source):
                line = source.count("\n", 0, m.start()) + 1
                found.node(kind, (m.group(1) if m.groups() and m.group(1) else m[0])[:100] or name, line, line, found.nodes[0] if found.nodes else None)

    return run
