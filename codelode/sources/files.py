"""Source trees as DataFrames: recursive scan, ignore rules, project roots."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.languages import is_supported, language_of
from codelode.functions.text import base_name

MAX_BYTES, MAX_IGNORE_BYTES = 10 << 20, 1 << 20
# Folders that are never scanned, and files that mark a project's root.
IGNORED = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".zig-cache", "zig-cache", "zig-out", ".build", "build", "dist", "target", ".next", ".nuxt", ".output", ".cache", ".venv",
    "venv", ".tox", "vendor", ".gradle", ".idea", ".vs", ".vscode",
)
MARKERS = (".git", "build.zig", "Cargo.toml", "package.json", "go.mod", "pyproject.toml", "Makefile", "CMakeLists.txt", ".sln", "Gemfile", "pom.xml", "build.gradle")


def project_root(start: str) -> str:
    """The nearest folder upwards with a marker, else ``start`` itself."""
    here = Path(start).resolve()
    return str(next((p for p in (here, *here.parents) if any((p / m).exists() for m in MARKERS)), here))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regex: * and ** match anything, slashes too, **/ needs a character after it, ? is one character."""
    out = []
    for token in re.findall(r"\*\*/|\*+|\?|[^*?]+", pattern):
        out.append("(?=.).*" if token == "**/" else ".*" if token[0] == "*" else "." if token == "?" else re.escape(token))
    return "(?s)^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    """A pattern without a slash is matched against the base name, another against the whole path."""
    return (path if "/" in pattern else base_name(path)).rlike(glob_regex(pattern))


def parse_ignore(text: str) -> list[tuple[str, bool]]:
    """(pattern, negated) of each rule of an ignore file, in order."""
    rules = []
    for line in text.split("\n"):
        line = line.strip(" \t\r")
        if not line or line[0] == "#":
            continue
        negated = line[0] == "!"
        line = line[1:] if negated else line
        line = line.removesuffix("/").removeprefix("/")
        if line:
            rules.append((line, negated))
    return rules


def load_ignore(root: str) -> list[tuple[str, bool]]:
    f = Path(root) / ".gitignore"
    return parse_ignore(f.read_text(errors="replace")) if f.is_file() and f.stat().st_size <= MAX_IGNORE_BYTES else []


def is_ignored(path: Column, rules: list[tuple[str, bool]] = ()) -> Column:
    """Built-in folders always; of the rules the last that matches decides."""
    out = F.lit(False)
    for pattern, negated in rules:
        out = F.when(glob_match(path, pattern), F.lit(not negated)).otherwise(out)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED))) | out


def scan_tree(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, project: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(project, file_path, lang, mtime, size, source) of the supported files below ``root``; paths are relative to it.

    Name and size are tested on file metadata, before any content is read.
    """
    base = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(base, wholetext=True)
    full = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    rel = F.substr(full, F.length(F.lit(base)) + 2)
    kept = files.where((F.col("_metadata.file_size") <= max_bytes) & is_supported(rel) & ~is_ignored(rel, load_ignore(base) if rules is None else rules))
    return kept.select(F.lit(project or base).alias("project"), rel.alias("file_path"), language_of(rel).alias("lang"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("source"))
