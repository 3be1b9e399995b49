"""Folder listings with ignore rules."""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that a listing leaves out, and files that stand out.
IGNORED = (
    ".git __pycache__ node_modules .venv venv .tox dist build .pytest_cache .mypy_cache .ruff_cache .idea .vscode target .next .nuxt coverage .cache .DS_Store"
).split()
NOTABLE = "package.json pyproject.toml dockerfile makefile cargo.toml go.mod setup.py requirements.txt".split()
NOTABLE_PREFIXES = ("readme", "license", "changelog", "contributing")
FILES = "path string, parent string, name string, is_dir boolean, size long, mtime double, depth int"


def ignored(name):
    return name.isin(IGNORED) | name.endswith(".egg-info")


def notable(name):
    starts = F.lit(False)
    for p in NOTABLE_PREFIXES:
        starts |= F.lower(name).startswith(p)
    return starts | F.lower(name).isin(NOTABLE)


def git_pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """A line of an ignore file as (pattern over relative paths, for folders only, takes back)."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.strip("/") if line.count("/") == line.endswith("/") else "/" + line.strip("/")
    anchored = line.startswith("/")
    parts = [".*" if p == "**" else fnmatch.translate(p)[4:-3].replace(".*", "[^/]*") if fnmatch.translate(p).startswith("(?s:") else re.escape(p) for p in line.strip("/").split("/")]
    body = "/".join(parts).replace(".*/", "(?:.*/)?")
    return re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.S), folder, back


def excluded(rules: list, path: str, is_dir: bool) -> bool:
    out = False
    for rule in rules:
        if rule and (is_dir or not rule[1]) and rule[0].match(path):
            out = not rule[2]
    return out


def walk(spark: SparkSession, root: str, max_depth: int = 8, gitignore: bool = True) -> DataFrame:
    """Files and folders below a local root, as rows; a listing is driver work and bounded by one machine's folder."""
    rules, rows = [], [("/", None, os.path.basename(os.path.abspath(root)), True, 0, 0.0, 0)]
    if gitignore and os.path.exists(os.path.join(root, ".gitignore")):
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as f:
            rules = [git_pattern(line) for line in f]
    todo = [("", 0)]
    while todo:
        folder, depth = todo.pop()
        for entry in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
            path, is_dir = f"{folder}/{entry.name}".lstrip("/"), entry.is_dir(follow_symlinks=False)
            if entry.name in IGNORED or entry.name.endswith(".egg-info") or excluded(rules, path, is_dir):
                continue
            stat = entry.stat(follow_symlinks=False)
            rows.append((f"/{path}", f"/{folder}" if folder else "/", entry.name, is_dir, 0 if is_dir else stat.st_size, 0.0 if is_dir else stat.st_mtime, depth + 1))
            if is_dir and depth + 1 < max_depth:
                todo.append((path, depth + 1))
    return spark.createDataFrame(rows, FILES)
