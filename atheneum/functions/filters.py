"""Filters that are put together at run time, and patterns of paths and names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# States of the queue that end it, and names and suffixes that a scan skips.
ENDED = ["done", "failed"]
SKIPPED_NAMES = [".DS_Store", "Thumbs.db", "desktop.ini", ".git", "__pycache__", "node_modules", ".venv"]
SKIPPED_SUFFIXES = [".tmp", ".swp", ".pyc"]


def all_of(*tests: Column | None) -> Column:
    """Whether all given tests hold; true without any."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def any_of(*tests: Column | None) -> Column:
    """Whether one of the given tests holds; false without any."""
    return reduce(lambda a, b: a | b, [t for t in tests if t is not None], F.lit(False))


def pending(status: Column) -> Column:
    """States that the queue still has to work on."""
    return ~status.isin(ENDED)


def in_or_null(value: Column, values: list) -> Column:
    return value.isin(values) | value.isNull()


def of_kind(is_audio: Column, kind: str) -> Column:
    """all, documents or audio."""
    return {"all": F.lit(True), "documents": ~is_audio, "audio": is_audio}[kind]


def under(path: Column, prefix: str) -> Column:
    return path.startswith(prefix)


def outside(path: Column, segments: list[str]) -> Column:
    """Whether the path holds none of the segments (patterns of LIKE)."""
    return ~any_of(*(path.like(s) for s in segments))


def not_blank(text: Column) -> Column:
    return F.length(F.trim(text)) > 0


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression for a whole text: * and ? also match slashes."""
    out = []
    k = 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            body = glob[k + 1 : end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            k = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def ignored(path: Column, name: Column, names: list[str] = SKIPPED_NAMES, suffixes: list[str] = SKIPPED_SUFFIXES, subtrees: list[str] = ()) -> Column:
    """Whether a scan skips a path: by exact name, suffix, or subtree (a glob of it, or anything below)."""
    below = [path.rlike(glob_pattern(s)) | (path == s) | path.startswith(s + "/") for s in subtrees]
    return name.isin(list(names)) | any_of(*(name.endswith(s) for s in suffixes)) | any_of(*below)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
