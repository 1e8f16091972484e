"""Files of a directory tree as a table: denylists, ignore files, size guard."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileTooLarge, NotFound
from ..functions import fixed
from ..functions.text import last_segment, mime_for

IGNORE_FILES = (".ignore", ".gitignore")


@lru_cache(maxsize=4096)
def _pattern(rule: str) -> re.Pattern:
    """A gitignore glob as a regular expression on a path relative to the ignore file."""
    anchored, body = "/" in rule.rstrip("/"), rule.strip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1).replace("\\", "") + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out)


class IgnoreRules:
    """The rules of the ignore files from the root down to a directory; the last that matches decides."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = ()):
        self.rules = rules

    def extended(self, directory: str, in_git: bool) -> IgnoreRules:
        out = self
        for name in IGNORE_FILES if in_git else IGNORE_FILES[:1]:
            out = out.with_file(os.path.join(directory, name), directory)
        return out

    def with_file(self, path: str, base: str) -> IgnoreRules:
        """With the rules of a file, which hold below ``base``."""
        if not os.path.isfile(path):
            return self
        lines = Path(path).read_text(errors="replace").splitlines()
        return IgnoreRules((*self.rules, *((base, x.rstrip()) for x in lines if x.strip() and not x.startswith("#"))))

    @staticmethod
    def above(root: str) -> IgnoreRules:
        """The rules that hold at ``root`` already: of the user, of the repository, and of the directories above."""
        parents = [*map(str, reversed(Path(root).parents))]
        tops = [p for p in [*parents, root] if os.path.isdir(os.path.join(p, ".git"))]
        out = IgnoreRules()
        if tops:
            home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
            out = out.with_file(os.path.join(home, "git", "ignore"), tops[-1]).with_file(os.path.join(tops[-1], ".git", "info", "exclude"), tops[-1])
        for p in parents:
            out = out.extended(p, bool(tops) and p.startswith(tops[-1]))
        return out

    def ignores(self, path: str, is_dir: bool) -> bool:
        out = False
        for base, rule in self.rules:
            plain = rule.removeprefix("!")
            if plain.endswith("/") and not is_dir:
                continue
            if _pattern(plain).fullmatch(os.path.relpath(path, base).replace(os.sep, "/")):
                out = not rule.startswith("!")
        return out


def ignored_name(name: str) -> bool:
    suffix = os.path.splitext(name)[1].lower()
    return name in fixed.IGNORED_NAMES or name.startswith(tuple(fixed.IGNORED_PREFIXES)) or suffix in fixed.IGNORED_EXTS


def walk(root: str, exclude: tuple[str, ...] = ()) -> Iterator[str]:
    """Paths of regular files below ``root``, hidden ones too; barred directories are not entered, links not followed."""
    if not os.path.isdir(root):
        raise NotFound(root)
    barred, root = {*fixed.IGNORED_DIRS, *exclude}, os.path.abspath(root)
    in_git = any(os.path.isdir(os.path.join(p, ".git")) for p in [root, *map(str, Path(root).parents)])

    def visit(directory: str, rules: IgnoreRules) -> Iterator[str]:
        rules = rules.extended(directory, in_git)
        for entry in sorted(os.scandir(directory), key=lambda e: e.name):
            if entry.is_symlink():
                continue
            if entry.is_dir():
                below = fixed.ONLY_BELOW.get(entry.name)
                if entry.name in barred or (below and os.path.basename(directory) != below) or rules.ignores(entry.path, True):
                    continue
                yield from visit(entry.path, rules)
            elif entry.is_file() and not ignored_name(entry.name) and not rules.ignores(entry.path, False) and entry.stat().st_size <= fixed.MAX_FILE_SIZE:
                yield entry.path

    yield from visit(root, IgnoreRules.above(root))


def read_bytes(path: str) -> bytes:
    size = os.path.getsize(path)
    if size > fixed.MAX_FILE_SIZE:
        raise FileTooLarge(f"{path}: {size} bytes")
    return Path(path).read_bytes()


def list_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """file_uri, name, mime_type, size_bytes, modified_at. The listing runs on the driver; contents are read by executors."""
    rows = [(p, os.path.getsize(p), os.path.getmtime(p)) for p in walk(root, exclude)]
    df = spark.createDataFrame(rows, "file_uri string, size_bytes long, modified_at double")
    name = last_segment(F.col("file_uri"))
    return df.select("file_uri", name.alias("name"), mime_for(name).alias("mime_type"), "size_bytes", "modified_at")


def with_contents(files: DataFrame) -> DataFrame:
    """Adds content; read in the tasks, from a path that all executors see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(content=[read_bytes(p) for p in pdf["file_uri"]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "content binary"])
    return files.mapInPandas(run, schema)


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    files = list_files(spark, root, exclude)
    return with_contents(files.repartition(partitions or spark.sparkContext.defaultParallelism))


def read_binary_files(spark: SparkSession, path: str) -> DataFrame:
    """The same table from any file system that Spark reads, without hidden files; too large ones are left out by the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= fixed.MAX_FILE_SIZE)
    name = last_segment(F.col("path"))
    out = raw.select(F.col("path").alias("file_uri"), name.alias("name"), mime_for(name).alias("mime_type"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1e6).alias("modified_at"), "content")
    return out
