"""Source files of a tree as a DataFrame.

Directories are listed level by level, each level in parallel, and a pruned
directory is never entered. (Spark's own file index leaves out names that begin
with an underscore, such as ``__init__.py``.) What decides on files are column
predicates; contents are read by the executors only for files that pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import fixed
from ..functions.scalars import detect_language, extension, file_name

ENTRIES = "path string, relative_path string, is_dir boolean, size_bytes long, ignored boolean, rules array<string>"


def ignore_regex(pattern: str, base: str) -> tuple[str, bool, bool] | None:
    """(regular expression over paths relative to the root, negated, directories only) of one line of a .gitignore in folder ``base``; None for comments and blanks."""
    line = pattern.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated or line.startswith(("\\#", "\\!")) else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, at = "", 0
    while at < len(line):
        if line.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif line.startswith("/**", at) and at + 3 == len(line):
            out, at = out + "/.*", at + 3
        elif line[at] == "*":
            out, at = out + "[^/]*", at + 1
        elif line[at] == "?":
            out, at = out + "[^/]", at + 1
        elif line[at] == "[" and (end := line.find("]", at + 2)) > 0:
            body = line[at + 1 : end]
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif line[at] == "\\" and at + 1 < len(line):
            out, at = out + re.escape(line[at + 1]), at + 2
        else:
            out, at = out + re.escape(line[at]), at + 1
    inside = re.escape(f"{base}/") if base else ""
    return f"^{inside}{'' if anchored else '(?:.*/)?'}{out}$", negated, only_dirs


def is_ignored(path: str, is_dir: bool, rules: list[str]) -> bool:
    """Whether the last matching rule ignores the path. A rule is its sign (+, or - for a negated one), d or a (directories, all), and its expression."""
    hit = False
    for rule in rules:
        if (rule[1] == "a" or is_dir) and re.match(rule[2:], path):
            hit = rule[0] == "+"
    return hit


def _listing(cascade: bool):
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, relative, rules in zip(batch["path"], batch["relative_path"], batch["rules"], strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
                infos = sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda i: i.base_name)
                held = list(rules) if cascade else []
                if any(i.base_name == ".gitignore" and i.is_file for i in infos):
                    text = system.open_input_stream(f"{inner}/.gitignore").read().decode(errors="replace")
                    for parsed in filter(None, (ignore_regex(x, relative) for x in text.split("\n"))):
                        held.append(("-" if parsed[1] else "+") + ("d" if parsed[2] else "a") + parsed[0])
                for i in infos:
                    is_dir = i.type == fs.FileType.Directory
                    name = f"{relative}/{i.base_name}" if relative else i.base_name
                    rows.append((prefix + i.path, name, is_dir, None if is_dir else i.size, is_ignored(name, is_dir, held), held if is_dir else []))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRIES.split(", ")])

    return expand


def list_tree(spark: SparkSession, root: str, cascade: bool = True) -> DataFrame:
    """Every entry of the tree below root (``ENTRIES``) but what lies in pruned directories.

    ``cascade``: a .gitignore holds for all folders below its own, as git has
    it; otherwise for entries of its own folder only.
    """
    root = root if "://" in root else f"file://{root}"
    work = scratch.folder(spark)
    level = spark.createDataFrame([(root.rstrip("/"), "", True, None, False, [])], ENTRIES)
    found, depth = None, 0
    while True:
        entries = scratch.stored(level.select("path", "relative_path", "rules").repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_listing(cascade), ENTRIES), f"{work}/{depth}")
        found = entries if found is None else found.unionByName(entries)
        level = entries.filter(F.col("is_dir") & ~F.col("ignored") & ~skipped_dir(F.col("relative_path")))
        depth += 1
        if level.isEmpty():
            return found


def skipped_dir(path: Column) -> Column:
    name = file_name(path)
    return name.isin(fixed.SKIP_DIRS) | name.endswith(".egg-info")


def in_skipped_dir(path: Column) -> Column:
    """Whether any folder of a relative path is one that is always skipped."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda x: x.isin(fixed.SKIP_DIRS) | x.endswith(".egg-info"))


def wanted_file(path: Column, size: Column, languages: list[str] | None = None, max_bytes: int = fixed.MAX_FILE_BYTES) -> Column:
    """Whether a file passes by its name, extension, size (the limit itself passes) and, if given, language."""
    ext = extension(path)
    keep = ~file_name(path).isin(fixed.SKIP_FILES) & ~ext.isin(fixed.BINARY_EXTENSIONS) & ext.isin(fixed.CODE_EXTENSIONS) & (size <= max_bytes)
    return keep & F.coalesce(detect_language(ext).isin([x.lower() for x in languages]), F.lit(False)) if languages else keep


def scan_files(spark: SparkSession, root: str, languages: list[str] | None = None, max_bytes: int = fixed.MAX_FILE_BYTES, cascade: bool = True) -> DataFrame:
    """path, relative_path, extension, size_bytes, language of the wanted files below root."""
    p = F.col("relative_path")
    files = list_tree(spark, root, cascade).filter(~F.col("is_dir") & ~F.col("ignored") & wanted_file(p, F.col("size_bytes"), languages, max_bytes))
    return files.select("path", "relative_path", extension(p).alias("extension"), "size_bytes", detect_language(extension(p)).alias("language"))


def tally(files: DataFrame, keep: Column) -> DataFrame:
    """One row: visited, skipped and yielded files."""
    return files.agg(F.count("*").alias("visited"), F.count_if(~keep).alias("skipped"), F.count_if(keep).alias("yielded"))


def scan_counts(spark: SparkSession, root: str, languages: list[str] | None = None, max_bytes: int = fixed.MAX_FILE_BYTES, cascade: bool = True) -> DataFrame:
    """The tally of the files that a scan of root meets."""
    return tally(list_tree(spark, root, cascade).filter(~F.col("is_dir")), ~F.col("ignored") & wanted_file(F.col("relative_path"), F.col("size_bytes"), languages, max_bytes))


def with_content(files: DataFrame) -> DataFrame:
    """file_path, language, content, sha256; a file that can't be read has null content."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            contents = []
            for path in batch["path"]:
                try:
                    system, inner = fs.FileSystem.from_uri(path)
                    contents.append(system.open_input_stream(inner).read())
                except OSError:
                    contents.append(None)
            yield pd.DataFrame({"file_path": batch["relative_path"], "language": batch["language"], "content": contents})

    rows = files.select("path", "relative_path", "language").mapInPandas(read, "file_path string, language string, content binary")
    return rows.withColumn("sha256", F.sha2("content", 256))
