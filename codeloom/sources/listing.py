"""Source trees on a file system every executor can reach.

A tree is listed level by level: the directories of one level are spread over the tasks,
their subdirectories form the next level. File contents are read the same way. Nothing
passes through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import is_supported
from codeloom.schema import SKIPPED_DIRECTORIES
from codeloom.session import durable_counted

_ENTRY = "project string, path string, is_dir boolean, walked boolean"
_ROWS_PER_BATCH = 5_000
_BYTES_PER_BATCH = 8 << 20


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """List directories; an unreadable one is empty, a link back to a parent is not entered."""
    columns = ["project", "path", "is_dir", "walked"]
    for batch in batches:
        rows = []
        for project, folder, walked in zip(batch["project"], batch["path"], batch["walked"]):
            try:
                entries = os.scandir(folder)
            except OSError:
                continue
            real = os.path.realpath(folder)
            with entries:
                for entry in entries:
                    is_dir = entry.is_dir()
                    if not is_dir and not entry.is_file():
                        continue
                    if is_dir and entry.is_symlink() and (real + "/").startswith(os.path.realpath(entry.path) + "/"):
                        continue
                    kept = walked and not (is_dir and (entry.name in SKIPPED_DIRECTORIES or entry.name.startswith(".")))
                    rows.append((project, os.path.join(folder, entry.name), is_dir, kept))
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def list_tree(spark: SparkSession, projects: list[str] | DataFrame, skipped: bool = True) -> DataFrame:
    """(project, path, is_dir, indexable) of everything below each project directory.

    ``indexable`` marks supported files outside skipped and hidden directories. With
    ``skipped`` the contents of those directories are listed too, because an import may
    point into them.
    """
    if not isinstance(projects, DataFrame):
        projects = spark.createDataFrame([(p,) for p in projects], "project string")
    level = projects.select(
        "project", F.col("project").alias("path"), F.lit(True).alias("is_dir"), F.lit(True).alias("walked")
    )
    seen = None
    while True:
        folders = level.filter("is_dir" if skipped else "is_dir and walked").select("project", "path", "walked")
        level, rows = durable_counted(folders.repartition("path").mapInPandas(_scan, _ENTRY))
        if rows == 0:
            break
        seen = level if seen is None else seen.unionByName(level)
    if seen is None:
        seen = level
    return seen.select(
        "project", "path", "is_dir", (~F.col("is_dir") & F.col("walked") & is_supported(F.col("path"))).alias("indexable")
    )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["project", "file_path", "content"]
    for batch in batches:
        rows, size = [], 0
        for project, path in zip(batch["project"], batch["file_path"]):
            try:
                with open(path, "rb") as f:
                    content = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                content = None
            rows.append((project, path, content))
            size += len(content or "")
            if size >= _BYTES_PER_BATCH:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def read_sources(paths: DataFrame) -> DataFrame:
    """(project, file_path, content) of (project, file_path); unreadable or non-UTF-8 files give NULL."""
    spread = paths.select("project", "file_path").repartition("file_path")
    return spread.mapInPandas(_read, "project string, file_path string, content string")


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[[os.path.exists(p) for p in batch["path"]]]


def existing(paths: DataFrame) -> DataFrame:
    """The (project, path) rows whose path exists as a file or directory."""
    return paths.select("project", "path").distinct().mapInPandas(_probe, "project string, path string")


def looks_like_project(folder: str, home: str) -> bool:
    """Whether a working directory should be indexed on its own accord."""
    return len(folder) > 1 and folder != home and not folder.startswith("/tmp")
