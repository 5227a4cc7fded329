"""Source trees as a Spark data source: ``spark.read.format("source_tree").load(folder)``.

Columns: ``project`` (the folder asked for), ``path``, ``is_dir``, ``indexable`` (a file with a
supported extension), and ``content`` with the option ``contents``. Several projects are given as
a JSON list in the option ``projects``. Skipped and hidden directories are not entered and not
listed. Folders must be reachable by every executor under the same name.

The plan lists directories breadth-first only until there are ``PARTITIONS`` of them; a partition is one
of these with all that is below, or one that was opened already with its own entries alone. Tasks walk the
rest. With the option ``pushdown``, which needs the session setting ``PUSHDOWN``, comparisons of ``project``,
``is_dir`` and ``indexable`` with a value, and beginnings of ``path``, are applied while walking: a directory that
cannot hold a wanted path is not entered.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from codeloom.schema import LANGUAGE_BY_EXTENSION, SKIPPED_DIRECTORIES

FORMAT = "source_tree"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PARTITIONS = 256
_ROWS = "project string, path string, is_dir boolean, indexable boolean"


@dataclass
class Folder(InputPartition):
    project: str
    path: str
    below: bool

    def __post_init__(self) -> None:
        super().__init__(self.path)


@dataclass
class Wanted:
    """What pushed filters leave: a row fits when it fits all of them."""

    projects: frozenset[str] | None = None
    starts: tuple[str, ...] = ()
    is_dir: bool | None = None
    indexable: bool | None = None
    nothing: bool = False

    def take(self, condition: Filter) -> bool:
        """Whether the condition was taken over."""
        column = ".".join(condition.attribute) if hasattr(condition, "attribute") else None
        if column == "project" and isinstance(condition, EqualTo | In):
            values = frozenset(condition.value if isinstance(condition, In) else [condition.value])
            self.projects = values if self.projects is None else self.projects & values
        elif column == "path" and isinstance(condition, StringStartsWith):
            self.starts += (condition.value,)
        elif column in ("is_dir", "indexable") and isinstance(condition, EqualTo) and isinstance(condition.value, bool):
            known = getattr(self, column)
            self.nothing |= known is not None and known != condition.value
            setattr(self, column, condition.value)
        else:
            return False
        return True

    def enters(self, folder: str) -> bool:
        inside = folder.rstrip("/") + "/"
        return all(s.startswith(inside) or inside.startswith(s) for s in self.starts)

    def fits(self, path: str, is_dir: bool, indexable: bool) -> bool:
        kinds = (self.is_dir is None or self.is_dir == is_dir) and (self.indexable is None or self.indexable == indexable)
        return kinds and all(path.startswith(s) for s in self.starts)


def supported(name: str) -> bool:
    stem, dot, extension = name.rpartition(".")
    return bool(stem and dot) and extension in LANGUAGE_BY_EXTENSION


def entries(folder: str) -> Iterator[tuple[str, bool, bool]]:
    """(path, is_dir, indexable) of what a directory holds; an unreadable one is empty.

    Links are followed, but one that leads back to a directory it lies in is left out.
    """
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    real = os.path.realpath(folder) + "/"
    for entry in found:
        if entry.is_dir():
            if entry.name.startswith(".") or entry.name in SKIPPED_DIRECTORIES:
                continue
            if entry.is_symlink() and real.startswith(os.path.realpath(entry.path) + "/"):
                continue
            yield os.path.join(folder, entry.name), True, False
        elif entry.is_file():
            yield os.path.join(folder, entry.name), False, supported(entry.name)


def text_of(path: str) -> str | None:
    """A file as UTF-8; None where it cannot be read as such."""
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


class TreeReader(DataSourceReader):
    def __init__(self, projects: list[str], contents: bool, partitions: int) -> None:
        self.projects, self.contents, self.count = projects, contents, partitions
        self.wanted = Wanted()

    def partitions(self) -> list[Folder]:
        wanted = self.wanted
        if wanted.nothing:
            return []
        chosen = dict.fromkeys(p for p in self.projects if wanted.projects is None or p in wanted.projects)
        waiting = deque((p, p) for p in chosen if wanted.enters(p))
        opened: list[Folder] = []
        while waiting and len(waiting) + len(opened) < self.count:
            project, folder = waiting.popleft()
            opened.append(Folder(project, folder, False))
            waiting.extend((project, path) for path, is_dir, _ in entries(folder) if is_dir and wanted.enters(path))
        return opened + [Folder(project, folder, True) for project, folder in waiting]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        if partition is None:  # Spark's one task where nothing was planned
            return
        stack = [partition.path]
        while stack:
            for path, is_dir, indexable in entries(stack.pop()):
                if is_dir and partition.below and self.wanted.enters(path):
                    stack.append(path)
                if self.wanted.fits(path, is_dir, indexable):
                    row = (partition.project, path, is_dir, indexable)
                    yield (*row, text_of(path) if indexable else None) if self.contents else row


class FilteringTreeReader(TreeReader):
    """With filters; Spark refuses a reader that takes them where the session does not push them down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if not self.wanted.take(condition):
                yield condition


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _contents(self) -> bool:
        return self.options.get("contents", "false").lower() == "true"

    def schema(self) -> str:
        return _ROWS + (", content string" if self._contents() else "")

    def reader(self, schema) -> TreeReader:
        given = self.options.get("projects")
        projects = json.loads(given) if given else [self.options["path"]] if self.options.get("path") else []
        kind = FilteringTreeReader if self.options.get("pushdown", "false").lower() == "true" else TreeReader
        return kind(projects, self._contents(), int(self.options.get("partitions", PARTITIONS)))


def read_trees(spark: SparkSession, projects: list[str], contents: bool = False) -> DataFrame:
    """Everything below the project directories, outside skipped and hidden ones; a missing directory is empty.

    Filters reach the walk where ``spark.sql.python.filterPushdown.enabled`` is set, as ``spark_session`` does.
    """
    spark.dataSource.register(SourceTree)
    reader = spark.read.format(FORMAT).option("projects", json.dumps(projects)).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    return reader.option("contents", str(contents).lower()).load()
