"""Full and incremental indexing."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import content_hash
from codeloom.operators import changes
from codeloom.operators.resolve import Exists, in_tree, on_disk, resolve_imports
from codeloom.parse.project import parse_statements, split_parse
from codeloom.session import durable
from codeloom.sources import gittext
from codeloom.sources.listing import existing, read_sources
from codeloom.sources.store import Change, CodeStore
from codeloom.sources.tree import read_trees


def parse_sources(sources: DataFrame, exists: Exists, strict_compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, edges) of (project, file_path, content); ``exists`` decides what imports may name."""
    parsed = durable(parse_statements(sources))
    files, raw = split_parse(sources, parsed)
    return files, resolve_imports(raw, exists, strict_compat)


def _hashes(paths: DataFrame) -> DataFrame:
    """(project, file_path, content_hash) of paths, stored; the hash of an unreadable file is NULL."""
    return durable(
        read_sources(paths).select("project", "file_path", content_hash(F.col("content")).alias("content_hash"))
    )


def _store_paths(store: CodeStore | Change, paths: DataFrame, exists: Exists) -> None:
    """Read, parse and store (project, file_path) rows.

    The contents are written down once, so that tokens, texts and hash come from the same
    version of a file.
    """
    sources = durable(read_sources(paths).filter(F.col("content").isNotNull()))
    files, edges = parse_sources(sources, exists)
    store_parsed(store, durable(files), durable(edges))


def store_parsed(store: CodeStore | Change, files: DataFrame, edges: DataFrame) -> None:
    """Store parsed files and their edges, both written down before, as one version."""
    with _one(store) as change:
        change.upsert_files(files)
        change.replace_imports(files.select("project", F.col("file_path").alias("source_path")), edges)


@contextmanager
def _one(store: CodeStore | Change) -> Iterator[Change]:
    """A change of its own, or the one at hand."""
    if isinstance(store, Change):
        yield store
    else:
        with store.change() as change:
            yield change


def _store_changed(store: Change, hashes: DataFrame, exists: Exists) -> None:
    """Index the readable files whose hash differs from the stored one."""
    changed = changes.needs_parse(hashes.filter(F.col("content_hash").isNotNull()), store.files())
    _store_paths(store, durable(changed.select("project", "file_path")), exists)


def _counts(hashes: DataFrame) -> DataFrame:
    ok = F.col("content_hash").isNotNull()
    return hashes.groupBy("project").agg(F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("skipped"))


def full_index(store: CodeStore, projects: list[str], purge: bool = False) -> DataFrame:
    """Index whole trees; (project, indexed, skipped). Unchanged files count as indexed.

    Files that vanished stay in the tables unless ``purge`` is set.
    """
    listing = durable(read_trees(store.spark, projects))
    hashes = _hashes(listing.filter("indexable").select("project", F.col("path").alias("file_path")))
    roots = store.spark.createDataFrame([(p,) for p in projects], "project string")
    with store.change() as change:  # files, edges, removals and the status are one version
        _store_changed(change, hashes, in_tree(listing))
        if purge:
            here = hashes.select("project", "file_path")
            known = change.files().join(roots, "project", "left_semi").select("project", "file_path")
            change.remove(known.join(here, ["project", "file_path"], "left_anti"))
        change.save_status(roots, durable(gittext.parse_status(gittext.command_lines(roots, gittext.STATUS))))
    return roots.join(_counts(hashes), "project", "left").fillna(0)


def parse_only(spark, projects: list[str]) -> DataFrame:
    """(project, indexed, skipped) of parsing whole trees without storing anything."""
    listing = read_trees(spark, projects)
    return _counts(_hashes(listing.filter("indexable").select("project", F.col("path").alias("file_path"))))


def incremental_index(store: CodeStore | Change, found: DataFrame) -> DataFrame:
    """Apply changes (project, path, change); (project, indexed, removed)."""
    actions = durable(changes.split_changes(found, existing(found)))
    todo = actions.filter("action = 'index'").select("project", F.col("path").alias("file_path"))
    hashes = _hashes(todo)
    with _one(store) as change:
        change.remove(actions.filter("action = 'remove'").select("project", F.col("path").alias("file_path")))
        _store_changed(change, hashes, on_disk)
    removed = changes.action_counts(actions).select("project", "removed")
    return removed.join(_counts(hashes).select("project", "indexed"), "project", "left").select(
        "project", F.coalesce("indexed", F.lit(0)).alias("indexed"), "removed"
    )


def detect_changes(store: CodeStore | None, spark, projects: list[str]) -> tuple[DataFrame, DataFrame]:
    """Compare version-control status with the last snapshot and update the index.

    Returns (changes, counts): (project, path, change) and (project, indexed, removed).
    Without a store every status entry is new and nothing is written.
    """
    roots = spark.createDataFrame([(p,) for p in projects], "project string")
    current = durable(gittext.parse_status(gittext.command_lines(roots, gittext.STATUS)))
    last = current.limit(0)
    if store is not None:
        last = store.snapshots().join(roots, "project", "left_semi").select("project", "path", "code")
    on_disk = existing(last.select("project", "path"))
    found = durable(changes.diff_status(last, current, on_disk))
    if store is not None:
        with store.change() as change:
            counts = durable(incremental_index(change, found))
            change.save_status(roots, current)
        return found, counts
    todo = found.filter("change = 'modified'").select("project", F.col("path").alias("file_path"))
    parsed = _counts(_hashes(todo)).select("project", "indexed")
    gone = found.groupBy("project").agg(F.count_if(F.col("change") == "deleted").alias("removed"))
    return found, gone.join(parsed, "project", "left").fillna(0).select("project", "indexed", "removed")
