"""The tables of one store, as Parquet folders under published versions, and the search index kept with them."""

from __future__ import annotations

import copy
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import epoch_ms
from codeloom.operators import changes, search
from codeloom.schema import DOCS, FILES, IMPORTS, POSTINGS, SNAPSHOTS
from codeloom.session import BROADCAST_ROWS, durable, durable_counted, may_hold, spread_join, uncounted
from codeloom.sources.versions import Versions

_FILE = ["project", "file_path"]
_TEXT = ["block", "place"]
# Rows lie in parts by project and by a bucket of this path; postings in parts by token.
_PATHS = {"code_file": "file_path", "code_import": "source_path", "code_status": "path", "code_doc": "file_path"}
_SCHEMAS = {"code_file": FILES, "code_import": IMPORTS, "code_status": SNAPSHOTS, "code_doc": DOCS, "code_token": POSTINGS}
TOKEN_PARTS = 16
# Segments of postings that are kept before a change merges them.
SEGMENTS = 16


def _digest(text: str, digits: int) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:digits]


def _token_part(token: str) -> str:
    return f"t{int(_digest(token, 6), 16) % TOKEN_PARTS}"


class View:
    """One version of the tables: whatever is published meanwhile, all reads are of this version.

    With ``project``, only that project's folders are read.
    """

    def __init__(self, spark: SparkSession, versions: Versions, manifest: dict):
        self.spark, self._versions, self._manifest = spark, versions, manifest

    @property
    def version(self) -> int:
        return self._manifest["number"]

    def _read(self, name: str, parts: set[str] | None = None, project: str | None = None) -> DataFrame:
        held = self._manifest["tables"].get(name, {})
        own = None if project is None else _digest(project, 16) + "-"
        folders = [
            f"{self._versions.root}/data/{name}/{commit}/part={part}"
            for part, commits in sorted(held.items())
            if (parts is None or part in parts) and (own is None or part.startswith(own))
            for commit in commits
        ]
        schema = _SCHEMAS[name]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows if project is None else rows.filter(F.col("project") == project)

    def files(self, project: str | None = None) -> DataFrame:
        return self._read("code_file", project=project)

    def imports(self, project: str | None = None) -> DataFrame:
        return self._read("code_import", project=project)

    def snapshots(self, project: str | None = None) -> DataFrame:
        return self._read("code_status", project=project)

    def create_views(self) -> None:
        """Temporary views of this version, by the tables' names, for SQL."""
        for name in ("code_file", "code_import", "code_status"):
            self._read(name).createOrReplaceTempView(name)

    def _live(self, postings: DataFrame, rows: int) -> DataFrame:
        """The ``rows`` postings with their texts, those of texts that are still there: (token, project, file_path, tf, dl)."""
        docs = self._read("code_doc")
        if rows <= BROADCAST_ROWS:
            found = docs.join(F.broadcast(postings), _TEXT)
        else:
            found = docs.filter(may_hold(postings, _TEXT, rows)(*_TEXT)).join(uncounted(postings), _TEXT)
        # A text that came twice in one change counts as one.
        return found.groupBy("token", *_FILE, "dl").agg(F.sum("tf").alias("tf"))

    def search(self, queries: list[str], limit: int, project: str | None = None, by_project: bool = False) -> DataFrame:
        """(query, project, file_path, score, rank) of the texts that hold all terms of a query, best first, for all queries in one pass.

        ``query`` is the place in the list. Only the lists of the queries' terms are read, and the names of texts. Statistics cover all
        projects; ``project`` filters what is returned. ``by_project`` counts ``limit`` by project.
        """
        asked = search.terms_of(self.spark, queries)
        tokens = sorted({t for terms in asked for t in terms})
        lists = self._read("code_token", {_token_part(t) for t in tokens}).filter(F.col("token").isin(tokens))
        postings = self._live(*durable_counted(search.listed(lists)))
        held = [self._manifest["stats"][p] for p in self._manifest["tables"].get("code_doc", {})]
        n, length = sum(h[0] for h in held), sum(h[1] for h in held)
        return search.rank_postings(durable(postings), asked, n, length / n if n else 0.0, limit, project, by_project)


class Change(View):
    """A version in the making: reads see what was changed so far, others see nothing before it is published."""

    def __init__(self, store: CodeStore, manifest: dict):
        super().__init__(store.spark, store.versions, copy.deepcopy(manifest))
        self.buckets = store.buckets

    def _part(self, name: str) -> Column:
        if name == "code_token":
            part = F.concat(F.lit("t"), F.conv(F.left(F.md5(F.col("token").cast("binary")), F.lit(6)), 16, 10).cast("int") % TOKEN_PARTS)
        else:
            project = F.left(F.md5(F.col("project").cast("binary")), F.lit(16))
            part = F.concat(project, F.lit("-"), F.pmod(F.xxhash64(_PATHS[name]), F.lit(self.buckets)))
        return part.alias("part")

    def _parts(self, name: str, *keys: DataFrame) -> set[str]:
        """Names of the parts that hold rows (project, path)."""
        found = None
        for rows in keys:
            rows = rows.toDF("project", _PATHS[name]).select(self._part(name)).distinct()
            found = rows if found is None else found.unionByName(rows)
        return {r.part for r in found.distinct().toLocalIterator()}

    def _write(self, name: str, rows: DataFrame, spread: bool = True) -> tuple[str, list[str]]:
        """Rows in a new folder; its name and the parts it has. Rows that lie by parts already need no ``spread``."""
        commit = uuid.uuid4().hex
        rows = rows.select(*_SCHEMAS[name].fieldNames(), self._part(name))
        order = ["token"] if name == "code_token" else ["project", _PATHS[name]] if spread else []
        # Rebalancing sizes the output files, splitting a part that holds much of the data.
        rows = rows.hint("rebalance", "part") if spread else rows
        rows.sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{self._versions.root}/data/{name}/{commit}")
        return commit, [n[5:] for n in self._versions.names(f"data/{name}/{commit}") if n.startswith("part=")]

    def _texts(self, commit: str, parts: list[str]) -> DataFrame:
        """The files of one folder with the block and the place that number them: the stored file and the row in it."""
        folders = [f"{self._versions.root}/data/code_file/{commit}/part={part}" for part in parts]
        rows = self.spark.read.schema(FILES).parquet(*folders).select("*", F.col("_metadata.file_path").alias("_at"), F.col("_metadata.row_index").alias("place"))
        part, name = F.substring_index(F.substring_index("_at", "/part=", -1), "/", 1), F.substring_index("_at", "/", -1)
        # Names are part-<task>-<job>.c<number>.…, so this is a file of the folder, and the folder's name makes it one of all.
        task, number = F.substring_index(F.substring_index(name, "-", 2), "-", -1), F.substring_index(F.substring_index(name, ".", 2), ".", -1)
        return rows.withColumn("block", F.concat_ws("/", F.lit(commit), part, task, number)).drop("_at")

    def _replace(self, name: str, touched: set[str], rows: DataFrame) -> None:
        if touched:
            commit, parts = self._write(name, rows)
            held = self._manifest["tables"].setdefault(name, {})
            for part in touched:
                held.pop(part, None)
            held.update({part: [commit] for part in parts})

    def _append(self, name: str, commit: str, parts: list[str]) -> None:
        for part in parts:
            self._manifest["tables"].setdefault(name, {}).setdefault(part, []).append(commit)

    def _swap(self, name: str, touched: set[str], hit: Column | None, left: DataFrame | None, *added: tuple[str, list[str]]) -> None:
        """The touched parts without their rows that ``hit`` holds for, but with ``left`` and the folders ``added``.

        The other rows are copied as they lie; they are neither joined nor moved. Without ``hit`` there are no rows yet.
        """
        held = self._manifest["tables"].setdefault(name, {})
        kept = []
        if hit is not None and any(part in held for part in touched):
            kept = [self._write(name, self._read(name, touched).filter(~hit), spread=False), self._write(name, left)]
        for part in touched:
            held.pop(part, None)
        for folder in (*kept, *added):
            self._append(name, *folder)

    def _index(self, touched: set[str], left: DataFrame, hit: Column | None, texts: DataFrame | None) -> None:
        """Bring the search index up to date: files of ``left`` (project, file_path) lose their texts, ``texts`` (block, place, file columns) come.

        Postings of texts that are gone stay until segments are merged; they meet no text.
        """
        if not touched:
            return
        kept = None if hit is None else self._read("code_doc", touched).filter(hit).join(uncounted(left), _FILE, "left_anti")
        added = []
        if texts is not None:
            self._append("code_token", *self._write("code_token", search.posting_lists(texts, "searchable"), spread=False))
            # A text without tokens has a length of 0 and no postings.
            lengths = texts.select(*_FILE, *_TEXT, search.token_count(F.col("searchable")).alias("dl"))
            added.append(self._write("code_doc", lengths, spread=False))
        self._swap("code_doc", touched, hit, kept, *added)
        counted = self._read("code_doc", touched).groupBy(self._part("code_doc")).agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
        self._manifest["stats"].update({r["part"]: [r["n"], r["dl"]] for r in counted.toLocalIterator()})  # one row per part touched
        if any(len(commits) > SEGMENTS for commits in self._manifest["tables"].get("code_token", {}).values()):
            self.merge()

    def merge(self) -> None:
        """Postings as one segment without those of texts that are gone."""
        parts = set(self._manifest["tables"].get("code_token", {}))
        live = search.listed(self._read("code_token")).join(uncounted(self._read("code_doc").select(*_TEXT)), _TEXT, "left_semi")
        self._replace("code_token", parts, search.as_lists(live))

    def upsert_files(self, new: DataFrame) -> None:
        """Written once: what else is made of the new files is read from where they are stored."""
        commit, parts = self._write("code_file", new)
        touched = set(parts)
        if not touched:
            return
        texts = self._texts(commit, parts)
        keys = texts.select(*_FILE)
        hit = left = None
        if touched & set(self._manifest["tables"].get("code_file", {})):
            hit = may_hold(keys, _FILE, keys.count())(*_FILE)
            left = changes.remove_files(self._read("code_file", touched).filter(hit), keys)
        self._swap("code_file", touched, hit, left, (commit, parts))
        self._index(touched, keys, hit, texts)

    def replace_imports(self, sources: DataFrame, edges: DataFrame) -> None:
        """Replace the edges of the re-read ``sources`` (project, source_path)."""
        touched = self._parts("code_import", sources.select("project", "source_path"))
        stamped = edges.withColumn("updated_at_epoch", epoch_ms())
        self._replace("code_import", touched, changes.replace_imports(self._read("code_import", touched), sources, stamped))

    def remove(self, gone: DataFrame) -> None:
        """Remove (project, file_path) rows and every edge at either end of them."""
        gone, rows = durable_counted(gone.select("project", "file_path").distinct())
        if rows == 0:
            return
        touched = self._parts("code_file", gone)
        # Importers of a removed file lie in the parts of their own paths.
        ends = gone.withColumnRenamed("file_path", "target_path")
        inbound = spread_join(self.imports(), ends, ["project", "target_path"], F.col("source_path"), rows, "left_semi")
        edges = self._parts("code_import", gone, inbound.select("project", "source_path"))
        hit = may_hold(gone, _FILE, rows)(*_FILE)
        left, kept = changes.remove_file(self._read("code_file", touched).filter(hit), self._read("code_import", edges), gone)
        self._swap("code_file", touched, hit, left)
        self._replace("code_import", edges, kept)
        self._index(touched, gone, hit, None)

    def save_status(self, projects: DataFrame, status: DataFrame) -> None:
        """Replace the snapshot of each project; an empty status clears it."""
        roots = projects.select("project").distinct()
        held = self.snapshots().join(roots, "project", "left_semi").select("project", "path")
        touched = self._parts("code_status", held, status.select("project", "path"))
        kept = self._read("code_status", touched).join(roots, "project", "left_anti")
        rows = status.select("project", "path", "code", epoch_ms().alias("updated_at_epoch"))
        self._replace("code_status", touched, kept.unionByName(rows.select(*SNAPSHOTS.fieldNames())))


class CodeStore:
    """Reads and maintains the tables at one place.

    A change rewrites only the parts that hold its rows, into new folders, and becomes visible for
    all tables at once when its version is published; a reader that holds a ``view`` goes on with the version it
    began with. Of two writers that began with one version the second gets a ``Conflict``. One
    bucket suits many small projects; raise ``buckets`` when a single project holds much of the data, so that a small
    change stays a small rewrite. The number is stored; asking for another one is an error.
    """

    def __init__(self, spark: SparkSession, database: str = "codeloom", location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.location = location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{database}.db"
        self.versions = Versions(spark, self.location)
        first = self.versions.latest()
        if None not in (first, buckets) and first["buckets"] != buckets:
            raise ValueError(f"{self.location} has {first['buckets']} buckets, not {buckets}")
        self.buckets = first["buckets"] if first else buckets or 1
        if first is None:
            self.versions.publish({"number": 0, "buckets": self.buckets, "tables": {}, "stats": {}})

    def view(self, version: int | None = None) -> View:
        return View(self.spark, self.versions, self.versions.latest() if version is None else self.versions.read(version))

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Changes of any tables that are published together at the end, or not at all."""
        change = Change(self, self.versions.latest())
        before = copy.deepcopy(change._manifest)
        yield change
        if change._manifest != before:
            change._manifest["number"] += 1
            self.versions.publish(change._manifest)

    def files(self, project: str | None = None) -> DataFrame:
        return self.view().files(project)

    def imports(self, project: str | None = None) -> DataFrame:
        return self.view().imports(project)

    def snapshots(self, project: str | None = None) -> DataFrame:
        return self.view().snapshots(project)

    def upsert_files(self, new: DataFrame) -> None:
        with self.change() as change:
            change.upsert_files(new)

    def replace_imports(self, sources: DataFrame, edges: DataFrame) -> None:
        with self.change() as change:
            change.replace_imports(sources, edges)

    def remove(self, gone: DataFrame) -> None:
        with self.change() as change:
            change.remove(gone)

    def save_status(self, projects: DataFrame, status: DataFrame) -> None:
        with self.change() as change:
            change.save_status(projects, status)

    def sweep(self, keep: int = 2) -> None:
        self.versions.sweep(keep)
