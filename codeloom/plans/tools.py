"""The tool surface: one method per tool, each returning a DataFrame in its result shape.

Empty results are empty DataFrames; ``MESSAGES`` holds the text to show for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import relative_path
from codeloom.operators import cycles, detail, graph, stats
from codeloom.operators.resolve import on_disk
from codeloom.plans import index
from codeloom.schema import DEFAULT_MAX_DEPTH, DEFAULT_MAX_RESULTS, DEFAULT_SEARCH_LIMIT, ENTRY_SEARCH_LIMIT
from codeloom.session import durable
from codeloom.sources import rules
from codeloom.sources.listing import read_sources
from codeloom.sources.store import CodeStore

MESSAGES = {
    "query": "No file of the index matches the entry points.",
    "search": "No file of the index matches the search.",
    "find_cycles": "The import graph has no circular dependencies.",
    "get_file_info": "The file is not in the index.",
    "detect_changes": "Nothing has changed.",
    "rules": "The project has no rules files.",
}


def _relative(path: str = "file_path") -> Column:
    return relative_path(F.col(path), F.col("project"))


def _camel(symbols: str = "symbols") -> Column:
    return F.transform(
        symbols,
        lambda s: F.struct(
            s["name"].alias("name"), s["kind"].alias("kind"), s["signature"].alias("signature"),
            s["doc_comment"].alias("docComment"), s["visibility"].alias("visibility"), s["line"].alias("line"),
        ),
    )


def pretty_json(df: DataFrame) -> DataFrame:
    """Each row as indented JSON text."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


class Toolbox:
    """Tools over a store; without one only parsing, rules and paths are available."""

    def __init__(self, spark: SparkSession, store: CodeStore | None = None):
        self.spark, self.store = spark, store

    def _need_store(self) -> CodeStore:
        if self.store is None:
            raise RuntimeError("This tool reads the stored index, which parse-only mode does not have.")
        return self.store

    def parse_file(self, project: str, file_path: str) -> DataFrame:
        """Parse one file, store it when there is a store, and return its symbols and imports."""
        paths = self.spark.createDataFrame([(project, file_path)], "project string, file_path string")
        files, edges = map(durable, index.parse_sources(durable(read_sources(paths)), on_disk))
        if self.store is not None:  # what is stored is what is returned
            index.store_parsed(self.store, files.filter(F.col("content_hash").isNotNull()), edges)
        imports = edges.groupBy("project", F.col("source_path").alias("file_path")).agg(
            F.array_sort(F.collect_list(F.struct("ord", "target_path", "specifier", "symbols"))).alias("imports")
        )
        return files.join(imports, ["project", "file_path"], "left").select(
            F.col("file_path").alias("filePath"),
            "language",
            F.coalesce(
                F.transform(
                    "imports",
                    lambda i: F.struct(
                        i["target_path"].alias("target"), i["specifier"].alias("specifier"), i["symbols"].alias("symbols")
                    ),
                ),
                F.array().cast("array<struct<target:string,specifier:string,symbols:array<string>>>"),
            ).alias("imports"),
            _camel().alias("symbols"),
        )

    def index_project(self, project: str) -> DataFrame:
        """(project, indexed, skipped); stores the graph unless in parse-only mode."""
        if self.store is None:
            return index.parse_only(self.spark, [project])
        return index.full_index(self.store, [project])

    def detect_changes(self, project: str) -> tuple[DataFrame, DataFrame]:
        """Changed paths (project, path, change) and counts (project, indexed, removed)."""
        return index.detect_changes(self.store, self.spark, [project])

    def query(
        self,
        project: str,
        entry_points: list[str],
        max_depth: int | None = None,
        max_results: int | None = None,
    ) -> DataFrame:
        """Walk the import graph from paths or search terms: path, reason, depth, symbols."""
        store = self._need_store()
        depth = DEFAULT_MAX_DEPTH if max_depth is None else max_depth
        results = DEFAULT_MAX_RESULTS if max_results is None else max_results
        view = store.view()
        paths = [(k, e) for k, e in enumerate(entry_points) if e.startswith("/")]
        asked = [k for k, e in enumerate(entry_points) if not e.startswith("/")]
        rows = [("walk", project, path, k * 100) for k, path in paths]
        entries = self.spark.createDataFrame(rows, "walk string, project string, path string, ord bigint")
        if asked:
            found = view.search([entry_points[k] for k in asked], ENTRY_SEARCH_LIMIT, project)
            place = F.element_at(F.array(*[F.lit(k * 100) for k in asked]), F.col("query") + 1)
            entries = entries.unionByName(
                found.select(F.lit("walk").alias("walk"), "project", F.col("file_path").alias("path"), (place + F.col("rank")).cast("bigint").alias("ord"))
            )
        walked = graph.walk_many(view.imports(project), entries, depth, results)
        return graph.attach_symbols(walked, view.files(project)).orderBy("pos").select(
            _relative().alias("path"), "reason", "depth", _camel().alias("symbols")
        )

    def search(self, project: str, query: str, limit: int = DEFAULT_SEARCH_LIMIT) -> DataFrame:
        view = self._need_store().view()
        hits = view.search([query], limit, project)
        files = view.files(project).select("project", "file_path", "symbols")
        return (
            files.join(hits, ["project", "file_path"])
            .orderBy(F.desc("score"), "file_path")
            .select(F.col("file_path").alias("filePath"), _relative().alias("relativePath"), _camel().alias("symbols"))
        )

    def stats(self, project: str) -> DataFrame:
        store = self._need_store()
        view = store.view()
        counted = stats.project_stats(view.files(project), view.imports(project))
        root = self.spark.createDataFrame([(project,)], "project string")
        return root.join(counted, "project", "left").select(
            F.coalesce("total_files", F.lit(0)).alias("totalFiles"),
            F.coalesce("total_import_edges", F.lit(0)).alias("totalImportEdges"),
            F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("languages"),
        )

    def get_file_info(self, project: str, file_path: str) -> DataFrame:
        """One row, none if the file is unknown."""
        store = self._need_store()
        view = store.view()
        keys = detail.distinct_keys(self.spark.createDataFrame([(project, file_path)], "project string, file_path string"))
        found = detail.detail_of(view.files(project), view.imports(project), keys)
        return found.select(
            F.col("file_path").alias("filePath"),
            _relative().alias("relativePath"),
            "language",
            _camel().alias("symbols"),
            F.transform("imports", lambda i: F.struct(i["path"].alias("target"), i["symbols"].alias("symbols"))).alias("imports"),
            F.transform("dependents", lambda i: F.struct(i["path"].alias("source"), i["symbols"].alias("symbols"))).alias("dependents"),
        )

    def find_cycles(self, project: str) -> DataFrame:
        store = self._need_store()
        found = cycles.find_cycles(store.imports(project))
        return cycles.relative_cycles(found).select("cycle", "length")

    def rules(self, project: str | None = None) -> DataFrame:
        """Rules files in reading order; their ``block`` texts in a row are the tool's output."""
        root = rules.checked_root(project)
        roots = self.spark.createDataFrame([(root,)], "project string")
        return rules.rules(roots).orderBy("ord").select("path", "content", "block")

    def project_path(self) -> str:
        return rules.project_path()

    def json(self, result: DataFrame) -> DataFrame:
        """A tool's result in the form it is answered in: one indented JSON text per row."""
        return pretty_json(result)

    def overview(self) -> DataFrame:
        """All indexed projects with their file counts."""
        return stats.project_overview(self._need_store().files()).withColumnRenamed("n_files", "count")
