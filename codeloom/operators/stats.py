"""Counts over files, edges and symbols. Every group is pre-aggregated before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import symbols as S
from codeloom.session import placed


def file_count(files: DataFrame, project: str) -> DataFrame:
    """One row, 0 for a project that was never indexed."""
    return files.filter(F.col("project") == project).agg(F.count("*").alias("total_files"))


def import_count(imports: DataFrame, project: str) -> DataFrame:
    return imports.filter(F.col("project") == project).agg(F.count("*").alias("total_import_edges"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("project", "language").agg(F.count("*").alias("n_files"))


def project_overview(files: DataFrame) -> DataFrame:
    return files.groupBy("project").agg(F.count("*").alias("n_files"))


def edge_counts(imports: DataFrame) -> DataFrame:
    return imports.groupBy("project").agg(F.count("*").alias("n_edges"))


def project_stats(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row per project: total files, total edges and a language → count map.

    The map holds one entry per indexed language, so its group is at most six rows.
    """
    per_language = language_counts(files)
    totals = per_language.groupBy("project").agg(
        F.sum("n_files").alias("total_files"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n_files")))).alias("languages"),
    )
    edges = edge_counts(imports)
    return totals.join(edges, "project", "full_outer").select(
        "project",
        F.coalesce("total_files", F.lit(0)).alias("total_files"),
        F.coalesce("n_edges", F.lit(0)).alias("total_import_edges"),
        F.coalesce("languages", F.create_map().cast("map<string,bigint>")).alias("languages"),
    )


def fan_in(imports: DataFrame, rows: int | None = None) -> DataFrame:
    """Edge rows per target, plus how many different files those rows come from.

    The two-level grouping turns a hot target into one row per importer per task before
    anything is shuffled on the target alone. ``rows``, if known, is the number of edges; they are
    then placed by importer and target, so that no task groups more than its share.
    """
    pair = ["project", "target_path", "source_path"]
    per_pair = placed(imports.select(pair), rows, *pair).groupBy(*pair).agg(F.count("*").alias("n"))
    return per_pair.groupBy("project", "target_path").agg(
        F.sum("n").alias("fan_in"), F.count("*").alias("distinct_importers")
    )


def degree(imports: DataFrame, end: str, name: str) -> DataFrame:
    """Edge rows per file, counted on its ``source_path`` or ``target_path`` end."""
    return imports.groupBy("project", F.col(end).alias("file_path")).agg(F.count("*").alias(name))


def symbol_report(files: DataFrame) -> DataFrame:
    """Per file: total, public and documented symbols and the none-documented flag."""
    symbols = F.col("symbols")
    return files.select(
        "project",
        "file_path",
        S.total(symbols).alias("n_symbols"),
        S.public_count(symbols).alias("n_public"),
        S.documented_count(symbols).alias("n_documented"),
        (S.total(symbols) - S.documented_count(symbols)).alias("n_undocumented"),
        S.all_undocumented(symbols).alias("none_documented"),
    )
