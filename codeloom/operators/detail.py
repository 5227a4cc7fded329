"""File detail: symbols, imports and dependents of files, one row per file.

Lists are built for files that are asked about. Whoever needs only a number of dependents,
or the first few, takes ``degree`` and ``first_neighbours``: those never gather a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import symbols as S
from codeloom.operators.stats import degree
from codeloom.session import durable_counted, may_hold, spread_join

_EMPTY_LIST = "array<struct<path:string,symbols:array<string>>>"


def neighbour_lists(imports: DataFrame, near: str, far: str) -> DataFrame:
    """(project, file_path, total, items): the ``far`` ends of each file's edges, by path."""
    edges = imports.select("project", F.col(near).alias("file_path"), F.col(far).alias("path"), "symbols", "specifier")
    lists = edges.groupBy("project", "file_path").agg(
        F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct("path", "specifier", "symbols"))).alias("items")
    )
    return lists.withColumn(
        "items", F.transform("items", lambda i: F.struct(i["path"].alias("path"), i["symbols"].alias("symbols")))
    )


def _with_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    outgoing = neighbour_lists(imports, "source_path", "target_path").select(
        "project", "file_path", F.col("items").alias("imports"), F.col("total").alias("n_imports")
    )
    known = files.select("project", "file_path", "language", F.coalesce("symbols", S.none()).alias("symbols"))
    return (
        known.join(outgoing, ["project", "file_path"], "left")
        .withColumn("imports", F.coalesce("imports", F.array().cast(_EMPTY_LIST)))
        .fillna(0, ["n_imports"])
    )


def file_detail(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, file_path, language, symbols, imports, n_imports, dependents, n_dependents).

    Only indexed files appear; edges of unknown files are not reported. Restrict ``files``
    (and with it the edges, see ``detail_of``) to ask about single files.
    """
    return _with_dependents(_with_imports(files, imports), imports)


def _with_dependents(known: DataFrame, imports: DataFrame) -> DataFrame:
    incoming = neighbour_lists(imports, "target_path", "source_path").select(
        "project", "file_path", F.col("items").alias("dependents"), F.col("total").alias("n_dependents")
    )
    return (
        known.join(incoming, ["project", "file_path"], "left")
        .withColumn("dependents", F.coalesce("dependents", F.array().cast(_EMPTY_LIST)))
        .fillna(0, ["n_dependents"])
    )


def distinct_keys(wanted: DataFrame) -> tuple[DataFrame, int]:
    """The wanted (project, file_path) rows, stored and counted for use in several joins."""
    return durable_counted(wanted.select("project", "file_path").distinct())


def edges_of(imports: DataFrame, keys: tuple[DataFrame, int], near: str) -> DataFrame:
    """Whole edge rows whose ``near`` end is among ``distinct_keys``."""
    far = "source_path" if near == "target_path" else "target_path"
    ends = keys[0].withColumnRenamed("file_path", near)
    return spread_join(imports, ends, ["project", near], F.col(far), keys[1])


def edges_near(imports: DataFrame, keys: tuple[DataFrame, int]) -> DataFrame:
    """The edges with an end among ``distinct_keys``, and few others: what lists of these files can be made of, without the rest."""
    test = may_hold(keys[0], ["project", "file_path"], keys[1])
    return imports.filter(test(F.col("project"), F.col("source_path")) | test(F.col("project"), F.col("target_path")))


def detail_of(files: DataFrame, imports: DataFrame, keys: tuple[DataFrame, int]) -> DataFrame:
    """``file_detail`` of the ``distinct_keys``, reading only their edges."""
    chosen = spread_join(files, keys[0], ["project", "file_path"], F.col("file_path"), keys[1])
    return _with_dependents(_with_imports(chosen, edges_of(imports, keys, "source_path")), edges_of(imports, keys, "target_path"))


def outline_of(files: DataFrame, imports: DataFrame, keys: tuple[DataFrame, int], cap: int) -> DataFrame:
    """The ``distinct_keys`` with their imports, the number of dependents and the first ``cap`` of them by path.

    Result: (project, file_path, language, symbols, imports, n_imports, n_dependents, first_dependents).
    """
    chosen = spread_join(files, keys[0], ["project", "file_path"], F.col("file_path"), keys[1])
    incoming = edges_of(imports, keys, "target_path")
    few = first_neighbours(incoming, "target_path", "source_path", cap, "first_dependents")
    return (
        _with_imports(chosen, edges_of(imports, keys, "source_path"))
        .join(degree(incoming, "target_path", "n_dependents"), ["project", "file_path"], "left")
        .fillna(0, ["n_dependents"])
        .join(few, ["project", "file_path"], "left")
    )


def first_neighbours(imports: DataFrame, near: str, far: str, cap: int, name: str) -> DataFrame:
    """The first ``cap`` neighbours of each file by path, as a bounded array column ``name``."""
    order = Window.partitionBy("project", "file_path").orderBy("path", "specifier")
    return (
        imports.select("project", F.col(near).alias("file_path"), F.col(far).alias("path"), "specifier")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= cap)
        .groupBy("project", "file_path")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda i: i["path"]).alias(name))
    )


def file_summary(files: DataFrame, imports: DataFrame) -> DataFrame:
    """One row per indexed file: symbol, import and dependent counts (no lists)."""
    return (
        files.select("project", "file_path", "language", S.total(F.col("symbols")).alias("n_symbols"))
        .join(degree(imports, "source_path", "n_imports"), ["project", "file_path"], "left")
        .join(degree(imports, "target_path", "n_dependents"), ["project", "file_path"], "left")
        .fillna(0, ["n_imports", "n_dependents"])
    )
