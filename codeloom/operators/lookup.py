"""Point lookups and suffix matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import symbols as S
from codeloom.schema import SUFFIX_LIMIT
from codeloom.session import BROADCAST_ROWS, durable_counted, may_hold, spread_join

# Longest literal tail of a suffix used as an equi-join key.
_TAIL = 24
# Letters of a literal run that stand for a suffix without a tail.
_GRAM = 3


def _neighbours(imports: DataFrame, wanted: DataFrame, near: str, far: str) -> DataFrame:
    keys, n = durable_counted(wanted.select("project", F.col("file_path").alias(near)).distinct())
    return spread_join(imports.select("project", near, far), keys, ["project", near], F.col(far), n)


def imports_from(imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edge rows leaving the wanted (project, file_path) rows: project, source_path, target_path."""
    return _neighbours(imports, wanted, "source_path", "target_path")


def importers_of(imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edge rows entering the wanted (project, file_path) rows: project, target_path, source_path."""
    return _neighbours(imports, wanted, "target_path", "source_path")


def file_symbols(files: DataFrame, project: str, file_path: str) -> DataFrame:
    """One row; an unknown file has no symbols."""
    row = files.filter((F.col("project") == project) & (F.col("file_path") == file_path))
    return row.agg(F.coalesce(F.first("symbols", ignorenulls=True), S.none()).alias("symbols"))


def file_hash(files: DataFrame, project: str, file_path: str) -> DataFrame:
    hit = (F.col("project") == project) & (F.col("file_path") == file_path)
    return files.filter(hit).select("content_hash").limit(1)


def suffix_matches(files: DataFrame, suffixes: DataFrame, limit: int = SUFFIX_LIMIT) -> DataFrame:
    """For each (project, suffix), the first ``limit`` paths LIKE '%' || suffix, by path.

    '_' and '%' inside a suffix stay wildcards. The match is an equi-join: both sides are
    keyed by the literal tail behind the suffix's last wildcard, and only the tail lengths
    that occur among the suffixes are cut from each path; LIKE then decides. A suffix that ends
    in a wildcard is keyed by the first ``_GRAM`` letters of its longest literal run, and paths
    by all that they hold of that length; only one without such a run meets all paths.
    """
    wanted = suffixes.select("project", "suffix").distinct()
    tail = F.right(F.regexp_extract("suffix", "[^%_]*$", 0), F.lit(_TAIL))
    run = F.array_max(F.transform(F.split("suffix", r"[%_\\]"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    by_gram = (tail == "") & (F.length(run) >= _GRAM)
    keyed, n = durable_counted(
        wanted.withColumns({
            "tail": F.when(by_gram, F.left(run, F.lit(_GRAM))).otherwise(tail),
            "tail_len": F.when(by_gram, -1).otherwise(F.length(tail)),
        })
    )
    # At most _TAIL + 2 different lengths exist.
    lengths = sorted(r.tail_len for r in keyed.select("tail_len").distinct().collect())
    kinds = [F.lit(n) for n in lengths if n >= 0] or [F.lit(0)]
    keys = F.transform(F.array(*kinds), lambda n: F.struct(n.alias("tail_len"), F.col("file_path").substr(F.length("file_path") - n + 1, n).alias("tail")))
    keys = F.filter(keys, lambda k: k["tail_len"] <= F.length("file_path"))
    if -1 in lengths:
        starts = F.sequence(F.lit(1), F.greatest(F.length("file_path") - _GRAM + 1, F.lit(1)))
        grams = F.array_distinct(F.transform(starts, lambda i: F.col("file_path").substr(i, F.lit(_GRAM))))
        keys = F.concat(keys, F.transform(grams, lambda g: F.struct(F.lit(-1).alias("tail_len"), g.alias("tail"))))
    paths = files.select("project", "file_path", F.inline(keys))
    if n > BROADCAST_ROWS:
        # Hardly any end of a path is a suffix: the others are neither counted nor moved.
        key = ["project", "tail_len", "tail"]
        paths = paths.filter(may_hold(keyed, key, n)(*map(F.col, key)))
    hits = spread_join(paths, keyed, ["project", "tail_len", "tail"], F.col("file_path"), n).filter(
        F.expr("file_path LIKE concat('%', suffix)")
    )
    first = Window.partitionBy("project", "suffix").orderBy("file_path")
    return (
        hits.withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= limit)
        .select("project", "suffix", "file_path", F.col("rank").cast("bigint").alias("rank"))
    )
