"""Version-control output: running the command per project, and reading its text."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import is_supported

STATUS = ("status", "--porcelain=v1")
NUMSTAT = ("diff", "--numstat", "HEAD")
_BATCH = 5_000


def command_lines(projects: DataFrame, arguments: tuple[str, ...]) -> DataFrame:
    """(project, line) printed by git in each project; a failing command prints nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project in batch["project"]:
                try:
                    done = subprocess.run(["git", *arguments], cwd=project, capture_output=True, check=True)
                except (OSError, subprocess.CalledProcessError):
                    continue
                lines = done.stdout.decode("utf-8", "replace").splitlines()
                for k in range(0, len(lines), _BATCH):
                    yield pd.DataFrame({"project": project, "line": lines[k : k + _BATCH]})

    return projects.select("project").distinct().mapInPandas(run, "project string, line string")


def parse_status(lines: DataFrame) -> DataFrame:
    """(project, path, code) of porcelain lines.

    The code is the first two characters, trimmed; the path is the project joined with all
    that follows column three, so a rename keeps its 'old -> new' form and names no file.
    Unsupported extensions and lines shorter than four bytes are dropped.
    """
    rest = F.expr("substring(line, 4)")
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat("project", F.lit("/"), rest))
    return (
        lines.filter(F.octet_length("line") >= 4)
        .select("project", path.alias("path"), F.trim(F.substring("line", 1, 2)).alias("code"))
        .filter(is_supported(F.col("path")))
    )


def split_renames(status: DataFrame) -> DataFrame:
    """Optional reading of rename rows: the old path deleted, the new path added."""
    is_rename = F.contains("path", F.lit(" -> "))
    old = F.substring_index("path", " -> ", 1)
    new = F.concat("project", F.lit("/"), F.substring_index("path", " -> ", -1))
    both = F.array(F.struct(old.alias("path"), F.lit("D").alias("code")), F.struct(new.alias("path"), F.lit("A").alias("code")))
    single = F.array(F.struct(F.col("path").alias("path"), F.col("code").alias("code")))
    return status.select("project", F.inline(F.when(is_rename, both).otherwise(single)))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(project, added, removed, file) of numstat lines; binary files ('-') are dropped."""
    parts = F.split("line", "\t")
    return (
        lines.withColumn("parts", parts)
        .filter((F.size("parts") >= 3) & (F.get("parts", F.lit(0)) != "-"))
        .select("project", *[F.get("parts", F.lit(k)).alias(n) for k, n in enumerate(("added", "removed", "file"))])
    )
