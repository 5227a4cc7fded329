"""Context texts about files, for editors and assistants.

Each view is a DataFrame (project, file_path, context) with one row per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import symbols as S
from codeloom.functions.paths import absolute_path, relative_path
from codeloom.functions.text import capped_list, file_mentions
from codeloom.operators.detail import detail_of, distinct_keys, edges_near, edges_of, outline_of
from codeloom.operators.lookup import suffix_matches
from codeloom.operators.stats import degree
from codeloom.schema import COMPACT_LIST_CAP, HIGH_FAN_IN, TOOL_LIST_CAP
from codeloom.session import durable, spread_join, uncounted

_KEY = ["project", "file_path"]


def _names(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: relative_path(i["path"], F.col("project"))), ", ")


def _short(paths: Column) -> Column:
    return F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: relative_path(p, F.col("project")))


def _wide_impact() -> Column:
    n = F.col("n_dependents")
    return F.when(
        n > HIGH_FAN_IN, F.concat(F.lit("Careful: "), n.cast("string"), F.lit(" files depend on this one"))
    )


def _has_anything() -> Column:
    return (F.col("n_imports") > 0) | (F.col("n_dependents") > 0) | (F.size("symbols") > 0)


def prompt_context(files: DataFrame, imports: DataFrame, prompts: DataFrame) -> DataFrame:
    """Facts about files mentioned in prompts: (prompt_id, project, file_path, context).

    ``prompts`` is (prompt_id, project, prompt). A mention names up to three files by path
    suffix. Files without imports, dependents and symbols are left out.
    """
    mentions = prompts.select(
        "prompt_id", "project", F.explode(file_mentions(F.col("prompt"))).alias("suffix")
    )
    # Stored: the files are matched once, for the details and for the prompts.
    matched = durable(suffix_matches(files, mentions).drop("rank"))
    keys = distinct_keys(matched)
    # Of the edges only those near the files are stored, to be read from both ends.
    text = _prompt_texts(detail_of(files, durable(edges_near(imports, keys)), keys))
    return (
        mentions.join(matched, ["project", "suffix"])
        .select("prompt_id", "project", "file_path")
        .distinct()
        .join(text, _KEY)
        .select("prompt_id", "project", "file_path", "context")
    )


def _prompt_texts(detail: DataFrame) -> DataFrame:
    symbols = F.col("symbols")
    context = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), relative_path(F.col("file_path"), F.col("project"))),
        _wide_impact(),
        F.when(
            S.all_undocumented(symbols),
            F.concat(F.lit("Undocumented: all "), F.size(symbols).cast("string"), F.lit(" symbols")),
        ),
        F.when(F.size("imports") > 0, F.concat(F.lit("Imports: "), _names(F.col("imports")))),
        F.when(F.size("dependents") > 0, F.concat(F.lit("Used by: "), _names(F.col("dependents")))),
    )
    return detail.filter(_has_anything()).select(*_KEY, context.alias("context"))


def tool_context(files: DataFrame, imports: DataFrame, touched: DataFrame, action: str) -> DataFrame:
    """Facts shown before ``action`` ('Reading' or 'Editing') on the touched (project, file_path) rows.

    Dependents are listed up to eight; a file with symbols only has nothing to show.
    """
    detail = outline_of(files, imports, distinct_keys(touched), TOOL_LIST_CAP)
    n = F.col("n_dependents")
    context = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.lit(action), F.lit(" "), relative_path(F.col("file_path"), F.col("project"))),
        F.coalesce(_wide_impact(), F.when(n > 0, F.concat(F.lit("Dependents: "), n.cast("string")))),
        F.when(F.size("imports") > 0, F.concat(F.lit("Imports: "), _names(F.col("imports")))),
        F.when(
            n > 0, F.concat(F.lit("Used by: "), capped_list(_short(F.col("first_dependents")), n, TOOL_LIST_CAP))
        ),
    )
    return detail.filter((F.col("n_imports") > 0) | (n > 0)).select(*_KEY, context.alias("context"))


def post_edit_lines(imports: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """One line per changed file with its dependent count.

    ``changed`` is (project, added, removed, file) with ``file`` relative or absolute.
    Dependents count only for indexed files.
    """
    located = changed.withColumn("file_path", absolute_path(F.col("file"), F.col("project")))
    keys = distinct_keys(located)
    indexed = spread_join(files.select(*_KEY), keys[0], _KEY, F.col("file_path"), keys[1], "left_semi")
    known = degree(edges_of(imports, keys, "target_path"), "target_path", "n").join(uncounted(indexed), _KEY, "left_semi")
    n = F.coalesce(F.col("n"), F.lit(0))
    line = F.concat(
        F.format_string("- %s (+%s/-%s)", "file", "added", "removed"),
        F.when(n > 0, F.format_string(", %d dependents", n)).otherwise(""),
    )
    return located.join(uncounted(known), _KEY, "left").select(*_KEY, n.alias("n_dependents"), line.alias("line"))


def compact_context(files: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """Short structural summary of changed files, kept across a conversation reset."""
    located = changed.withColumn("file_path", absolute_path(F.col("file"), F.col("project")))
    detail = outline_of(files, imports, distinct_keys(located), COMPACT_LIST_CAP)
    n, symbols = F.col("n_dependents"), F.col("symbols")
    context = F.concat_ws(
        "\n",
        F.format_string("### %s (+%s/-%s)", relative_path(F.col("file_path"), F.col("project")), "added", "removed"),
        F.when(
            n > 0,
            F.concat(
                F.format_string("Dependents (%d): ", n), capped_list(_short(F.col("first_dependents")), n, COMPACT_LIST_CAP)
            ),
        ),
        F.when(F.size("imports") > 0, F.concat(F.lit("Imports: "), _names(F.col("imports")))),
        F.when(
            F.size(symbols) > 0,
            F.format_string("Symbols: %d total, %d public", S.total(symbols), S.public_count(symbols)),
        ),
    )
    return detail.join(located.select(*_KEY, "added", "removed"), _KEY).select(*_KEY, context.alias("context"))


def session_context(files: DataFrame, imports: DataFrame, projects: DataFrame) -> DataFrame:
    """Index status of each project (project): counts, or a hint to index it first."""
    n_files = files.groupBy("project").agg(F.count("*").alias("n_files"))
    n_edges = imports.groupBy("project").agg(F.count("*").alias("n_edges"))
    joined = projects.select("project").join(n_files, "project", "left").join(n_edges, "project", "left")
    text = F.when(
        F.coalesce("n_files", F.lit(0)) == 0,
        F.concat(F.lit("Not indexed yet: "), F.col("project"), F.lit(". Index the project first.")),
    ).otherwise(
        F.format_string(
            "Project: %s\nFiles indexed: %d\nImport edges: %d", "project", "n_files", F.coalesce("n_edges", F.lit(0))
        )
    )
    return joined.select("project", text.alias("context"))

