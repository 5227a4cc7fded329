"""From source text to the files and imports tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import symbols as S
from codeloom.functions.paths import language_of
from codeloom.functions.text import content_hash, epoch_ms
from codeloom.parse import elixir, ruby, rust, script
from codeloom.parse.lexing import FILE

_EXTRACTORS = {
    ("typescript", "tsx", "javascript"): script.extract,
    ("rust",): rust.extract,
    ("ruby",): ruby.extract,
    ("elixir",): elixir.extract,
}


def parse_statements(sources: DataFrame) -> DataFrame:
    """(project, file_path, ord, symbols, imports) per statement of every supported file."""
    readable = sources.filter(F.col("content").isNotNull()).withColumn("language", language_of(F.col("file_path")))
    parts = [
        extract(readable.filter(F.col("language").isin(*languages)))
        for languages, extract in _EXTRACTORS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def parse_files(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, raw imports) of (project, file_path, content) rows.

    ``files`` has one row per readable supported source, also when it declares nothing.
    Contents that are NULL (unreadable or not UTF-8) are left out. Both results read the
    same statement rows; store the parse first when both are needed (see ``index``).
    """
    return split_parse(sources, parse_statements(sources))


def split_parse(sources: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    # A group is one file's symbols, bounded by that file's own text.
    per_file = parsed.filter(F.size("symbols") > 0).groupBy(*FILE).agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("ord", "symbols"))), lambda s: s["symbols"])
        ).alias("symbols")
    )
    known = sources.filter(F.col("content").isNotNull()).select(
        *FILE,
        language_of(F.col("file_path")).alias("language"),
        content_hash(F.col("content")).alias("content_hash"),
    ).filter(F.col("language").isNotNull())
    symbols = F.coalesce("symbols", S.none())
    files = known.join(per_file, FILE, "left").select(
        *FILE,
        "language",
        symbols.alias("symbols"),
        S.names(symbols).alias("symbol_names"),
        S.searchable(F.col("file_path"), symbols).alias("searchable"),
        "content_hash",
        epoch_ms().alias("last_parsed_epoch"),
    )
    raw = parsed.select("project", F.col("file_path").alias("source_path"), F.inline("imports")).select(
        "project", "source_path", "specifier", "kind", "symbols", "ord"
    )
    return files, raw
