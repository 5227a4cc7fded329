"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schema import LANGUAGE_BY_EXTENSION


def extension(path: Column) -> Column:
    """Last extension without its dot; '' for none (a bare dotfile has none)."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def is_supported(path: Column) -> Column:
    return extension(path).isin(*LANGUAGE_BY_EXTENSION)


def language_of(path: Column) -> Column:
    """Language of a path, NULL when the extension is not indexed."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(table, extension(path))


def relative_path(path: Column, project: Column) -> Column:
    """Cut the project string off the front (no path-boundary check), then leading slashes."""
    rest = F.when(F.startswith(path, project), F.substring(path, F.length(project) + 1, F.length(path))).otherwise(path)
    return F.regexp_replace(rest, "^/+", "")


def absolute_path(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path))


def parent(path: Column) -> Column:
    """Directory of an absolute path, '' for entries of the root."""
    return F.regexp_replace(path, "/[^/]*$", "")


def is_relative_import(specifier: Column) -> Column:
    return specifier.rlike(r"^\.\.?/")


def normalize_path(path: Column) -> Column:
    """Fold '.' and '..'. A '..' above the root drops the root, leaving a relative path."""
    start = F.when(F.startswith(path, F.lit("/")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def step(done: Column, part: Column) -> Column:
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(part.isin("", "."), done).when(part == "..", popped).otherwise(F.array_append(done, part))
        )

    parts = F.aggregate(F.split(path, "/"), start, step)
    root_only = (F.size(parts) == 1) & (F.element_at(parts, 1) == "")
    return F.when(F.size(parts) == 0, F.lit("")).when(root_only, F.lit("/")).otherwise(F.array_join(parts, "/"))


def to_snake_case(name: Column) -> Column:
    """Underscore before every upper-case letter but the first, then lower case."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{Lu})", "_$1"))


def append_extension(path: Column, ext: str) -> Column:
    return F.concat(path, F.lit(ext))
