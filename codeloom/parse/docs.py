"""Documentation comments, read from the trivia in front of a statement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.text import trim_ws


def lines_above(gap: Column, at_file_start: Column) -> Column:
    """Whole trimmed lines between the previous token and the statement, nearest first."""
    parts = F.transform(F.split(gap, "\n"), trim_ws)
    # The last part is the statement's own indent; the first shares a line with the
    # previous token unless the file begins here.
    first = F.when(at_file_start, F.lit(1)).otherwise(F.lit(2))
    n = F.greatest(F.size(parts) - first, F.lit(0))
    return F.reverse(F.slice(parts, first, n))


def _take(lines: Column, n: Column) -> Column:
    return F.slice(lines, F.lit(1), n)


def _first(flags: Column, missing: Column) -> Column:
    at = F.array_position(flags, True).cast("int")
    return F.when(at == 0, missing).otherwise(at)


def _join(lines_bottom_up: Column) -> Column:
    kept = F.filter(F.reverse(lines_bottom_up), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def slash_doc(lines: Column) -> Column:
    """JS and Rust: contiguous comment lines; a line opening a doc block ends the scan."""
    none = F.size(lines)
    refused = F.transform(lines, lambda x: ~x.rlike(r"^(/\*\*|\* |\*/|\*$|//)"))
    opened = F.transform(lines, lambda x: F.startswith(x, F.lit("/**")))
    n = F.least(_first(refused, none + 1) - 1, _first(opened, none))
    marks = r"^(?:/\*\*)*\s*(?:\*/)*\s*(?:\* )*\**\s*(?:/// )*(?:///)*(?:// )*(?://)*"
    return _join(F.transform(_take(lines, n), lambda x: trim_ws(F.regexp_replace(x, marks, ""))))


def hash_doc(lines: Column) -> Column:
    """Contiguous '#' lines."""
    refused = F.transform(lines, lambda x: ~F.startswith(x, F.lit("#")))
    n = _first(refused, F.size(lines) + 1) - 1
    return _join(F.transform(_take(lines, n), lambda x: F.regexp_replace(x, r"^#+\s*", "")))


def after_blanks(lines: Column) -> Column:
    """``lines`` from the nearest non-blank one on."""
    at = _first(F.transform(lines, lambda x: x != ""), F.size(lines) + 1)
    return F.slice(lines, at, F.size(lines))
