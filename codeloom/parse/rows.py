"""Row shapes produced by the extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schema import SYMBOL

# A written import before resolution: what it names, how to resolve it, what it binds.
RAW_IMPORT = "struct<specifier:string,kind:string,symbols:array<string>,ord:bigint>"


def symbol_row(name: Column, kind: Column, signature: Column, doc: Column, visibility: Column, line: Column) -> Column:
    return F.struct(
        name.alias("name"),
        kind.alias("kind"),
        signature.alias("signature"),
        doc.cast("string").alias("doc_comment"),
        visibility.alias("visibility"),
        line.cast("int").alias("line"),
    )


def import_row(specifier: Column, kind: Column, symbols: Column, order: Column) -> Column:
    return F.struct(
        specifier.alias("specifier"), kind.alias("kind"), symbols.alias("symbols"), order.cast("bigint").alias("ord")
    )


def _concat(element: str, parts: tuple[Column, ...]) -> Column:
    empty = F.array().cast(f"array<{element}>")
    return F.concat(empty, *[F.coalesce(p.cast(f"array<{element}>"), empty) for p in parts])


def symbols_array(*parts: Column) -> Column:
    return _concat(SYMBOL.simpleString(), parts)


def imports_array(*parts: Column) -> Column:
    return _concat(RAW_IMPORT, parts)
