"""Expressions over a file's ``symbols`` array. All stay inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schema import PUBLIC_VISIBILITIES, SYMBOL


def none() -> Column:
    return F.array().cast(f"array<{SYMBOL.simpleString()}>")


def names(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda s: s["name"]), " ")


def searchable(path: Column, symbols: Column) -> Column:
    return F.concat(path, F.lit(" "), names(symbols))


def total(symbols: Column) -> Column:
    return F.size(symbols).cast("bigint")


def public_count(symbols: Column) -> Column:
    return F.size(F.filter(symbols, lambda s: s["visibility"].isin(*PUBLIC_VISIBILITIES))).cast("bigint")


def documented_count(symbols: Column) -> Column:
    return F.size(F.filter(symbols, lambda s: s["doc_comment"].isNotNull())).cast("bigint")


def all_undocumented(symbols: Column) -> Column:
    return (F.size(symbols) > 0) & F.forall(symbols, lambda s: s["doc_comment"].isNull())
