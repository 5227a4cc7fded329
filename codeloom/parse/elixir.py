"""Elixir: modules, functions, macros, structs and module directives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import signature, trim_ws
from codeloom.parse import docs
from codeloom.parse.blocks import nest
from codeloom.parse.lexing import ELIXIR, FILE, so_far, latest, previous, statements, tokens, with_text
from codeloom.parse.rows import import_row, imports_array, symbol_row, symbols_array

_HEADS = ("defmodule", "def", "defp", "defmacro", "defmacrop", "defstruct", "alias", "import", "use", "require")
_SEALED = ("def", "defp", "defmacro", "defmacrop", "defstruct", "alias", "import", "use", "require")


def extract(sources: DataFrame) -> DataFrame:
    rows = tokens(sources, ELIXIR).select(
        "*",
        previous("sig").alias("prev"),
        previous("sig", 2).alias("prev2"),
    )
    sig, prev = F.col("sig"), F.col("prev")
    new_line = F.contains(F.col("gap"), F.lit("\n")) | (F.col("i") == 1)
    leads = (F.col("i") > 0) & (new_line | prev.isin(";", "do", "->"))
    heads_line = F.when(leads, sig)
    rows = rows.withColumn("head_word", latest(heads_line, so_far()))
    opens = (F.col("i") > 0) & sig.isin("(", "[", "{", "do", "fn")
    closes = sig.isin(")", "]", "}", "end")
    sealed = sig.isin("(", "[", "{") | ((sig == "do") & F.col("head_word").isin(*_SEALED))
    rows = nest(rows, opens, closes, sealed)
    starts = leads & (F.col("hidden") == 0) & ~sig.isin("|>", "end", ")", "]", "}", ",")
    rows = rows.withColumn("is_start", starts)
    found = statements(
        rows,
        {
            "prior": F.when(F.col("is_start"), prev),
            "prior2": F.when(F.col("is_start"), F.col("prev2")),
        },
        ends=sig != ";",
    )
    found = with_text(found.filter(F.col("sig").isin(*_HEADS)), sources)
    text, line, head = F.col("text"), F.col("line"), F.col("sig")

    found = found.withColumn("above", docs.lines_above(F.col("gap"), F.col("ord") == 1))
    found = found.withColumn("nearest", docs.after_blanks(F.col("above")))
    above = F.col("nearest")
    prior, prior2 = F.get("prior", F.lit(0)), F.get("prior2", F.lit(0))
    attached = prior2.isin("@doc", "@moduledoc")
    body = F.regexp_replace(prior, '^"""[^\n]*\n?|"""$', "")
    heredoc = trim_ws(F.array_join(F.transform(F.split(body, "\n"), trim_ws), "\n"))
    doc = (
        F.when(F.startswith(F.coalesce(F.get(above, F.lit(0)), F.lit("")), F.lit("#")), docs.hash_doc(above))
        .when(F.size(above) > 0, F.lit(None))
        .when(attached & F.startswith(prior, F.lit('"""')), F.nullif(heredoc, F.lit("")))
        .when(attached & F.startswith(prior, F.lit('"')), F.nullif(F.regexp_replace(prior, '^"+|"+$', ""), F.lit("")))
    )

    found = found.withColumn("doc", doc)
    doc = F.col("doc")

    module = F.regexp_extract(text, r"^defmodule\s*\(?\s*([A-Z]\w*(?:\.[A-Z]\w*)*)", 1)
    defined = F.regexp_extract(text, r"^def\w*\s*\(?\s*(?!unquote\([^)]*\)\()([\p{Ll}_]\w*[?!]?)", 1)
    named = head.isin("def", "defp", "defmacro", "defmacrop") & (defined != "")
    symbol = (
        F.when(
            (head == "defmodule") & (module != ""),
            symbol_row(module, F.lit("module"), F.concat(F.lit("defmodule "), module), doc, F.lit("public"), line),
        )
        .when(
            named,
            symbol_row(
                defined,
                F.when(head.isin("def", "defp"), "function").otherwise("macro"),
                signature(text),
                doc,
                F.when(head.isin("def", "defmacro"), "public").otherwise("private"),
                line,
            ),
        )
        .when(
            head == "defstruct",
            symbol_row(F.lit("defstruct"), F.lit("struct"), signature(text), F.lit(None), F.lit("public"), line),
        )
    )
    target = F.regexp_extract(text, r"^(?:alias|import|use|require)\s*\(?\s*([A-Z]\w*(?:\.[A-Z]\w*)*)(?![\w.])", 1)
    directive = F.when(
        target != "", F.array(import_row(target, F.lit("elixir"), F.array(F.lit("*")), F.col("ord")))
    )
    return found.select(
        *FILE,
        "ord",
        symbols_array(F.when(symbol.isNotNull(), F.array(symbol))).alias("symbols"),
        imports_array(directive).alias("imports"),
    )
