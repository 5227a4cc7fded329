"""Rust: top-level items, ``use`` declarations and out-of-line modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import signature, trim_ws
from codeloom.parse import docs
from codeloom.parse.lexing import FILE, RUST, bracket_depth, previous, statements, tokens, with_text
from codeloom.parse.rows import import_row, imports_array, symbol_row, symbols_array

_ITEMS = (
    "pub", "fn", "struct", "enum", "trait", "impl", "type", "const", "static", "mod", "use", "macro_rules", "async",
    "unsafe", "extern", "union", "crate",
)
_VISIBLE = r"^(?:pub(?:\s*\([^)]*\))?\s+)?"
_QUALIFIED = r"(?:(?:default|const|async|unsafe)\s+)*(?:extern\s*(?:\"[^\"]*\"\s*)?)?"
# Angle brackets up to three levels deep.
_GENERICS = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"


def visibility(text: Column) -> Column:
    modifier = F.regexp_extract(text, r"^pub(?:\s*\([^)]*\))?", 0)
    return (
        F.when(modifier == "", "private")
        .when(modifier == "pub", "public")
        .when(F.contains(modifier, F.lit("crate")), "pub_crate")
        .when(F.contains(modifier, F.lit("super")), "pub_super")
        .otherwise("public")
    )


def _impl_type(text: Column) -> Column:
    """The type an impl block is for, as written."""
    head = F.regexp_extract(text, rf"^(?:unsafe\s+)?impl\s*(?:{_GENERICS})?\s*([^{{]*)\{{", 1)
    head = F.regexp_replace(head, r"\s+where\b[\s\S]*$", "")
    return F.nullif(trim_ws(F.regexp_replace(head, r"^[\s\S]*\sfor\s+", "")), F.lit(""))


def _item(text: Column) -> tuple[Column, Column]:
    patterns = {
        "function": rf"{_VISIBLE}{_QUALIFIED}fn\s+(\w+)[\s\S]*\}}$",
        "struct": rf"{_VISIBLE}struct\s+(\w+)",
        "enum": rf"{_VISIBLE}enum\s+(\w+)",
        "trait": rf"{_VISIBLE}(?:unsafe\s+)?trait\s+(\w+)\s*(?:<[^=]*)?[:{{w]",
        "type": rf"{_VISIBLE}type\s+(\w+)",
        "const": rf"{_VISIBLE}(?:const|static(?:\s+mut)?)\s+(\w+)\s*:",
        "macro": r"^macro_rules!\s*(\w+)",
        "module": rf"{_VISIBLE}mod\s+(\w+)",
    }
    names = {kind: F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for kind, p in patterns.items()}
    names["impl"] = F.when(text.rlike(r"^(?:unsafe\s+)?impl\b"), _impl_type(text))
    kind = F.coalesce(*[F.when(n.isNotNull(), F.lit(k)) for k, n in names.items()])
    return kind, F.coalesce(*names.values())


def extract(sources: DataFrame) -> DataFrame:
    rows = bracket_depth(tokens(sources, RUST)).withColumn("prev", previous("sig"))
    sig, prev = F.col("sig"), F.col("prev")
    starts = (
        (F.col("i") > 0)
        & (F.col("depth") == 0)
        & ~sig.isin(";", ")", "]", "}")
        & (
            (F.col("i") == 1)
            | (prev == ";")
            | ((prev == "}") & sig.rlike(r"^[\w#]") & ~sig.isin("as"))
            | ((prev == "]") & sig.isin(*_ITEMS))
        )
    )
    found = with_text(statements(rows.withColumn("is_start", starts), {}), sources).withColumn(
        "above", docs.lines_above(F.col("gap"), F.col("ord") == 1)
    )
    text = F.col("text")
    kind, name = _item(text)
    found = found.select("*", kind.alias("kind"), name.alias("name"), docs.slash_doc(F.col("above")).alias("doc"))
    kind, name, doc = F.col("kind"), F.col("name"), F.col("doc")
    symbol = F.when(
        kind.isNotNull(),
        F.array(symbol_row(name, kind, signature(text), doc, visibility(text), F.col("line"))),
    )

    path = trim_ws(F.regexp_extract(text, rf"{_VISIBLE}use\s+(\w[\s\S]*?)\s*;$", 1))
    use = F.when(
        path != "",
        F.array(import_row(path, F.lit("rust_use"), F.array(F.substring_index(path, "::", -1)), F.col("ord"))),
    )
    module = F.regexp_extract(text, rf"{_VISIBLE}mod\s+(\w+)\s*;$", 1)
    mod = F.when(
        module != "",
        F.array(import_row(F.concat(F.lit("mod "), module), F.lit("rust_mod"), F.array(module), F.col("ord"))),
    )
    return found.select(
        *FILE, "ord", symbols_array(symbol).alias("symbols"), imports_array(use, mod).alias("imports")
    )
