"""TypeScript and JavaScript: top-level declarations, exports and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import signature, strip_quotes, trim_ws
from codeloom.parse import docs
from codeloom.parse.lexing import (
    FILE, SCRIPT, so_far, bracket_depth, following, latest, previous, statements, tokens, with_text,
)
from codeloom.parse.rows import import_row, imports_array, symbol_row, symbols_array

# Keywords that begin a statement even right behind a closing brace.
_DECLARES = ("export", "import", "function", "async", "class", "interface", "type", "enum", "const", "let", "var")
# A line ending in one of these goes on; a line beginning with one of those goes on, too.
_JOINS_NEXT = (
    "=", ",", "+", "-", "*", "/", "%", "&", "|", "^", "?", ":", "<", "(", "[", "{", ".", "=>", "!", "~",
    "export", "default", "extends", "implements", "async", "const", "let", "var", "from", "as",
)
_JOINS_PREVIOUS = ("instanceof", "in", "of", "as", "satisfies", "extends", "implements", "from", "else", "catch", "finally")
_WORD = r"[\p{L}\p{N}_$]+"
_LEAD = r"^(?:@[^\n]*\s+)*"


def _mark(sources: DataFrame) -> DataFrame:
    rows = bracket_depth(tokens(sources, SCRIPT)).select(
        "*",
        previous("sig").alias("prev"),
        following("sig").alias("next"),
        following("sig", 2).alias("next2"),
    )
    sig, prev = F.col("sig"), F.col("prev")
    fresh_line = (
        F.contains(F.col("gap"), F.lit("\n"))
        & sig.rlike("^[@#\\p{L}\\p{N}_$'\"`{]")
        & ~sig.isin(*_JOINS_PREVIOUS)
        & ~prev.isin(*_JOINS_NEXT)
    )
    candidate = (
        (F.col("i") > 0)
        & (F.col("depth") == 0)
        & ~sig.isin(";", ")", "]", "}")
        & ((F.col("i") == 1) | (prev == ";") | fresh_line | ((prev == "}") & sig.isin(*_DECLARES)))
    )
    rows = rows.withColumn("candidate", candidate)
    # Decorators belong to the declaration behind them.
    decorated = F.coalesce(F.startswith(latest(F.when(F.col("candidate"), sig)), F.lit("@")), F.lit(False))
    rows = rows.withColumn("is_start", F.col("candidate") & ~decorated)
    opening = F.when(sig == "export", F.col("next")).otherwise(sig)
    return rows.withColumn("opening", latest(F.when(F.col("is_start"), opening), so_far()))


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "\n", ""))


_DECLARED = ("function", "enum", "class", "interface", "type")


def _declarations(text: Column) -> dict[str, Column]:
    """Per kind of declaration the declared name, NULL where the statement is none of that kind."""
    head = rf"{_LEAD}(?:export\s+)?"
    patterns = {
        # A function without a body is an overload signature, which declares nothing.
        "function": rf"{head}(?:async\s+)?function\s+({_WORD})",
        "enum": rf"{head}(?:const\s+)?enum\s+({_WORD})",
        "class": rf"{head}class\s+({_WORD})",
        "interface": rf"{head}interface\s+({_WORD})",
        "type": rf"{head}type\s+({_WORD})\s*[<=]",
    }
    names = {kind: F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for kind, p in patterns.items()}
    ends_with_body = F.right(F.rtrim(F.regexp_replace(F.right(text, F.lit(8)), ";$", "")), F.lit(1)) == "}"
    return names | {"function": F.when(ends_with_body, names["function"])}


def _export_clause(plain: Column) -> Column:
    """Symbols of ``export { a, b as c }``, one per specifier under its outward name."""
    opening = F.regexp_extract(plain, r"^export\s*(?:type\s*)?\{", 0)
    clause = F.regexp_extract(plain, r"^export\s*(?:type\s*)?\{([^}]*)\}", 1)

    parts = F.split(clause, ",")

    def one(spec: Column, k: Column) -> Column:
        earlier = F.array_join(F.slice(parts, F.lit(1), k), ",")
        above = F.concat(opening, earlier, F.regexp_extract(spec, r"^\s*", 0))
        return symbol_row(
            name=F.regexp_extract(spec, r"^\s*(?:type\s+)?(?:\S+\s+as\s+)?(\S+)\s*$", 1),
            kind=F.lit("unknown"),
            signature=trim_ws(spec),
            doc=F.lit(None),
            visibility=F.lit("exported"),
            line=F.col("line") + _newlines(above),
        )

    return F.filter(F.transform(parts, one), lambda s: s["name"] != "")


def _import_names(plain: Column) -> Column:
    """Names an import binds, by what they are called in the imported file."""
    clause = F.regexp_extract(plain, r"^import\s+(?:type\s+(?!from\b))?([\s\S]*?)\s*from\s*['\"]", 1)
    single = F.when(clause.rlike(rf"^{_WORD}\s*(,|$)"), F.array(F.lit("default")))
    star = F.when(clause.rlike(r"\*\s*as\s"), F.array(F.lit("*")))
    braces = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
    named = F.filter(
        F.transform(F.split(braces, ","), lambda s: F.regexp_extract(s, r"^\s*(?:type\s+(?!as\b))?([^\s]+)", 1)),
        lambda s: s != "",
    )
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(single, empty), F.coalesce(star, empty), named)


def extract(sources: DataFrame) -> DataFrame:
    """Statements of (project, file_path, content) with their ``symbols`` and ``imports`` arrays."""
    rows = _mark(sources)
    sig, prev = F.col("sig"), F.col("prev")
    declares = (
        (F.col("depth") == 0)
        & F.col("opening").isin("const", "let", "var")
        & prev.isin("const", "let", "var", ",")
        & sig.rlike(rf"^{_WORD}$")
        & F.col("next").isin("=", ",", ";", ":", "!", "")
    )
    quoted = F.col("next2").rlike("^['\"]")
    dynamic = (sig == "import") & (F.col("next") == "(") & quoted
    found = statements(
        rows,
        {
            "declared": F.when(declares, sig),
            "dynamic": F.when(dynamic, strip_quotes(F.col("next2"))),
            "opened": F.when(F.col("is_start"), F.col("opening")),
        },
    )
    found = with_text(found, sources).withColumn("above", docs.lines_above(F.col("gap"), F.col("ord") == 1))
    text = F.col("text")
    found = found.select(
        "*",
        F.regexp_replace(text, r"//[^\n]*|/\*[\s\S]*?\*/", "").alias("plain"),
        signature(text).alias("signature"),
        docs.slash_doc(F.col("above")).alias("doc"),
        text.rlike(rf"{_LEAD}export\b").alias("is_export"),
        text.rlike(rf"{_LEAD}export\s+default\b").alias("is_default"),
    )
    plain, is_export = F.col("plain"), F.col("is_export")
    visibility = F.when(is_export, "exported").otherwise("private")

    # Columns of their own, so that each pattern is matched once per statement.
    found = found.select("*", *[n.alias(f"as_{k}") for k, n in _declarations(text).items()])
    kind = F.coalesce(*[F.when(F.col(f"as_{k}").isNotNull(), F.lit(k)) for k in _DECLARED])
    name = F.coalesce(*[F.col(f"as_{k}") for k in _DECLARED])
    declaration = F.when(
        ~F.col("is_default") & kind.isNotNull(),
        F.array(symbol_row(name, kind, F.col("signature"), F.col("doc"), visibility, F.col("line"))),
    )
    default_kind = (
        F.when(text.rlike(rf"{_LEAD}export\s+default\s+(?:async\s+)?function\s+{_WORD}"), "function")
        .when(text.rlike(rf"{_LEAD}export\s+default\s+class\b"), "class")
        .otherwise("unknown")
    )
    default = F.when(
        F.col("is_default"),
        F.array(
            symbol_row(
                F.lit("default"), default_kind, F.col("signature"), F.col("doc"), F.lit("default_export"), F.col("line")
            )
        ),
    )
    variables = F.transform(
        "declared",
        lambda n: symbol_row(n, F.get("opened", F.lit(0)), F.col("signature"), F.col("doc"), visibility, F.col("line")),
    )
    clause = F.when(plain.rlike(r"^export\s*(?:type\s*)?\{"), _export_clause(plain))

    source = F.regexp_extract(plain, r"^(?:import|export)\b(?:[\s\S]*?\bfrom|[\s\S]*?[}*]\s*from)?\s*['\"]([^'\"]*)['\"]", 1)
    from_statement = plain.rlike(r"^(?:import\s*['\"]|import\s*[^(.][\s\S]*?from\s*['\"]|export\s*(?:type\s*)?[{*][\s\S]*?from\s*['\"])")
    static = F.when(
        from_statement & (source != ""),
        F.array(
            import_row(
                source, F.lit("script"), F.when(is_export, F.array(F.lit("*"))).otherwise(_import_names(plain)), F.col("ord")
            )
        ),
    )
    # Dynamic imports of a file come after all of its static ones.
    lazy = F.transform(
        "dynamic", lambda s: import_row(s, F.lit("script"), F.array(F.lit("*")), F.col("ord") + F.lit(1 << 40))
    )
    return found.select(
        *FILE,
        "ord",
        symbols_array(declaration, default, variables, clause).alias("symbols"),
        imports_array(static, lazy).alias("imports"),
    )
