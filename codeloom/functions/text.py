"""Text, JSON and list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schema import MENTION_EXTENSIONS, SYMBOL

# Analyzer: split where the character class changes, keep punctuation, drop blanks.
TOKEN_PATTERN = r"[\p{L}]+|[\p{N}]+|[^\p{L}\p{N}\s]"


def analyze(text: Column) -> Column:
    """Lower-cased search tokens of a text (no stemming, no n-grams, no case splitting)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^['\"`]+|['\"`]+$", "")


# Unicode white space.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def signature(text: Column) -> Column:
    """Everything before the first '{', else the first line; trimmed."""
    has_brace = F.contains(text, F.lit("{"))
    return trim_ws(F.when(has_brace, F.substring_index(text, "{", 1)).otherwise(F.substring_index(text, "\n", 1)))


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def file_mentions(text: Column) -> Column:
    """Sorted distinct words of a prompt that end in a known file extension."""
    words = F.split(text, "(?U)[\\s`'\"]")
    edge = r"(?U)^[^\p{Alpha}\p{N}./_-]+|[^\p{Alpha}\p{N}./_-]+$"
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, edge, ""))
    ends = r"\.(?:" + "|".join(MENTION_EXTENSIONS) + r")$"
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda w: w.rlike(ends))))


def capped_list(shown: Column, total: Column, cap: int) -> Column:
    """'a, b' plus ' + n more' when ``total`` exceeds ``cap``; ``shown`` holds at most ``cap``."""
    more = F.when(total > cap, F.concat(F.lit(" + "), (total - cap).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(shown, ", "), more)


def json_symbols(text: Column) -> Column:
    """Decode a JSON array of symbols; malformed or missing text gives an empty array."""
    schema = "array<struct<name:string,kind:string,signature:string,docComment:string,visibility:string,line:int>>"
    parsed = F.from_json(text, schema)
    return F.coalesce(
        F.transform(
            parsed,
            lambda s: F.struct(
                s["name"].alias("name"), s["kind"].alias("kind"), s["signature"].alias("signature"),
                s["docComment"].alias("doc_comment"), s["visibility"].alias("visibility"), s["line"].alias("line"),
            ),
        ),
        F.array().cast(f"array<{SYMBOL.simpleString()}>"),
    )


def symbols_json(symbols: Column) -> Column:
    """Encode symbols with the camelCase keys of the exchange format; NULL docs stay present."""
    renamed = F.transform(
        symbols,
        lambda s: F.struct(
            s["name"].alias("name"), s["kind"].alias("kind"), s["signature"].alias("signature"),
            s["doc_comment"].alias("docComment"), s["visibility"].alias("visibility"), s["line"].alias("line"),
        ),
    )
    return F.to_json(renamed, {"ignoreNullFields": "false"})


def json_strings(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_status(text: Column) -> Column:
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def json_file_path(payload: Column) -> Column:
    """``tool_input.file_path`` of a hook payload when it is a non-empty string, else NULL."""
    value = F.get_json_object(payload, "$.tool_input.file_path")
    return F.when(value != "", value)


def epoch_ms() -> Column:
    return F.unix_millis(F.current_timestamp())
