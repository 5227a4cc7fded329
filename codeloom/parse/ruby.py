"""Ruby: classes, modules, methods, constants, mixins, accessors and requires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import signature, strip_quotes
from codeloom.parse import docs
from codeloom.parse.blocks import nest
from codeloom.parse.lexing import FILE, RUBY, following, latest, previous, statements, tokens, with_text
from codeloom.parse.rows import import_row, imports_array, symbol_row, symbols_array

_LOOPS = ("while", "until", "for")
# Behind these, `if` and its kin begin a block; behind a value they are modifiers.
_EXPECTS_VALUE = (
    "", "=", "(", "[", "{", ",", "|", "||", "&&", "=>", "==", "+", "-", "*", "<<", "!", "?", ":", ";",
    "return", "then", "do", "else", "begin", "and", "or", "not", "when", "in", "yield",
)
_JOINS_NEXT = (",", ".", "=", "+", "-", "*", "/", "||", "&&", "|", "&", "<<", "=>", "==", "(", "[", "{", "::", "and", "or", "not")
_CONSTANT = r"(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*"


def extract(sources: DataFrame) -> DataFrame:
    program = F.regexp_replace("content", r"(?s)(?<![^\n])__END__\r?(?:\n.*)?$", "")  # what follows is data
    rows = tokens(sources.withColumn("content", program), RUBY).select(
        "*",
        previous("sig").alias("prev"),
        previous("trivia", 1).alias("prev_trivia"),
        following("sig").alias("next"),
        following("trivia").alias("next_trivia"),
        following("sig", 2).alias("next2"),
    )
    sig, prev, next_ = F.col("sig"), F.col("prev"), F.col("next")
    new_line = F.contains(F.col("gap"), F.lit("\n")) | (F.col("i") == 1)
    plain = ~prev.isin(".", "::", "&.") & (F.col("i") > 0)
    leads = new_line | prev.isin(*_EXPECTS_VALUE)
    loop_line = latest(F.when(sig.isin(*_LOOPS) & leads, F.col("line")))
    # `def name = value` has no end; `def name=(value)` does.
    endless = (sig == "def") & (F.col("next2") == "=") & (F.col("next_trivia") != "")
    opens = plain & (
        sig.isin("(", "[", "{", "class", "module", "begin", "case")
        | ((sig == "def") & ~endless)
        | (sig.isin("if", "unless", *_LOOPS) & leads)
        | ((sig == "do") & ~F.coalesce(loop_line == F.col("line"), F.lit(False)))
    )
    closes = (plain & (sig == "end")) | sig.isin(")", "]", "}")
    container = (sig == "module") | ((sig == "class") & (next_ != "<<"))
    rows = nest(rows, opens, closes, ~container)
    starts = (
        (F.col("i") > 0)
        & (F.col("hidden") == 0)
        & ~sig.isin(";", ".", "&", ")", "]", "}")
        & (
            (F.col("i") == 1)
            | (prev == ";")
            | (new_line & ~prev.isin(*_JOINS_NEXT))
        )
    )
    rows = rows.withColumn("is_start", starts)
    found = statements(
        rows,
        {"closer": F.when(F.col("is_start"), F.col("node_end"))},
        ends=~sig.isin(";"),
    )
    # A class or module reaches to its own `end`, past the statements inside it.
    found = found.withColumn("end", F.greatest("end", F.coalesce(F.try_element_at("closer", F.lit(1)), F.col("end"))))
    found = with_text(found, sources).withColumn("above", docs.lines_above(F.col("gap"), F.col("ord") == 1))
    found = found.withColumn("doc", docs.hash_doc(F.col("above")))
    text, line, doc = F.col("text"), F.col("line"), F.col("doc")

    def one(kind: str, pattern: str, prefix: str = ""):
        name = F.regexp_extract(text, pattern, 1)
        row = symbol_row(
            F.concat(F.lit(prefix), name), F.lit(kind), signature(text), doc, F.lit("public"), line
        )
        return F.when(name != "", F.array(row))

    method = r"((?:[\p{L}_]\w*(?:[?!]|=(?=\())?)|\[\]=?|[-+*/%<>=!~^&|]{1,3}@?)"
    singleton = rf"^def\s+\w+\s*\.\s*{method}"
    words = F.regexp_extract(text, r"^(?:[\w:@]+\.)?(include|extend|prepend|require|require_relative|attr_accessor|attr_reader|attr_writer)\b", 1)
    arguments = F.regexp_extract(text, r"^[\w:@.]+[ \t]*\(?\s*([\s\S]*?)\)?$", 1)
    is_call = (words != "") & ~text.rlike(r"\s(?:if|unless|while|until)\s")
    # Quoted strings first, so that commas inside them do not split arguments.
    strings = F.transform(
        F.regexp_extract_all(arguments, F.lit(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')"), F.lit(1)), strip_quotes
    )
    constants = F.filter(
        F.transform(F.split(arguments, ","), lambda a: F.regexp_extract(a, rf"^\s*({_CONSTANT})\s*$", 1)), lambda a: a != ""
    )
    symbols_ = F.filter(
        F.transform(F.split(arguments, ","), lambda a: F.regexp_extract(a, r"^\s*:([\p{L}_]\w*[?!]?)\s*$", 1)), lambda a: a != ""
    )
    mixins = F.when(
        is_call & words.isin("include", "extend", "prepend"),
        F.transform(
            constants,
            lambda c: symbol_row(
                F.concat(words, F.lit(" "), c), F.lit("unknown"), text, F.lit(None), F.lit("private"), line
            ),
        ),
    )
    accessors = F.when(
        is_call & F.startswith(words, F.lit("attr_")),
        F.transform(
            symbols_,
            lambda n: symbol_row(n, F.lit("function"), F.concat(words, F.lit(" :"), n), doc, F.lit("public"), line),
        ),
    )
    requires = F.when(
        is_call & words.isin("require", "require_relative"),
        F.transform(
            F.filter(strings, lambda s: s != ""),
            lambda s: import_row(s, F.concat(F.lit("ruby_"), words), F.array(F.lit("*")), F.col("ord")),
        ),
    )
    return found.select(
        *FILE,
        "ord",
        symbols_array(
            one("class", rf"^class\s+({_CONSTANT})"),
            one("module", rf"^module\s+({_CONSTANT})"),
            one("function", singleton, "self."),
            F.when(~text.rlike(singleton), one("function", rf"^def\s+{method}")),
            one("const", r"^([A-Z]\w*)\s*=(?![=~>])"),
            mixins,
            accessors,
        ).alias("symbols"),
        imports_array(requires).alias("imports"),
    )
