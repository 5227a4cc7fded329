"""Tokens, nesting and statements as window columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from codeloom.parse.scanner import ruby_scanner, rust_scanner, scanned, script_scanner
from codeloom.session import uncounted

FILE = ["project", "file_path"]


def in_order() -> WindowSpec:
    return Window.partitionBy(*FILE).orderBy("i")


def before() -> WindowSpec:
    """All earlier tokens of the file."""
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    """All earlier tokens and the current one."""
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Lexicon:
    """``token`` matches one significant token, ``trivia`` the blanks and comments after it.

    Repetitions are possessive: they run without recursion, so long literals are safe.
    """

    token: str
    trivia: str


# Languages whose literals or comments nest, or whose slashes depend on what came before, are scanned with state.
SCRIPT = script_scanner
RUST = rust_scanner
RUBY = ruby_scanner

_ESCAPED = r"\\[\s\S]"
_DOUBLE = rf'"(?:[^"\\]++|{_ESCAPED})*+"?'

ELIXIR = Lexicon(
    token="|".join(
        [
            r'"""[\s\S]*?"""',
            r"'''[\s\S]*?'''",
            r'~[a-zA-Z]"""[\s\S]*?"""[a-z]*+',
            r'~[a-zA-Z](?:\([^)]*+\)|\[[^\]]*+\]|\{[^}]*+\}|/(?:[^/\\]++|\\.)*+/|"[^"]*+"|\|[^|]*+\|)[a-z]*+',
            _DOUBLE,
            rf"'(?:[^'\\]++|{_ESCAPED})*+'?",
            r"[\p{L}_][\p{L}\p{N}_]*+[?!]?:(?!:)",
            rf":(?:{_DOUBLE}|[\p{{L}}_][\p{{L}}\p{{N}}_@]*+[?!]?)",
            r"@?[\p{L}\p{N}_]++(?:\.[A-Z]\w*+)*+[?!]?",
            r"->|<-|\|>|=>|::",
            r"[\s\S]",
        ]
    ),
    trivia=r"(?:#[^\n]*+|\s++)*+",
)


def by_file(sources: DataFrame, what: str = "content") -> DataFrame:
    """(project, file_path, ``what``) placed by file.

    The partition count is given, so that adaptive execution does not merge partitions by
    the size of the compact text: cut into tokens it grows many times over.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.select(*FILE, what).repartition(n, *FILE)


def _cut(sources: DataFrame, lexicon: Lexicon) -> DataFrame:
    opening = F.regexp_extract("content", f"^{lexicon.trivia}", 0)
    rest = F.expr("substring(content, length(opening) + 1)")
    pattern = F.lit(f"(?:{lexicon.token}){lexicon.trivia}")
    # Outer: the array is never empty, and Spark would cut every text once more to see that.
    cut = (
        by_file(sources)
        .withColumn("opening", opening)
        .select(*FILE, F.posexplode_outer(F.concat(F.array("opening"), F.regexp_extract_all(rest, pattern, F.lit(0)))).alias("i", "raw"))
    )
    # Row 0 is the file's leading trivia, possibly empty, and has no token.
    sig = F.when(F.col("i") == 0, F.lit("")).otherwise(F.regexp_extract("raw", f"^(?:{lexicon.token})", 0))
    newlines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    return cut.withColumn("sig", sig).withColumns(
        {
            "trivia": F.expr("substring(raw, length(sig) + 1)"),
            "line": (F.lit(1) + F.coalesce(F.sum(newlines).over(before()), F.lit(0))).cast("int"),
            "start": (F.lit(1) + F.coalesce(F.sum(F.length("raw")).over(before()), F.lit(0))).cast("int"),
        }
    )


def _scan(sources: DataFrame, scanner: Callable) -> DataFrame:
    # Plain TypeScript has type arguments where the others have elements.
    more = [~F.endswith(F.lower("file_path"), F.lit(".ts"))] if scanner is SCRIPT else []
    # Scanned before it is placed: Spark forgets the placement behind Python, and would place every token again.
    found = by_file(sources.select(*FILE, scanned(F.col("content"), scanner, *more).alias("found")), "found")
    return found.select(*FILE, F.posexplode_outer("found").alias("i", "t")).select(*FILE, "i", "t.*")


def tokens(sources: DataFrame, lexicon: Lexicon | Callable) -> DataFrame:
    """One row per token of each (project, file_path, content), by a lexicon or a scanner.

    Columns: i (order), sig (the token), trivia (what follows it), gap (the trivia before
    it), line (1-based), start and stop (1-based character offsets, stop exclusive).

    Texts, or the tokens of a text in one row, are placed by file before they become rows, so
    every window below runs without another exchange.
    """
    split = _cut(sources, lexicon) if isinstance(lexicon, Lexicon) else _scan(sources, lexicon)
    gap = F.coalesce(F.lag("trivia").over(in_order()), F.lit(""))
    return split.select(*FILE, "i", "sig", "trivia", gap.alias("gap"), "line", "start").withColumn("stop", F.col("start") + F.length("sig"))


def previous(column: str, n: int = 1) -> Column:
    return F.coalesce(F.lag(column, n).over(in_order()), F.lit(""))


def following(column: str, n: int = 1) -> Column:
    return F.coalesce(F.lead(column, n).over(in_order()), F.lit(""))


def running(flag: Column, frame: WindowSpec | None = None) -> Column:
    """How many rows satisfied ``flag`` within the frame (default: so far)."""
    return F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(frame or so_far()), F.lit(0))


def latest(value: Column, frame: WindowSpec | None = None) -> Column:
    """The newest non-NULL value within the frame (default: before)."""
    return F.last(value, ignorenulls=True).over(frame or before())


def bracket_depth(rows: DataFrame) -> DataFrame:
    """Add ``depth``: brackets open around a token (a bracket itself counts as outside)."""
    opens = F.col("sig").isin("(", "[", "{")
    closes = F.col("sig").isin(")", "]", "}")
    return rows.withColumn("depth", running(opens, before()) - running(closes, so_far()))


def statements(rows: DataFrame, gathered: dict[str, Column], ends: Column | None = None) -> DataFrame:
    """One row per statement from token rows flagged ``is_start``.

    Columns: ord (its first token), sig, gap, line, start, end, and one array per entry of
    ``gathered``: the non-NULL values of its tokens, in order. ``ends`` marks the tokens
    that may end a statement (default: all). Tokens are already placed by file, so the
    grouping moves nothing; its largest group is one statement of one file.
    """
    last = F.col("stop") if ends is None else F.when(ends, F.col("stop"))
    numbered = rows.withColumn("statement", running(F.col("is_start"))).filter("statement > 0")
    lists = {
        name: F.transform(
            F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("i", value.alias("v"))))), lambda x: x["v"]
        )
        for name, value in gathered.items()
    }
    return numbered.groupBy(*FILE, "statement").agg(
        F.min("i").alias("ord"),
        F.min_by(F.struct("sig", "gap", "line", "start"), "i").alias("head"),
        F.max(last).alias("end"),
        *[column.alias(name) for name, column in lists.items()],
    ).select(*FILE, "ord", "head.*", "end", *lists)


def with_text(statements: DataFrame, sources: DataFrame) -> DataFrame:
    """Join statements back to their file's content as ``text`` (start … end).

    Both sides are placed by file already. Spark takes the statements for as many rows as there are files, and the
    contents for what their compressed file holds, so neither may be broadcast by its estimate.
    """
    return statements.join(uncounted(by_file(sources)), FILE).withColumn(
        "text", F.expr("substring(content, start, end - start)")
    ).drop("content")
