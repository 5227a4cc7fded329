"""Cutting a file's text into tokens where that needs state: nesting of any depth, and what came before a slash."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts whose tokens are Python objects at a time.
SLICE = 64
TOKENS = "array<struct<sig:string,trivia:string,line:int,start:int>>"


def script_scanner() -> Callable[[str | None, bool | None], list[tuple[str, str]]]:
    """Reader of TypeScript and JavaScript; ``tags`` says whether a ``<`` that wants a value opens an element.

    A template or an element without ``{`` is one token. Otherwise the text between its
    expressions is cut out in tokens of its own, and the expressions are read like all other code, so
    nesting has no limit and imports inside are seen. Text has no quotes, comments or brackets. A
    slash opens a regular expression behind an operator or bracket that wants a value, behind such a
    word, behind the closing bracket of an ``if``, ``for``, ``while`` or ``with``, and behind
    the closing brace of a block; blanks, lines and comments between them do not matter. What
    opens a template or an element that never ends is an ordinary sign.

    The scanners are nested functions, which travel to the executors by value.
    """
    token = re.compile(r'"(?:[^"\\\n]++|\\[\s\S])*+"|' r"'(?:[^'\\\n]++|\\[\s\S])*+'|[@#]?[\w$]++|=>|[\s\S]")
    trivia = re.compile(r"(?://[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?|[ \t\n\x0b\f\r]++)*+")
    regex = re.compile(r"/(?![/*])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+")
    in_template = re.compile(r"[^`\\$]++|\\[\s\S]|\$\{|[\s\S]")
    tag_start = re.compile(r"<(?:([\w$][\w$.:-]*+)(?=[\s/>])|(?=>))")
    in_tag = re.compile(r"""(?:[\w$.:=-]++|"[^"]*+"|'[^']*+'|\s++|/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n]*+)++""")
    in_element = re.compile(r"[^<{]++")
    tag_end = re.compile(r"</\s*+([\w$.:-]*+)\s*+>")
    operators = {"", "=", "=>", "(", ",", ":", "[", "!", "&", "|", "?", "{", ";", "*", "%", "^", "~", ">"}
    words = {"return", "typeof", "case", "do", "else", "in", "of", "void", "delete", "throw", "new", "yield", "await", "default"}
    headers = {"if", "for", "while", "with"}
    before_object = {"=", "(", ",", "[", "!", "&", "|", "?"} | words - {"do", "else", "of"}
    literals = {"`", "tag", "element"}

    def scan(text, tags=True):
        text = text or ""
        size, pos = len(text), trivia.match(text or "").end()
        out = [("", text[:pos])]
        # Open brackets and literals. A bracket holds what a slash behind its closer is; a tag or an
        # element its name and whether the literal began with it.
        stack: list[tuple] = []
        # Where the outermost literal began, to read it as ordinary signs if it never ends; where the piece at hand began.
        back, piece = None, 0
        earlier = prev = ""
        wants = True
        broken = set()

        def cut(end, behind):
            """The piece at hand as a token, or behind the brace before it, where it might look like code."""
            if "\n" in text[piece:end] or any(x in text[piece:end] for x in "<`$"):
                out.append((text[piece:end], text[end:behind]))
            elif piece < behind:
                out[-1] = (out[-1][0], out[-1][1] + text[piece:behind])

        while True:
            mode = stack[-1][0] if stack else ""
            failed = pos >= size
            if failed and back is None:
                return out
            if not failed and mode == "`":
                m = in_template.match(text, pos)
                pos = m.end()
                if m[0] == "${":
                    cut(pos - 1, pos - 1)
                elif m[0] == "`":
                    stack.pop()
                    end = trivia.match(text, pos).end()
                    out.append((text[piece:pos], text[pos:end]))
                    earlier, prev, wants, pos = prev, "`", False, end
                    if not any(kind in literals for kind, *_ in stack):
                        back = None
                    continue
                else:
                    continue
            elif not failed and mode == "tag":
                m = in_tag.match(text, pos)
                pos = m.end() if m else pos
                _, name, first = stack[-1]
                if text.startswith("/>", pos):
                    stack.pop()
                    pos += 2
                    ended = first
                elif text.startswith(">", pos):
                    stack[-1] = ("element", name, first)
                    pos += 1
                    continue
                elif text.startswith("{", pos):
                    cut(pos, pos)
                    pos += 1
                    ended = None
                else:
                    failed, ended = True, None
                if ended is False:
                    continue
            elif not failed and mode == "element":
                m = in_element.match(text, pos)
                pos = m.end() if m else pos
                _, name, first = stack[-1]
                if m and pos >= size:
                    continue
                close, opened = tag_end.match(text, pos), tag_start.match(text, pos)
                ended = None
                if text.startswith("{", pos):
                    cut(pos, pos)
                    pos += 1
                elif close and close[1] == name:
                    stack.pop()
                    pos = close.end()
                    if not first:
                        continue
                    ended = True
                elif opened:
                    stack.append(("tag", opened[1] or "", False))
                    pos = opened.end()
                    continue
                else:
                    failed = True
            if failed:
                start, stack, earlier, prev, wants, length = back
                broken.add(start)
                del out[length:]
                out[-1] = back_trivia
                pos, back = start, None
                continue
            if mode in ("tag", "element") and ended:
                end = trivia.match(text, pos).end()
                out.append((text[piece:pos], text[pos:end]))
                earlier, prev, wants, pos = prev, ">>", False, end
                if not any(kind in literals for kind, *_ in stack):
                    back = None
                continue
            if mode in literals:  # an expression begins
                stack.append(("${", False))
                end = trivia.match(text, pos).end()
                out.append(("{", text[pos:end]))
                earlier, prev, wants, pos = prev, "{", True, end
                continue
            c = text[pos]
            tag = tag_start.match(text, pos) if c == "<" and tags and wants else None
            if (c == "`" or tag) and pos not in broken:
                if back is None:
                    back, back_trivia = (pos, list(stack), earlier, prev, wants, len(out)), out[-1]
                piece = pos
                stack.append(("`", False) if c == "`" else ("tag", tag[1] or "", True))
                pos = pos + 1 if c == "`" else tag.end()
                continue
            m = regex.match(text, pos) if c == "/" and wants and not (prev == "}" and text.startswith("/>", pos)) else None
            literal = m is not None
            m = m or token.match(text, pos)
            sig = m[0]
            wanted = sig in operators or (sig in words and prev != ".")
            if literal:
                wanted = False
            elif sig == "(":
                stack.append(("(", prev in headers and earlier != "." or prev == "await" and earlier == "for"))
            elif sig == "[":
                stack.append(("[", False))
            elif sig == "{":
                stack.append(("{", prev not in before_object))
            elif sig in (")", "]", "}"):
                if sig == "}" and stack and stack[-1][0] == "${":
                    stack.pop()
                    out.append(("}", ""))
                    pos += 1
                    piece = pos
                    continue
                opener = {")": "(", "]": "[", "}": "{"}[sig]
                wanted = sig == "}"
                if stack and stack[-1][0] == opener:
                    wanted = stack.pop()[1]
            end = trivia.match(text, m.end()).end()
            out.append((sig, text[m.end() : end]))
            earlier, prev, wants, pos = prev, sig, wanted, end

    return scan


def rust_scanner() -> Callable[[str | None], list[tuple[str, str]]]:
    """Reader of Rust; block comments nest to any depth."""
    token = re.compile(
        r'b?r(#*+)"[\s\S]*?"\1|b?"(?:[^"\\]++|\\[\s\S])*+"?|' r"b?'(?:[^'\\\n]|\\[^\n][^'\n]*+)'|'\w++|\w++|::|->|=>|[\s\S]"
    )
    blanks = re.compile(r"(?://[^\n]*+|[ \t\n\x0b\f\r]++)*+")
    edge = re.compile(r"/\*|\*/")

    def trivia_end(text: str, pos: int) -> int:
        while True:
            pos = blanks.match(text, pos).end()
            if not text.startswith("/*", pos):
                return pos
            depth = 0
            while True:
                m = edge.search(text, pos)
                if m is None:
                    return len(text)
                depth += 1 if m[0] == "/*" else -1
                pos = m.end()
                if depth == 0:
                    break

    def scan(text):
        text = text or ""
        pos = trivia_end(text, 0)
        out = [("", text[:pos])]
        while pos < len(text):
            m = token.match(text, pos)
            pos = trivia_end(text, m.end())
            out.append((m[0], text[m.end() : pos]))
        return out

    return scan


def ruby_scanner() -> Callable[[str | None], list[tuple[str, str]]]:
    """Reader of Ruby; a slash opens a regular expression behind what wants a value and at the start of a line."""
    token = re.compile(
        r"<<[~-]?+['\"`]?+([A-Z_][A-Z0-9_]*+)['\"`]?+[^\n]*+\n[\s\S]*?(?<=\n)[ \t]*+\1(?=\s|$)"
        r"|%[wWiIqQr]?(?:\[[^\]]*+\]|\([^)]*+\)|\{[^}]*+\})"
        r'|"(?:[^"\\]++|\\[\s\S])*+"?'
        r"|'(?:[^'\\]++|\\[\s\S])*+'?"
        r"|[^\W\d]\w*+[?!]?:(?!:)|::"
        r'|:(?:"(?:[^"\\]++|\\[\s\S])*+"?|[^\W\d]\w*+[?!=]?)'
        r"|[@$]*+\w++[?!]?|<<|&&|\|\||=>|==|[\s\S]"
    )
    trivia = re.compile(r"(?:#[^\n]*+|(?<=\n)=begin[\s\S]*?\n=end[^\n]*+|\\\n|[ \t\n\x0b\f\r]++)*+")
    regex = re.compile(r"/(?![/*])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+")
    operators = {"", "=", "(", ",", ":", "[", "!", "&", "|", "?", "{", "}", ";", "~", "=>", "==", "&&", "||", "<<"}
    words = {"if", "unless", "while", "until", "when", "elsif", "case", "and", "or", "not", "return", "in", "then", "do", "else", "yield"}

    def scan(text):
        text = text or ""
        pos = trivia.match(text).end()
        out = [("", text[:pos])]
        while pos < len(text):
            prev, gap = out[-1]
            wants = "\n" in gap or prev in operators or prev.endswith(":") and prev != "::" or (prev in words and (len(out) < 2 or out[-2][0] != "."))
            m = (regex.match(text, pos) if wants and text[pos] == "/" else None) or token.match(text, pos)
            pos = trivia.match(text, m.end()).end()
            out.append((m[0], text[m.end() : pos]))
        return out

    return scan


def scanned(content: Column, scanner: Callable[[], Callable], *more: Column) -> Column:
    """The tokens of a text with the trivia behind each, its line and its offset, both from 1; the first has no token, only the leading trivia.

    Texts are taken a few at a time, so that only their tokens are Python objects.
    """
    scan, rows = scanner(), SLICE
    fields = [("sig", pa.string()), ("trivia", pa.string()), ("line", pa.int32()), ("start", pa.int32())]
    shape = pa.list_(pa.struct(fields))

    def before(counts: list[pa.Array], ends: np.ndarray) -> pa.Array:
        """One more than the sum over the earlier tokens of the same text."""
        sums = np.concatenate([[0], np.cumsum(pc.add(*counts).to_numpy(zero_copy_only=False))])
        return pa.array(1 + sums[:-1] - np.repeat(sums[ends[:-1]], np.diff(ends)), pa.int32())

    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            done = [pa.array([], shape)]
            for start in range(0, len(columns[0]), rows):
                found = [scan(*values) for values in zip(*(c.slice(start, rows).to_pylist() for c in columns), strict=True)]
                pairs = [pair for tokens in found for pair in tokens]
                ends = [0]
                for tokens in found:
                    ends.append(ends[-1] + len(tokens))
                parts = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
                line = before([pc.count_substring(p, "\n") for p in parts], np.array(ends))
                start = before([pc.utf8_length(p) for p in parts], np.array(ends))
                done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([*parts, line, start], [n for n, _ in fields])))
            yield pa.concat_arrays(done)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return cut((texts,) for texts in batches)

    return F.arrow_udf(cut if more else one, TOKENS)(content, *more)
