"""Exact token counts at every prefix of a text, by dynamic programming.

For every prefix of a word one token can end there and nothing else: the one that is
compatible with the token before it (see ``merges``). So the table ``last token, number of
tokens`` is filled from left to right, once for prefixes that go on and once for prefixes
that end the word, because the vocabulary marks word ends. The second gives the exact count of
every prefix as if the text stopped there; truncation and budget questions are look-ups.

Prefixes are those of the text as the tokenizer reads it: in NFC and lower case, with the
strings of special tokens left as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import Recent
from codeloom.llm.common import arrow_map, file_broadcast, one_model, slices
from codeloom.llm.merges import WordEndMerges

# Words, and chunks between white space, that a task remembers: twice so many at most.
REMEMBERED = 500_000
# Prefixes of words that a task remembers, and bytes of the longest.
PREFIXES, DEPTH = 1_000_000, 8
# Fixed value: how the vocabulary's words are cut.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


class PrefixCounter:
    def __init__(self, vocabulary: bytes) -> None:
        self.merges = WordEndMerges(vocabulary)
        self.words = regex.compile(WORDS)
        names = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._starts = {body[:i] for body in (*self.merges.inner, *self.merges.final) for i in range(1, len(body))}
        self._rows: dict[bytes, dict] = {b"": {}}
        self._of_word = Recent(REMEMBERED)
        self._tables = Recent(REMEMBERED // 4)
        self._tree: dict[int, tuple] = {}
        self._nodes = 0
        self._total_of_chunk = Recent(REMEMBERED)
        self._of_chunk = Recent(REMEMBERED)

    def _compile(self, row: dict, byte: int) -> tuple:
        """What follows on a byte: the next open prefixes, the tokens that may close, those that may end the word.

        Exactly one token closes and one ends, so of each kind the last, shortest one needs no
        test and stands apart: (after, tested, last token, its width, tested to end, last width to end).
        """
        inner, final = self.merges.inner, self.merges.final
        body = row.get("prefix", b"") + bytes((byte,))
        tails = [body[i:] for i in range(len(body))]
        prefix = next((t for t in tails if t in self._starts), b"")
        after = self._rows.get(prefix)
        if after is None:
            after = self._rows[prefix] = {"prefix": prefix}
        closing = [(inner[t], len(t)) for t in tails if t in inner]
        ending = [(final[t], len(t)) for t in tails if t in final]
        found = row[byte] = (after, tuple(closing[:-1]), *closing[-1], tuple(ending[:-1]), ending[-1][1])
        return found

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of every prefix of a word, by code points: of the first one, the first two, ..., all."""
        known = self._tables[word]
        if known is not None:
            return known
        if word[0] == "'" and len(word) > 2 and word[1].isalpha():  # a shorter prefix is two words
            counts = tuple(sum(self.word(w)[-1] for w in self.words.findall(word[:i])) for i in range(1, len(word)))
            counts += (self._table(word.encode())[-1],)
        else:
            data = word.encode()
            table = self._table(data)
            counts = tuple(table) if len(data) == len(word) else tuple(table[i] for i in _ends(data))
        if len(word) <= 64:
            self._tables.keep(word, counts)
        return counts

    def word_total(self, word: str) -> int:
        """Tokens of a whole word: the table of prefixes that go on, then one step that ends."""
        known = self._of_word[word]
        if known is not None:
            return known
        data, compatible = word.encode(), self.merges.compatible
        row, last, count = self._rows[b""], [-1], [0]
        for byte in data[:-1]:
            row, tested, token, width, _, _ = row.get(byte) or self._compile(row, byte)
            for other, wide in tested:
                before = last[-wide]
                if before < 0 or compatible(before, other):
                    token, width = other, wide
                    break
            count.append(count[-width] + 1)
            last.append(token)
        *_, tested, width = row.get(data[-1]) or self._compile(row, data[-1])
        for other, wide in tested:
            before = last[-wide]
            if before < 0 or compatible(before, other):
                width = wide
                break
        total = count[-width] + 1
        if len(word) <= 64:
            self._of_word.keep(word, total)
        return total

    def _table(self, data: bytes) -> list[int]:
        """Counts of the prefixes as words of their own. What was found for a prefix serves all words that start with it.

        Prefixes stand in a tree by bytes; a node has its children, the open prefix, the token that
        closes there, the tokens up to it, and those of the prefix as a word.
        """
        compatible, compiled, seams = self.merges.compatible, self._compile, self.merges.seams
        if self._nodes > PREFIXES:
            self._tree, self._nodes = {}, 0
        row, children = self._rows[b""], self._tree
        last, count, ended = [-1], [0], []
        at = 0
        for byte in data:
            node = children.get(byte)
            if node is None:
                break
            children, row, token, n, end = node
            last.append(token)
            count.append(n)
            ended.append(end)
            at += 1
        if at == len(data):
            return ended
        for at in range(at, len(data)):
            byte = data[at]
            row, tested, closing, width, ends, end_width = row.get(byte) or compiled(row, byte)
            for token, wide in ends:
                before = last[-wide]
                if before < 0:
                    end_width = wide
                    break
                stands = seams.get(before << 20 | token)
                if compatible(before, token) if stands is None else stands:
                    end_width = wide
                    break
            for token, wide in tested:
                before = last[-wide]
                if before < 0:
                    closing, width = token, wide
                    break
                stands = seams.get(before << 20 | token)
                if compatible(before, token) if stands is None else stands:
                    closing, width = token, wide
                    break
            end = count[-end_width] + 1
            n = count[-width] + 1
            count.append(n)
            last.append(closing)
            ended.append(end)
            if at < DEPTH:
                below: dict = {}
                children[byte] = (below, row, closing, n, end)
                children = below
                self._nodes += 1
        return ended

    def _runs(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text as the tokenizer reads it, in runs; True for a special token."""
        if self.special is None or "<" not in text:
            yield _normal(text), False
            return
        at = 0
        for m in self.special.finditer(text):
            yield _normal(text[at : m.start()]), False
            yield m[0], True
            at = m.end()
        yield _normal(text[at:]), False

    def count(self, text: str) -> int:
        known, total = self._total_of_chunk, 0
        for run, special in self._runs(text):
            if special:
                total += 1
                continue
            if _CONTROL.search(run):  # Python takes these for white space, the pattern does not
                total += sum(map(self.word_total, self.words.findall(run)))
                continue
            for chunk in run.split():
                n = known[chunk]
                if n is None:
                    n = sum(map(self.word_total, self.words.findall(chunk)))
                    if len(chunk) <= 64:
                        known.keep(chunk, n)
                total += n
        return total

    def longest(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens; the table of one word decides."""
        runs = list(self._runs(text))
        if len(runs) > 1:  # special tokens, which a prefix may cut
            return int(np.flatnonzero(self.prefixes(text) <= budget)[-1])
        run, total = runs[0][0], 0
        for m in self.words.finditer(run):
            after = total + self.word_total(m[0])
            if after > budget:
                fits = [i for i, n in enumerate(self.word(m[0]), 1) if total + n <= budget]
                return m.start() + (fits[-1] if fits else 0)
            total = after
        return len(run)

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, 2, ... code points."""
        parts, total = [np.zeros(1, np.int32)], 0
        run_before = ""
        for run, special in self._runs(text):
            if special:  # cut short, its characters are ordinary text after what stands before
                table = self._ordinary(run_before + run)[len(run_before) + 1 :]
                base = total - (self._ordinary(run_before)[-1] if run_before else 0)
                table = table + base
                total += 1
                table[-1] = total
                parts.append(table)
                run_before = ""
            else:
                table = self._ordinary(run)[1:] + total
                if len(table):
                    total = int(table[-1])
                parts.append(table)
                run_before = run
        return np.concatenate(parts)

    def _ordinary(self, run: str) -> np.ndarray:
        if _CONTROL.search(run):  # Python takes these for white space, the pattern does not
            table = _numbers(self._chunk(run)[:-1])
            return np.concatenate([np.zeros(1, np.int32), table])
        chunks, gaps = run.split(), None
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        if lengths.sum() != len(run) + 1:  # else one space after each chunk but the last, and none before the first
            pieces = _SPACE.split(run)  # chunk, white space, chunk, ..., chunk
            chunks = pieces[::2]
            lengths = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
            gaps = np.fromiter(map(len, pieces[1::2]), np.int64, len(chunks) - 1)
        tables = list(map(self._of_chunk.__getitem__, chunks))
        wide = False
        if None in tables:
            for i, table in enumerate(tables):
                if table is None:
                    tables[i] = table = self._chunk(chunks[i])
                    wide = wide or type(table) is not bytes
        flat = np.concatenate(list(map(_numbers, tables))) if wide else _numbers(b"".join(tables))
        ends = np.cumsum(lengths) - 1
        totals = flat[ends]
        flat += np.repeat(np.cumsum(totals, dtype=np.int32) - totals, lengths)
        if gaps is not None and (gaps != 1).any():
            times = np.ones(len(flat), np.int64)
            times[ends[:-1]] = gaps
            flat = np.repeat(flat, times)
        flat[1:] = flat[:-1].copy()  # the place behind the last chunk gives way to that before the first
        flat[0] = 0
        return flat

    def _chunk(self, chunk: str) -> bytes | np.ndarray:
        """Tokens after each code point of what stands between white space, and once more, for the space after it: a byte each, if all fit."""
        known = self._of_chunk[chunk]
        if known is not None:
            return known
        if chunk.isascii() and chunk.isalpha():  # one word
            counts = self._table(chunk.encode())
            counts.append(counts[-1])
        else:
            counts, total = [], 0
            for m in self.words.finditer(chunk):
                gap = m.start() - len(counts)
                if gap:
                    counts += [total] * gap
                word = self.word(m[0])
                counts += [total + n for n in word] if total else word
                total = counts[-1]
            counts += [total] * (len(chunk) + 1 - len(counts))
        if counts[-1] > 255:
            return np.array(counts, np.int32)
        table = bytes(counts)
        if len(chunk) <= 64:
            self._of_chunk.keep(chunk, table)
        return table


def _counter(vocabulary: bytes) -> PrefixCounter:
    """One counter per worker process, so what it remembers serves many tasks."""
    return one_model(PrefixCounter, vocabulary)


def _numbers(table: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(table, np.uint8).astype(np.int32) if type(table) is bytes else table


_CONTROL = regex.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"(\s+)")


def _ends(data: bytes) -> list[int]:
    """Positions of the last bytes of code points."""
    return [i for i in range(len(data)) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80]


def _normal(text: str) -> str:
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # lower case letter by letter, without final forms


def _task(key: str, text: str, vocabulary: Broadcast, budget: int, keep: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            counts, fits, tables = [], [], []
            for t in texts:
                if keep:
                    found = counter.prefixes(t)
                    tables.append(found)
                    n = int(found[-1])
                    fits.append(int(np.flatnonzero(found <= budget)[-1]) if n > budget else None)
                else:
                    n = counter.count(t)
                    fits.append(counter.longest(t, budget) if n > budget else None)
                counts.append(n)
            columns = [batch.column(key), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(fits, pa.int64())]
            names = [key, "n_bytes", "n_tokens", "fit_chars"]
            if keep:
                ends = np.append(0, np.cumsum([len(t) for t in tables])).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tables))))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def token_counts(
    docs: DataFrame, vocabulary_path: str, budget: int = 2048, keep_prefixes: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Token counts of every whole text.

    Columns: ``key``; ``n_bytes`` (UTF-8) and ``n_tokens`` (long); ``fit_chars``, the code points of
    the longest prefix of at most ``budget`` tokens, null where the whole text fits; with
    ``keep_prefixes`` also ``prefix_tokens``, whose element ``i`` (from 0) is the count of the
    first ``i`` code points. One row per row, repeated keys included; other columns are left out.
    A null text counts as empty: 0 bytes, 0 tokens, prefix table ``[0]``. A null key stays null.
    An empty table gives an empty table.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, fit_chars bigint"
    if keep_prefixes:
        schema += ", prefix_tokens array<int>"
    vocabulary = file_broadcast(docs.sparkSession, vocabulary_path)
    return arrow_map(docs.select(key, text), _task(key, text, vocabulary, budget, keep_prefixes), schema)


def tokens_of_prefix(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points, from a stored table."""
    return F.get(prefix_tokens, F.least(chars, F.size(prefix_tokens) - 1))


def longest_within(prefix_tokens: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from a stored table."""
    fits = F.transform(prefix_tokens, lambda n: n <= budget)
    return F.size(prefix_tokens) - F.array_position(F.reverse(fits), F.lit(True))
