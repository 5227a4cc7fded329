"""Substring deduplication by prefix-partitioned suffix trees over words.

A window is ``WINDOW`` consecutive words. Each window's anchor is the least hash among its
``PREFIX``-word prefixes of suffixes; equal windows have equal anchors at equal places, so
suffixes are grouped by the prefix at their anchor, and neighbouring windows with one anchor
travel as one segment.

1. Count, per prefix, the documents and the different segments. A prefix of one document
   repeats nothing. Copies of one whole segment are settled by its smallest document.
2. What is left are prefixes with different segments. A prefix whose segments fit in memory
   (``GROUP_ROWS``) becomes a subtree: its suffixes are sorted, and neighbours whose common
   prefix is at least a window long lie below one deep internal node, a repeat.
3. A larger prefix is lengthened to whole windows. Below such a long prefix only the smallest
   document matters, which is an aggregate, so no group is ever held.
4. Documents lose the words of repeated windows that also start in a smaller document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, hot_split_join, slices, stored

WINDOW = 50
PREFIX = 8
# Segments of one prefix that are sorted in memory (about 600 bytes each).
GROUP_ROWS = 4096
# Prefixes too large for that are listed to all tasks up to this number, else joined.
LISTED = 200_000
# Words of a text that are looked at together; longer texts go in overlapping stretches.
STRETCH = 1 << 22
_MASK = np.uint64((1 << 24) - 1)
_STEP, _STEP2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_NO_ID = (1 << 63) - 1  # orders rows without id after all others


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Powers:
    """Powers of an odd step and of its inverse, modulo 2^64."""

    def __init__(self, step: np.uint64) -> None:
        self.step = step
        self.back = np.uint64(pow(int(step), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.step)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.back)]), dtype=np.uint64)
        return self.up, self.down


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the word sequences ``[start, end)``."""
    up, down = powers.upto(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes) * up[: len(hashes)], dtype=np.uint64)])
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def segments(hashes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and prefix hash of every segment of a text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if n > STRETCH:
        parts = [segments(hashes[i : i + STRETCH + window - 1], window, prefix) for i in range(0, n, STRETCH)]
        firsts = np.concatenate([p[0] + i * STRETCH for i, p in enumerate(parts)])
        return firsts, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    grams = np.zeros(len(hashes) - prefix + 1, np.uint64)
    for i in range(prefix):
        grams = (grams ^ hashes[i : len(hashes) - prefix + 1 + i]) * _STEP
        grams ^= grams >> np.uint64(31)
    grams = _mixed(grams)
    least = (grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64)
    width, have = window - prefix + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchors = (least & _MASK).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return firsts, np.diff(np.append(firsts, n)), grams[anchors[firsts]]


def _anchor_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers(_STEP)
    for batch in slices(batches):
        parts = []
        docs, marks = batch.column("doc").to_pylist(), batch.column("mark").to_pylist()
        for doc, mark, text in zip(docs, marks, batch.column("text").to_pylist(), strict=True):
            hashes = word_hashes(text.encode().split()) if text else ()
            if len(hashes) < WINDOW:
                continue
            first, count, prefix = segments(hashes)
            whole = span_hashes(hashes, first, first + count + WINDOW - 1, powers)
            parts.append((prefix.view(np.int64), whole.view(np.int64), np.full(len(first), doc), np.full(len(first), mark, np.int32), first * 64 + count))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["prefix", "whole", "doc", "mark", "place"])


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
    for doc, mark, text, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "places")), strict=True):
        yield doc, mark, word_hashes(text.encode().split()), sorted(set(places))


def _segment_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their words, for subtrees."""
    for batch in slices(batches):
        rows = []
        for doc, mark, hashes, places in _wanted(batch):
            first, count, prefix = segments(hashes)
            at = np.searchsorted(first, [p // 64 for p in places])
            for place, i in zip(places, at.tolist(), strict=True):
                start, n = int(first[i]), int(count[i])
                rows.append((int(prefix[i].astype(np.int64)), doc, mark, place, hashes[start : start + n + WINDOW - 1].astype(">u8").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                names=["prefix", "doc", "mark", "place", "words"],
            )


def _window_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows by two hashes of all their words, for prefixes too large to hold."""
    one, two = Powers(_STEP), Powers(_STEP2)
    for batch in slices(batches, 64):
        parts = []
        for doc, mark, hashes, places in _wanted(batch):
            starts = np.concatenate([np.arange(p // 64, p // 64 + p % 64) for p in places])
            keys = [span_hashes(hashes, starts, starts + WINDOW, p).view(np.int64) for p in (one, two)]
            parts.append((*keys, np.full(len(starts), doc), np.full(len(starts), mark, np.int32), starts))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["h1", "h2", "doc", "mark", "start"])


def deep_nodes(suffixes: list[tuple[bytes, int]], depth: int) -> Iterator[list[int]]:
    """The suffixes below each internal node at least ``depth`` bytes deep, by their numbers.

    Sorted suffixes with the common prefixes of neighbours are the tree in flat form: suffixes
    whose neighbours all share ``depth`` bytes lie below one node of that depth.
    """
    suffixes.sort()
    node: list[int] = []
    before = b""
    for suffix, number in suffixes:
        if node and suffix[:depth] != before:
            if len(node) > 1:
                yield node
            node = []
        before = suffix[:depth]
        node.append(number)
    if len(node) > 1:
        yield node


def _repeats(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """Document, mark, first and last of the runs of windows that a smaller document has too."""
    suffixes, owners = [], []
    for doc, mark, place, words in group:
        for i in range(place % 64):
            suffixes.append((words[8 * i :], len(owners)))
            owners.append((doc, mark, place // 64 + i))
    found: dict[tuple[int, int], list[int]] = {}
    for node in deep_nodes(suffixes, 8 * WINDOW):
        least = min(owners[k][0] for k in node)
        for k in node:
            doc, mark, window = owners[k]
            if doc > least:
                found.setdefault((doc, mark), []).append(window)
    for (doc, mark), windows in found.items():
        windows.sort()
        first = last = windows[0]
        for w in windows[1:]:
            if w > last + 1:
                yield doc, mark, first, last
                first = w
            last = w
        yield doc, mark, first, last


def _subtree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by prefix: one subtree at a time."""
    out: list[tuple[int, int, int, int]] = []
    group, prefix = [], None

    def emit() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc", "mark", "first", "last"])

    for batch in slices(batches, 1024):
        for p, *row in zip(*(batch.column(c).to_pylist() for c in ("prefix", "doc", "mark", "place", "words")), strict=True):
            if p != prefix:
                if len(group) > 1:
                    out.extend(_repeats(group))
                group, prefix = [], p
            group.append(tuple(row))
        if len(out) > 5000:
            yield emit()
    if len(group) > 1:
        out.extend(_repeats(group))
    if out:
        yield emit()


_RUN = "doc bigint, mark int, first bigint, last bigint"


def repeated_runs(texts: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Runs of windows (``first`` to ``last``) that also start in a smaller document, by ``doc`` and ``mark``."""
    anchors = arrow_map(texts.select("doc", "mark", "text"), _anchor_task, "prefix bigint, whole bigint, doc bigint, mark int, place bigint")
    by_prefix = anchors.groupBy("prefix").agg(
        F.min("doc").alias("least"), F.max("doc").alias("most"), (F.min("whole") == F.max("whole")).alias("alike"), F.count(F.lit(1)).alias("n")
    )
    by_prefix = stored(by_prefix.where("least < most").drop("most"))
    total = by_prefix.agg(F.sum("n")).first()[0] or 0
    shared = stored(hot_split_join(anchors, by_prefix, ["prefix"], "n", total))
    settled = shared.where("alike and doc > least")
    mixed = shared.where("not alike").select("prefix", "whole", "doc", "mark", "place")
    by_segment = mixed.groupBy("prefix", "whole").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    owned = stored(hot_split_join(mixed, by_segment, ["prefix", "whole"], "n", total))
    copies = owned.where("doc > least")
    kept = owned.where("doc = least").select("prefix", "doc", "mark", "place")
    sizes = kept.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    large = stored(sizes.where(F.col("size") > group_rows).select("prefix", F.lit(True).alias("large")))
    listed = large.count() <= LISTED
    marked = kept.join(F.broadcast(large) if listed else large, "prefix", "left")

    def with_text(rows: DataFrame) -> DataFrame:
        # All columns stay, keys are never null: so Spark shuffles the texts once for this and for the final cut.
        places = rows.groupBy("doc", "mark").agg(F.collect_list("place").alias("places"))
        return texts.join(places, ["doc", "mark"])

    small = with_text(marked.where("large is null"))
    cut = arrow_map(small, _segment_task, "prefix bigint, doc bigint, mark int, place bigint, words binary")
    ordered = cut.repartition("prefix").sortWithinPartitions("prefix")
    runs = arrow_map(ordered, _subtree_task, _RUN)
    whole = settled.select("doc", "mark", "place").unionByName(copies.select("doc", "mark", "place"))
    runs = runs.unionByName(
        whole.selectExpr("doc", "mark", "place div 64 as first", "place div 64 + place % 64 - 1 as last")
    )
    if large.isEmpty():
        return runs
    lengthened = marked.where("large")
    windows = arrow_map(with_text(lengthened), _window_task, "h1 bigint, h2 bigint, doc bigint, mark int, start bigint")
    by_window = windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n"))
    by_window = by_window.where("least < most").drop("most")
    count = lengthened.selectExpr("sum(place % 64)").first()[0] or 0
    again = hot_split_join(windows, by_window, ["h1", "h2"], "n", count).where("doc > least")
    return runs.unionByName(again.select("doc", "mark", F.col("start").alias("first"), F.col("start").alias("last")))


def _cut_task(columns: list[str], as_was: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, counts, removed = [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = text.encode().split() if text else []
                counts.append(len(words))
                if runs:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, [r["first"] for r in runs], 1)
                    np.add.at(gone, [r["last"] + WINDOW for r in runs], -1)
                    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    removed.append(len(words) - len(left))
                    words = [words[i] for i in left.tolist()]
                else:
                    removed.append(0)
                kept.append(text.encode() if as_was and text and not removed[-1] else None if as_was and text is None else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[*columns, "n_words", "n_removed", "kept"],
            )

    return task


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS, carry: list[str] | None = None, as_was: bool = False
) -> DataFrame:
    """``key`` (and ``carry``) with ``n_words``, ``n_removed`` and ``kept``, the words left joined by one space.

    With ``as_was`` a text that loses nothing is kept as it was, null included.
    Removed is every word covered by a window whose words also start, as a window, in a row
    with a smaller key; repeats within one row, or between rows of one key, remove nothing.
    Rows without key come after all others and lose what any of those has. Null texts and
    texts of fewer words than a window lose nothing. Every row stays, repeated ones too; other
    columns are left out. An empty table gives an empty table.
    """
    columns = list(dict.fromkeys([key, *(carry or [])]))
    named = {c: f"c{i}" for i, c in enumerate(columns)}
    texts = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in named.items()],
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_NO_ID)).alias("doc"),
        F.coalesce(F.pmod(F.xxhash64(f"`{text}`"), F.lit(1 << 31)).cast("int"), F.lit(0)).alias("mark"),
        F.col(f"`{text}`").alias("text"),
    )
    runs = repeated_runs(texts, group_rows).groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in named.values()), "n_words bigint, n_removed bigint, kept string"])
    done = arrow_map(texts.join(runs, ["doc", "mark"], "left"), _cut_task(list(named.values()), as_was), schema)
    return done.select(*[F.col(n).alias(c) for c, n in named.items()], "n_words", "n_removed", "kept")


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with texts that have lost their repeated words; same columns. ``length``, if present, follows the text."""
    others = [c for c in docs.columns if c != text]
    done = remove_repeats(docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)], F.col(f"`{text}`").alias("t")),
                          f"k{others.index(key)}", "t", carry=[f"k{i}" for i in range(len(others))], as_was=True)
    out = {text: F.col("kept")} | {c: F.col(f"k{i}") for i, c in enumerate(others)}
    if length in out and length != key:
        out[length] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(out[length]).cast(docs.schema[length].dataType)
    return done.select(*[out[c].alias(c) for c in docs.columns])
