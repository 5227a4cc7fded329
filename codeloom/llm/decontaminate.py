"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training token windows.

Words are numbered by the benchmark's own vocabulary; a window can only occur where every word
has a number. Such places are hashed by a rolling sum and looked up in the set of window
hashes; hits are verified word by word. A benchmark beyond ``BLOCK_BYTES`` is cut into
blocks. They are fetched, broadcast and scanned one after the other, and the rows with what was
found so far are stored between them, so the driver and each task hold one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import LOWER_ASCII, arrow_map, slices, stored

WINDOW = 10
BLOCK_BYTES = 16 << 20
# Fixed value: bytes that are not part of a word.
GAPS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in set(GAPS) else LOWER_ASCII[b] for b in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Matcher:
    """Finds the windows of a block of test items in lists of words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        self.owners: dict[int, dict[tuple[int, ...], set[str]]] = {}  # length -> window -> items
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            width = min(window, len(ids))
            for i in range(len(ids) - width + 1 if width else 0):
                self.owners.setdefault(width, {}).setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.hashes = {
            width: np.sort(self._hash(np.array(list(found), np.uint64).T)) for width, found in sorted(self.owners.items())
        }

    @staticmethod
    def _hash(columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            total = (total + column) * _FACTOR
            total ^= total >> np.uint64(29)
        return total

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words that windows cover, joined where they meet, and the items found."""
        get = self.numbers.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        misses = np.concatenate([[0], np.cumsum(ids == 0)])
        starts: list[tuple[int, int]] = []
        items: set[str] = set()
        for width, hashes in self.hashes.items():
            if len(ids) < width:
                continue
            full = np.flatnonzero(misses[width:] == misses[:-width])
            if not len(full):
                continue
            found = self._hash([ids[full + i] for i in range(width)])
            at = np.searchsorted(hashes, found)
            at[at == len(hashes)] = 0
            for i in full[hashes[at] == found].tolist():
                owners = self.owners[width].get(tuple(ids[i : i + width].tolist()))
                if owners:  # the words are the same, not only their hash
                    items |= owners
                    starts.append((i, i + width))
        return _joined(starts), items


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


def _scan_task(columns: list[str], text: str, block: Broadcast, first: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value)
        for batch in slices(batches):
            n_words, n_hit, items, spans = [], [], [], []
            before = [((), ())] * batch.num_rows
            if not first:
                before = zip(batch.column("items").to_pylist(), batch.column("spans").to_pylist(), strict=True)
            for value, (old_items, old_spans) in zip(batch.column(text).to_pylist(), before, strict=True):
                words = words_of(value) if value else []
                found, names = matcher.scan(words)
                found = _joined([*found, *((s["start"], s["end"]) for s in old_spans)])
                n_words.append(len(words))
                n_hit.append(sum(end - start for start, end in found))
                items.append(sorted(names.union(old_items)))
                spans.append([{"start": s, "end": e} for s, e in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=[*columns, "n_words", "n_hit", "items", "spans"],
            )

    return task


def benchmark_blocks(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The distinct test items in blocks of about ``block_bytes``, by a hash of their text; and whether a block is the last.

    An item without id is named ''. A block is fetched when it is asked for.
    """
    items = benchmark.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    items = stored(items.distinct())
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for b in range(blocks):
        yield [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == b).collect()], b == blocks - 1


def contamination(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``columns`` of ``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted ids of the items found) and ``spans`` of hit words.

    A window is ``WINDOW`` consecutive words of a test item, or all its words if it has fewer.
    Null and empty texts have no words, on either side. Every row stays, repeated ones too;
    with an empty benchmark nothing is hit. Columns of ``docs`` other than ``columns`` are left
    out; those named must not be called like the new ones.
    """
    spark = docs.sparkSession
    columns = columns or ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    carried = list(dict.fromkeys([*columns, text]))
    full = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    found = docs.select(*carried)
    first = True
    for items, last in benchmark_blocks(benchmark, text="text", block_bytes=block_bytes):
        block = spark.sparkContext.broadcast(items)
        found = arrow_map(found, _scan_task(columns if last else carried, text, block, first), f"{head if last else full}, {_FOUND}")
        if not last:
            found = stored(found)
            block.unpersist()
        first = False
    return found


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    kept.append(text[at:])
    return "".join(kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``) or without the hit words (``"spans"``); same columns."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = contamination(renamed, benchmark, list(names.values()), names[text])
    back = [F.col(n).alias(c) for c, n in names.items()]
    if remove == "documents":
        return found.where("n_hit = 0").select(*back)
    schema = renamed.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [
                without_spans(t, [(s["start"], s["end"]) for s in spans]) if t and spans else t
                for t, spans in zip(batch.column(names[text]).to_pylist(), batch.column("spans").to_pylist(), strict=True)
            ]
            columns = [pa.array(texts, pa.string()) if n == names[text] else batch.column(n) for n in names.values()]
            yield pa.RecordBatch.from_arrays(columns, names=list(names.values()))

    return found.mapInArrow(cut, schema).select(*back)
