"""Packing token sequences by minimum bin slack.

Which pieces share a sequence depends on their lengths only, and there are at most ``capacity``
lengths. So the pieces are counted by length, and bins are chosen from the counts: a bin takes
the longest piece left and, with it, the fullest combination of the lengths still available,
found by subset-sum dynamic programming on bitsets. The same combination is removed as often as
the counts allow, after which fewer of some length are left than a bin had. A length can do so
once, and once for each of the at most ``capacity / length`` left; so there are at most about
``capacity * (1 + ln(capacity))`` combinations, however many pieces there are. Pieces then find
their place by their rank within their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm.common import arrow_map, file_broadcast, one_model, slices, stored
from codeloom.session import BROADCAST_ROWS

CAPACITY = 2048
END = 0
# The pre-tokenizer's own pattern, which byte-level vocabularies of this kind have in common: fixed value.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
Encode = Callable[[list[str]], list[np.ndarray]]


def _byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _ranks(parts: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if its ids follow the order of its merges and its text is split by ``_PATTERN``."""
    before, model = parts.get("pre_tokenizer") or {}, parts["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or parts.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    added = {t["content"] for t in parts["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]):
        return None
    vocabulary = {w: i for w, i in model["vocab"].items() if w not in added}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocabulary.get(w, -1) for w in merged]
    letters = _byte_letters()
    if ids != sorted(ids) or len(vocabulary) != len(merged) + 256 or not all(c in vocabulary for c in letters):
        return None
    return {bytes(letters[c] for c in w): i for w, i in vocabulary.items()}


def encoder(vocabulary: bytes) -> Encode:
    """Token ids as the ``tokenizers`` library gives them, special strings included and none added.

    A byte-level vocabulary whose ids are ranks gives the same ids through ``tiktoken``, which is
    several times faster; any other goes through ``tokenizers``.
    """
    parts = json.loads(vocabulary)
    if (ranks := _ranks(parts)) is not None:
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        fast = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [fast.encode_to_numpy(t, allowed_special="all") for t in texts]
    library = Tokenizer.from_buffer(vocabulary)
    return lambda texts: [np.array(e.ids, np.uint32) for e in library.encode_batch(texts, add_special_tokens=False)]


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all are full but the first, which takes what is left over."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies by length, how often) for all pieces counted by length: each bin is the fullest that holds the longest piece left."""
    left = dict(counts)
    order = sorted(left, reverse=True)
    found = []
    while order:
        longest = order[0]
        room = capacity - longest
        full, reach, steps = 1 << room, 1, []
        for size in order:
            copies = min(left[size] - (size == longest), room // size)
            chunk = 1
            while copies > 0 and not reach & full:
                taken = min(chunk, copies)
                steps.append((size, taken, reach))
                reach |= (reach << size * taken) & ((full << 1) - 1)
                copies -= taken
                chunk *= 2
            if reach & full:
                break
        total = reach.bit_length() - 1
        chosen = {longest: 1}
        for size, taken, before in reversed(steps):
            if not before >> total & 1:
                chosen[size] = chosen.get(size, 0) + taken
                total -= size * taken
        times = min(left[size] // copies for size, copies in chosen.items())
        for size, copies in chosen.items():
            left[size] -= copies * times
        found.append((chosen, times))
        order = [size for size in order if left[size]]
    return found


def _places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted: where the pieces of a length go, by rank."""
    ranks, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for chosen, times in combinations(counts, capacity):
        offset = 0
        for size, copies in chosen.items():
            rows.append((size, ranks[size], copies, sequence, offset))
            ranks[size] += copies * times
            offset += copies * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], task, nth): every document's ids and the ``end`` id, cut to ``capacity``.

    ``task`` and ``nth`` number the pieces of one length within a task. A null text is an empty one, which
    is the ``end`` id alone; each row is a document, also one whose key is null or repeated.
    """
    blob = file_broadcast(docs.sparkSession, vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(blob.value)
        seen = np.zeros(capacity + 1, np.int64)
        number = TaskContext.get().partitionId()
        for batch in slices(batches):
            rows, out = [], []
            for row, ids in enumerate(encode(pc.fill_null(batch.column(1), "").to_pylist())):
                ids = np.append(ids, end).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append(row)
                    out.append((piece, start, length, zlib.crc32(part.tobytes()), seen[length], part))
                    seen[length] += 1
            values = [*zip(*out, strict=True)] or [()] * 6
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(values[0], pa.int32())]
            columns += [pa.array(v, pa.int64()) for v in values[1:4]]
            if keep_ids:
                flat = np.concatenate(values[5]).astype(np.int32) if out else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(values[2])).astype(np.int32), pa.array(flat)))
            columns += [pa.array(np.full(len(rows), number), pa.int32()), pa.array(values[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start bigint, length bigint, ids_crc32 bigint, {'ids array<int>, ' * keep_ids}task int, nth bigint"
    names = [part.split()[0] for part in schema.split(", ")]
    return arrow_map(docs.select("doc_id", "text"), task, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence that holds them and their offset in it.

    Result per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids with ``keep_ids``. A
    sequence has at most ``capacity`` ids; its pieces follow each other without gaps. Other columns of ``docs``
    are ignored. An empty table gives no pieces.
    """
    cut = stored(pieces(docs, vocabulary, capacity, end, keep_ids))
    by_task = stored(cut.groupBy("length", "task").agg(F.count("*").alias("held")))
    counts = {r["length"]: r["held"] for r in by_task.groupBy("length").agg(F.sum("held").alias("held")).collect()}  # at most ``capacity``
    places = docs.sparkSession.sparkContext.broadcast(_places(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    if by_task.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    columns = [c for c in cut.columns if c not in ("task", "nth")]
    ranked = cut.join(bases, ["length", "task"]).select(*columns, (F.col("base") + F.col("nth")).alias("rank"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            # The row of the length's last first rank that is not beyond the piece's.
            at = np.zeros(len(length), np.int64)
            for size in np.unique(length):
                low, high = np.searchsorted(table[:, 0], [size, size + 1])
                mine = length == size
                at[mine] = low + np.searchsorted(table[low:high, 1], rank[mine], "right") - 1
            _, first, copies, sequence, offset = table[at].T
            turn, copy = np.divmod(rank - first, np.maximum(copies, 1))
            placed = [pa.array(sequence + turn), pa.array(offset + copy * length)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *placed], [*columns, "sequence_id", "offset"])

    return arrow_map(ranked, task, ranked.drop("rank").schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with ``keep_ids``: one row per sequence, which is never longer than the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
