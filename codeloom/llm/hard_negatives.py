"""Hard-negative mining by inner product, with coordinate pruning in length buckets.

Rows are ordered by length and cut into blocks, so a block is a length bucket or a part of one. A block is
stored with a sorted list per coordinate of its unit vectors. An anchor that needs a score of at least
``s`` needs a cosine of at least ``s / (|anchor| * longest row)`` in a block; so each of its focus
coordinates (its largest) bounds the same coordinate of the row from both sides. The feasible ranges
are looked up in the sorted lists and intersected, and only rows in all of them are verified, in whole
numbers. Needed scores rise while a task goes from long rows to short ones.

Two passes: the best positives of each anchor, then, for each positive, the best negatives in its
window of scores. Anchors are sent to all blocks in broadcast parts of ``ANCHORS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, gathered, scratch, stored

# Rows of a block, and bytes of its matrix at 8 a component, whichever is less.
BLOCK = 4096
BLOCK_BYTES = 32 << 20
# Anchors that are broadcast at a time, and those whose scores with a block are held at a time.
ANCHORS = 8192
AT_ONCE = 512
FOCUS = 4
# A range that keeps more than this share of a block prunes too little to be worth an intersection.
WIDE = 0.25
_SLACK = 1e-9
_FAR = 1 << 62
# Beyond any score, with room for a score times a hundred.
_LIMIT = 1 << 55


@dataclass
class Block:
    """Rows of similar length, by ascending id, null last; ``order`` has the rows by each unit coordinate."""

    first: int
    ids: pa.Array
    labels: np.ndarray
    matrix: np.ndarray
    order: np.ndarray

    def __post_init__(self) -> None:
        self.lengths = np.sqrt((self.matrix.astype(np.float64) ** 2).sum(axis=1))
        self.lists = np.take_along_axis(unit(self.matrix, self.lengths).T, self.order.astype(np.int64), axis=1)
        self.rank = self.ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.null = self.ids.is_null().to_numpy(zero_copy_only=False)

    def candidates(self, anchors: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Anchors for which the whole block is to be verified, and (anchor, rows) for the others that have candidates."""
        longest, shortest = self.lengths.max(), self.lengths.min()
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = least / (lengths * np.where(least > 0, longest, shortest))
        needed = np.where(np.isnan(needed), 0.0, needed) - _SLACK  # a zero length: scores are 0, so 0 is needed at most
        focus = np.argsort(-np.abs(anchors), axis=1, kind="stable")[:, :FOCUS]
        low, high = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(self.labels))
        cosine = np.clip(needed, -1, 1)
        for coordinate in np.unique(focus):
            a, k = np.nonzero(focus == coordinate)
            q = np.divide(anchors[a, coordinate], lengths[a], out=np.zeros(len(a)), where=lengths[a] > 0)
            reach = np.sqrt(np.maximum((1 - cosine[a] ** 2) * (1 - q**2), 0)) + _SLACK
            # Below a cosine of -1 all rows are feasible.
            free = needed[a] <= -1
            low[a, k] = np.where(free, 0, np.searchsorted(self.lists[coordinate], q * cosine[a] - reach, "left"))
            high[a, k] = np.where(free, len(self.labels), np.searchsorted(self.lists[coordinate], q * cosine[a] + reach, "right"))
        some = needed <= 1
        narrow = ((high - low) <= WIDE * len(self.labels)).any(axis=1)
        pruned = []
        for a in np.flatnonzero(some & narrow):
            rows = None
            for k in np.argsort(high[a] - low[a]):
                feasible = self.order[focus[a, k], low[a, k] : high[a, k]]
                rows = feasible if rows is None else np.intersect1d(rows, feasible, assume_unique=True)
            if len(rows):
                pruned.append((int(a), np.sort(rows).astype(np.int64)))
        return np.flatnonzero(some & ~narrow), pruned


def unit(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return matrix / np.where(lengths > 0, lengths, 1)[:, None]


@dataclass
class Anchors:
    """Anchors with up to ``windows`` score windows each; an absent one has its low end beyond its high one."""

    rows: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool  # partners have the anchor's label, or another one


class Best:
    """The ``k`` best partners per window so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, anchors: Anchors, k: int) -> None:
        self.anchors, self.k = anchors, k
        self.lengths = np.sqrt((anchors.matrix.astype(np.float64) ** 2).sum(axis=1))
        self.found = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]  # window, score, row, id, whether the id is null
        self.bar = anchors.low.copy()

    def _verified(self, block: Block, part: slice, exact: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row of the block, score) where the score is at least what some window needs."""
        vectors = self.anchors.matrix[part]
        least = self.bar[part].min(axis=1)
        whole, pruned = block.candidates(vectors.astype(np.float64), self.lengths[part], least.astype(np.float64))
        matrix = block.matrix.astype(exact)
        if len(whole):
            scores = vectors[whole].astype(exact) @ matrix.T
            a, row = np.nonzero(scores >= least[whole, None])
            yield whole[a] + part.start, row, scores[a, row].astype(np.int64)
        for a, rows in pruned:
            scores = (matrix[rows] @ vectors[a].astype(exact)).astype(np.int64)
            kept = scores >= least[a]
            yield np.full(kept.sum(), a + part.start), rows[kept], scores[kept]

    def take(self, block: Block, exact: type) -> None:
        for start in range(0, len(self.anchors.rows), AT_ONCE):
            parts = [*self._verified(block, slice(start, start + AT_ONCE), exact)]
            if parts:
                self._merge(block, *(np.concatenate(p) for p in zip(*parts, strict=True)))

    def _merge(self, block: Block, a: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        fits = (block.labels[row] == self.anchors.labels[a]) == self.anchors.same
        fits &= block.first + row != self.anchors.rows[a]
        a, row, score = a[fits], row[fits], score[fits]
        windows = self.bar.shape[1]
        for w in range(windows):
            mine = (score >= self.bar[a, w]) & (score <= self.anchors.high[a, w])
            at = row[mine]
            new = [a[mine] * windows + w, score[mine], block.first + at, block.rank[at], block.null[at]]
            self.found = [np.concatenate(pair) for pair in zip(self.found, new, strict=True)]
        window, score, number, rank, null = self.found
        order = np.lexsort((number, rank, null, -score, window))
        window = window[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        kept = order[place < self.k]
        self.found = [column[kept] for column in self.found]
        full = order[place == self.k - 1]
        # A window that is full needs a score of at least its last one.
        bar = self.bar.reshape(-1)
        bar[window[place == self.k - 1]] = score[full]


def _index(rows: DataFrame, dims: int, folder: str, total: int) -> DataFrame:
    """Blocks of rows by falling length, with their sorted coordinate lists, written to ``folder``."""
    size = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dims, 1))))
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    dealt = rows.withColumn("length", length).repartitionByRange(-(-total // size), F.desc("length"), "id")
    names = ["first", "ids", "labels", "anchors", "matrix", "lists"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for table in gathered(batches, size):
            table = table.take(pc.sort_indices(table, [("id", "ascending")]))  # nulls last
            columns = {n: table[n].combine_chunks() for n in table.column_names}
            vectors = columns["vector"]
            held = np.diff(vectors.offsets.to_numpy())
            matrix = np.zeros((len(vectors), dims), np.int64)
            matrix[np.arange(dims) < held[:, None]] = vectors.flatten().to_numpy()
            lists = np.argsort(unit(matrix, np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))), axis=0, kind="stable").T
            kind = np.int32 if not matrix.size or np.abs(matrix).max() < 1 << 31 else np.int64
            nested = [pa.ListArray.from_arrays([0, len(vectors)], columns[n]) for n in ("id", "label", "anchor")]
            binary = [pa.array([m.tobytes()], pa.binary()) for m in (matrix.astype(kind), lists.astype(np.uint16))]
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *nested, *binary], names)
            first += len(vectors)

    schema = "first bigint, ids array<bigint>, labels array<bigint>, anchors array<boolean>, matrix binary, lists binary"
    arrow_map(dealt.sortWithinPartitions(F.desc("length")).drop("length"), task, schema).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _block(batch: pa.RecordBatch, at: int, dims: int) -> Block:
    ids, labels = batch["ids"][at].values, batch["labels"][at].values.to_numpy()
    data = batch["matrix"][at].as_buffer()
    kind = np.int32 if data.size == 4 * len(ids) * dims else np.int64
    matrix = np.frombuffer(data, kind).reshape(len(ids), dims)
    order = np.frombuffer(batch["lists"][at].as_buffer(), np.uint16).reshape(dims, len(ids))
    return Block(batch["first"][at].as_py(), ids, labels, matrix, order)


def _anchors(index: DataFrame, dims: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = _block(batch, at, dims)
                chosen = np.flatnonzero(batch["anchors"][at].values.to_numpy(zero_copy_only=False))
                vectors = [block.matrix[i].astype(np.int64).tobytes() for i in chosen]
                arrays = [pa.array(block.first + chosen, pa.int64()), block.ids.take(pa.array(chosen)), pa.array(block.labels[chosen])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(vectors, pa.binary())], ["row", "anchor_id", "label", "vector"])

    return stored(arrow_map(index, task, "row bigint, anchor_id bigint, label bigint, vector binary"))


def _search(index: DataFrame, asked: pa.Table, dims: int, k: int, same: bool, exact: type) -> DataFrame:
    """(row, window, score, partner, partner_id): the ``k`` best of each task for each window of the anchors ``asked``."""
    lows, highs = asked["low"].combine_chunks(), asked["high"].combine_chunks()
    held = np.diff(lows.offsets.to_numpy())
    present = np.arange(max(held.max(initial=0), 1)) < held[:, None]
    low, high = np.full(present.shape, _FAR), np.full(present.shape, -_FAR)
    low[present], high[present] = lows.flatten().to_numpy(), highs.flatten().to_numpy()
    matrix = np.frombuffer(b"".join(asked["vector"].to_pylist()), np.int64).reshape(len(held), dims)
    shared = index.sparkSession.sparkContext.broadcast(
        Anchors(asked["row"].to_numpy(), asked["label"].to_numpy(), matrix, low, high, same)
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, k)
        for batch in batches:
            for at in range(batch.num_rows):
                best.take(_block(batch, at, dims), exact)
        window, score, row, rank, null = best.found
        owner, number = np.divmod(window, shared.value.low.shape[1])
        arrays = [pa.array(shared.value.rows[owner]), pa.array(number), pa.array(score), pa.array(row), pa.array(rank, mask=null)]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "window", "score", "partner", "partner_id"])

    found = arrow_map(index, task, "row bigint, window bigint, score bigint, partner bigint, partner_id bigint")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc_nulls_last("partner_id"), "partner")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, vector) of whole numbers.

    Scores are inner products, a shorter vector standing for one with zeros behind it. An anchor's positives are the
    best other rows of its label; a positive's negatives the best rows of other labels whose score is between
    ``low_percent`` of the positive's and the positive's (so none where that is negative). Equal scores go by smaller
    id, null last. Each row stands for itself, also one that is repeated: a copy of an anchor can be its positive.
    Rows with a null label, vector or component take no part; other columns are ignored. Anchors without positives
    or negatives, and an empty table, give no rows. Components whose scores might not fit 55 bits are an error.
    """
    spark = vectors.sparkSession
    whole = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    chosen = F.coalesce(anchor, F.lit(False)).alias("anchor")
    rows = vectors.where(whole).select(F.col("id").cast("bigint"), F.col("label").cast("bigint"), "vector", chosen)
    widest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    total, dims, top = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(widest), F.lit(0.0))).first()
    bound = dims * (top + 1) ** 2
    if bound >= _LIMIT:
        raise ValueError(f"scores of {dims} components of up to {top:g} may not fit 55 bits")
    exact = np.float64 if bound < 1 << 53 else np.int64
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not total:
        return spark.createDataFrame([], result)
    with scratch(spark) as folder:
        index = _index(rows, dims, folder + "/index", total)
        anchors = _anchors(index, dims)
        parts = max(1, -(-anchors.count() // ANCHORS))
        for part in range(parts):
            asked = anchors.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part)
            window = [F.array(F.lit(x).cast("bigint")).alias(n) for x, n in ((-_FAR, "low"), (_FAR, "high"))]
            found = _search(index, asked.select("row", "label", "vector", *window).toArrow(), dims, positives, True, exact)
            best = found.select(
                "row", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("partner_id").alias("positive_id"), F.col("score").alias("positive_score")
            )
            best = stored(best)
            # The least whole number that is at least ``low_percent`` of the score.
            low = F.expr(f"(positive_score * {low_percent} + 99) div 100")
            by_anchor = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("window", low.alias("low"), F.col("positive_score").alias("high")))).alias("w"))
            windows = asked.join(by_anchor, "row").select(
                "row", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high")
            )
            found = _search(index, windows.toArrow(), dims, negatives, False, exact)
            named = found.join(best, ["row", "window"]).join(asked.select("row", "anchor_id"), "row")
            named.select(
                "anchor_id", "positive_id", "rank", F.col("partner_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ).write.mode("append").parquet(folder + "/found")
        return stored(spark.read.schema(result).parquet(folder + "/found"))
