"""Ranked lexical search over posting lists in geometric blocks.

The documents are indexed in shards, one task's rows at a time. Within a shard every term's posting list
is clustered by the similarity of its documents: pivots are taken from the list and each document joins
the nearest one, by low-dimensional projections of the term vectors. A cluster, cut to ``BLOCK`` documents,
is a block. Its summary holds, for each term that some query asks for together with the list's own, the exact
maximum over the block's documents. A query bounds each block of its terms by its summary, takes blocks by
falling bound, and skips those whose bound is below the worst score it still keeps. Bounds are never below
a score, so the ranking is that of all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_map, gathered, scratch, slices, stored

# Documents of a shard, and of a block of one posting list.
SHARD = 4096
BLOCK = 128
# A posting list gets a pivot for so many of its documents.
PER_PIVOT = 64
# Numbers by which documents are compared when a posting list is clustered.
DIRECTIONS = 32
# Terms that one shard holds as columns; queries are put in groups of no more (a longer query is a group of its own).
GROUP_TERMS = 4096
# Query text, in bytes, that is broadcast at a time.
QUERY_BYTES = 16 << 20

# Terms are runs of digits, lower-cased letters and bytes beyond ASCII: fixed rule.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


class Group:
    """Queries that are answered together: their terms as columns, and each column's partners."""

    def __init__(self, queries: list[tuple[int, Counter]]) -> None:
        self.terms = np.unique(np.concatenate([np.fromiter(q, np.int64) for _, q in queries]))
        self.queries = [
            (number, np.searchsorted(self.terms, sorted(q)), np.array([q[t] for t in sorted(q)], np.int64)) for number, q in queries
        ]
        together: list[set[int]] = [set() for _ in self.terms]
        for _, columns, _ in self.queries:
            for c in columns:
                together[c].update(columns.tolist())
        # Columns that a summary of this column's blocks needs.
        self.partners = [np.array(sorted(s)) for s in together]


def groups(queries: list[Counter]) -> list[Group]:
    """Queries (counts by term number) without any term are in no group: nothing matches them."""
    found, now, held = [], [], set()
    for number, query in enumerate(queries):
        if not query:
            continue
        if now and len(held | query.keys()) > GROUP_TERMS:
            found.append(Group(now))
            now, held = [], set()
        now.append((number, query))
        held |= query.keys()
    return [*found, Group(now)] if now else found


def clusters(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``near`` and the starts of its blocks: rows nearest to one pivot, at most ``BLOCK`` each."""
    n = len(near)
    pivots = near[np.linspace(0, n, -(-n // PER_PIVOT), endpoint=False).astype(np.int64)]
    nearest = np.argmax(near @ pivots.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest, minlength=len(pivots))
    ends = np.cumsum(sizes)
    starts = [np.arange(e - s, e, BLOCK) for s, e in zip(sizes, ends, strict=True) if s]
    return order, np.concatenate(starts)


class Shard:
    """The posting lists of one shard for one group of queries."""

    def __init__(self, group: Group, factors: np.ndarray, members: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, maxima: np.ndarray) -> None:
        self.group, self.factors = group, factors
        self.members = np.split(members, np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.first = np.append(0, np.cumsum(blocks))
        widths = np.array([len(p) for p in group.partners])
        cells = np.append(0, np.cumsum(blocks * widths))
        self.summaries = [maxima[cells[c] : cells[c + 1]].reshape(blocks[c], widths[c]) for c in range(len(blocks))]

    @staticmethod
    def build(group: Group, factors: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Members of all blocks, block sizes, blocks per column, and maxima per block and partner, one list after another."""
        signs = np.random.default_rng(7).choice(np.float32([-1, 1]), (len(weights), DIRECTIONS))
        near = (factors * weights.astype(np.float32)) @ signs
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
        members, sizes, blocks, maxima = [], [], np.zeros(len(weights), np.int64), []
        for column, partners in enumerate(group.partners):
            listed = np.flatnonzero(factors[:, column])
            if not len(listed):
                continue
            order, starts = clusters(near[listed])
            listed = listed[order]
            members.append(listed.astype(np.uint16))
            sizes.append(np.diff(np.append(starts, len(listed))))
            blocks[column] = len(starts)
            maxima.append(np.maximum.reduceat(factors[listed[:, None], partners], starts, axis=0).ravel())
        none = np.zeros(0, np.int64)
        return (
            np.concatenate([*members, none.astype(np.uint16)]), np.concatenate([*sizes, none]).astype(np.uint16),
            blocks, np.concatenate([*maxima, none.astype(np.int32)]),
        )

    def scores(self, columns: np.ndarray, weights: np.ndarray, worst: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of documents in blocks that a bound lets through; the caller sends back the worst score kept."""
        exact = np.float64 if int(weights.sum()) * 1_000_000 < 1 << 53 else np.int64
        weights = weights.astype(exact)
        bounds, numbers = [], []
        for c in columns:
            if len(self.summaries[c]):
                at = np.searchsorted(self.group.partners[c], columns)
                bounds.append(self.summaries[c][:, at].astype(exact) @ weights)
                numbers.append(np.arange(self.first[c], self.first[c + 1]))
        if not bounds:
            return
        bound, number = np.concatenate(bounds), np.concatenate(numbers)
        order = np.argsort(-bound, kind="stable")
        bound, number = bound[order], number[order]
        seen = np.zeros(len(self.factors), bool)
        at, step = 0, -(-k // PER_PIVOT) + 1
        while at < len(bound) and bound[at] >= worst:
            taken = number[at : at + step][bound[at : at + step] >= worst]
            rows = np.unique(np.concatenate([self.members[b] for b in taken]))
            rows = rows[~seen[rows]]
            seen[rows] = True
            at, step = at + step, step * 2
            if len(rows):
                worst = yield rows, (self.factors[rows[:, None], columns].astype(exact) @ weights).astype(np.int64)


class Best:
    """The ``k`` best of what one query was given: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def worst(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: pa.Array, rows: np.ndarray, scores: np.ndarray) -> None:
        bar = self.worst if len(scores) <= self.k else max(self.worst, int(np.partition(scores, -self.k)[-self.k]))
        kept = scores >= bar
        if kept.any():
            new = zip(scores[kept].tolist(), ids.take(pa.array(rows[kept].astype(np.int64))).to_pylist(), strict=True)
            self.rows = heapq.nsmallest(self.k, [*self.rows, *new], key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): the number of all terms, and those of the vocabulary as packed numbers."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in slices(batches):
            n, found, counts = [], [], []
            for text in batch.column(1).to_pylist():
                counted = Counter(terms(text))
                pairs = [(number[t], c) for t, c in counted.items() if t in number]
                n.append(counted.total())
                found.append(np.array([p[0] for p in pairs], np.uint32).tobytes())
                counts.append(np.array([p[1] for p in pairs], np.uint32).tobytes())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "counts"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), task, f"doc_id {key}, n bigint, terms binary, counts binary")


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary: counts per task, then their sums."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, 4096):
            total += np.bincount(_joined(batch["terms"], np.uint32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    sums = arrow_map(counted.select("terms"), task, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    found = np.zeros(size, np.int64)
    for row in sums.toLocalIterator():  # at most one row per term of the vocabulary
        found[row["term"]] = row["df"]
    return found


def _factors(batch: pa.Table, group: Group, size: int, n_docs: int, n_terms: int) -> np.ndarray:
    """(documents, columns): a term's share of a document's score, before the term's weight."""
    lengths = np.array([len(t) // 4 for t in batch["terms"].to_pylist()], np.int64)
    column = np.full(size, -1, np.int64)
    column[group.terms] = np.arange(len(group.terms))
    at = column[_joined(batch["terms"], np.uint32)]
    row, tf = np.repeat(np.arange(len(lengths)), lengths), _joined(batch["counts"], np.uint32).astype(np.int64)
    m = 100 - 25 + (25 * batch["n"].to_numpy() * n_docs) // n_terms
    factors = np.zeros((len(lengths), len(group.terms)), np.int32)
    mine = at >= 0
    factors[row[mine], at[mine]] = (1_000_000_000 * tf[mine]) // (1000 * tf[mine] + 12 * m[row[mine]])
    return factors


def _answers(docs: DataFrame, queries: list[list[bytes]], k: int) -> DataFrame:
    """(query, doc_id, score): the best ``k`` of every task, for the queries by number."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
    size = len(vocabulary)
    counted = stored(term_counts(docs, vocabulary))
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in _frequencies(counted, size)], np.int64)
    shared = spark.sparkContext.broadcast((groups([Counter(vocabulary[t] for t in q) for q in queries]), weights))
    key = docs.schema["doc_id"].dataType.simpleString()
    fields = ["group", "docs", "lengths", "columns", "factors", "members", "sizes", "blocks", "maxima"]

    def index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in gathered(batches, SHARD):
            ids = shard["doc_id"].combine_chunks()
            for number, group in enumerate(shared.value[0]):
                factors = _factors(shard, group, size, n_docs, n_terms)
                row, column = np.nonzero(factors)
                built = Shard.build(group, factors, shared.value[1][group.terms])
                packed = [
                    np.bincount(row, minlength=len(ids)).astype(np.uint32), column.astype(np.uint32), factors[row, column], *built
                ]
                arrays = [pa.array([number], pa.int32()), pa.ListArray.from_arrays([0, len(ids)], ids)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([p.tobytes()], pa.binary()) for p in packed)], fields)

    def search_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                group = shared.value[0][batch["group"][at].as_py()]
                weights = shared.value[1][group.terms]
                ids = batch["docs"][at].values
                kinds = (np.uint32, np.uint32, np.int32, np.uint16, np.uint16, np.int64, np.int32)
                parts = [np.frombuffer(batch[f][at].as_buffer(), t) for f, t in zip(fields[2:], kinds, strict=True)]
                factors = np.zeros((len(ids), len(group.terms)), np.int32)
                factors[np.repeat(np.arange(len(ids)), parts[0]), parts[1]] = parts[2]
                shard = Shard(group, factors, *parts[3:])
                for number, columns, times in group.queries:
                    mine = best.setdefault(number, Best(k))
                    asked = shard.scores(columns, weights[columns] * times, mine.worst, k)
                    found = next(asked, None)
                    while found:
                        mine.add(ids, *found)
                        try:
                            found = asked.send(mine.worst)
                        except StopIteration:
                            found = None
        rows = [(number, doc, score) for number, b in best.items() for score, doc in b.rows]
        query, doc, score = [*zip(*rows, strict=True)] or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(doc, kind), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    kind = pa.string() if key == "string" else pa.int32() if key == "int" else pa.int64()
    binaries = ", ".join(f"{f} binary" for f in fields[2:])
    with scratch(spark) as folder:
        arrow_map(counted.where("n > 0"), index_task, f"group int, docs array<{key}>, {binaries}").write.parquet(folder)
        # A row is a whole shard: a task takes few at a time.
        index = spark.read.parquet(folder)
        return stored(arrow_map(index, search_task, f"query int, doc_id {key}, score bigint"))


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for every row of ``items`` its ``k`` best rows of ``docs`` with a score above 0.

    Equal scores are ranked by ascending doc_id, null last. A null or empty text has no terms: such an item gets no
    rows, such a document is never found and does not count in the statistics. Each row is an item or a document of
    its own, also where its id is null or repeated. Other columns of both tables are ignored. Items are taken in
    parts of about ``QUERY_BYTES``, and the documents are indexed once for each part.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", "text")
    held = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, found = 1 + held // QUERY_BYTES, []
    key = items.schema["item_id"].dataType.simpleString()
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # about ``QUERY_BYTES``
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"query int, item_id {key}")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _answers(docs, [terms(r["text"]) for r in mine], k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole
