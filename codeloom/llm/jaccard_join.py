"""Exact self-join of word-shingle sets by Jaccard similarity, with PartEnum signatures.

Sets are put in bands by size, so that similar sets are in one band or in neighbouring ones.
For each band, similarity bounds the number ``k`` of features by which two sets differ. The
feature domain is hashed into partitions:

* ``k = 0``: the whole set is the signature.
* ``k`` of 1 or 2: ``k + 3`` partitions; a signature for every choice of 3 of them, one of which
  no difference touches.
* larger ``k``: ``k + 1`` partitions on a ring. Then some partition is untouched and it and the
  next together hold at most one difference. A partition with more than ``POOR`` features is a
  signature by itself; a poorer one is joined with each choice of 2 of 3 parts of the next.

So similar sets share a signature, whatever they are. Sharing is checked in two steps that lose
no component: every member of a signature is compared with its smallest, which joins most of
what belongs together; where members of one signature are still in different components,
all such pairs are compared in blocks. Before texts are fetched, pairs are screened by
size and by parity sketches (the number of differing sketch bits never exceeds the number
of differing features); then sets are intersected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import LOWER_ASCII, arrow_map, hot_split_join, scratch, slices, stored
from codeloom.llm.components import components

POOR = 1
# Words of 64 bits in the smallest parity sketch.
SKETCH = 16
# Members of one signature that are compared with each other in one task.
BLOCK = 2048
# The largest table of facts, in bytes, that is broadcast: the driver holds its rows, the hashed rows and their blocks at once.
FACT_BYTES = 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; with fewer words the whole sequence is one."""
    found = text.encode().translate(LOWER_ASCII).split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(hashes))
    if not width:
        return hashes
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for i in range(width):
        total = (total ^ hashes[i : len(hashes) - width + 1 + i]) * _STEP
        total ^= total >> np.uint64(31)
    return np.unique(_mixed(total))


class Signatures:
    """Signatures of sets for a similarity of at least ``percent`` of a hundred."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self._ends: list[int] = [0]  # last size of each band

    def band(self, size: int) -> int:
        while self._ends[-1] < size:
            self._ends.append((self._ends[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self._ends, size))

    def differences(self, band: int) -> int:
        """By how many features similar sets of this and the band before differ at most."""
        while len(self._ends) <= band:
            self._ends.append((self._ends[-1] + 1) * 100 // self.percent)
        return 2 * self._ends[band] * (100 - self.percent) // (100 + self.percent)

    def of(self, features: np.ndarray) -> np.ndarray:
        """A set in a band has the signatures of that band and of the next."""
        band = self.band(len(features))
        return np.concatenate([self._in_band(features, b) for b in (band, band + 1)])

    def _in_band(self, features: np.ndarray, band: int) -> np.ndarray:
        k = self.differences(band)
        seed = np.uint64(band * int(_STEP) % (1 << 64))
        place = _mixed(features + seed)
        value = _mixed(place, 0xA0761D6478BD642F)
        if k == 0:
            return _mixed(np.array([value.sum(dtype=np.uint64)], np.uint64) + seed)
        if k <= 2:
            sums = _sums(place % np.uint64(k + 3), value, k + 3)
            chosen = [(c, sums[list(c)].sum(dtype=np.uint64)) for c in combinations(range(k + 3), 3)]
            return _mixed(np.array([s for _, s in chosen], np.uint64) + seed + np.array([c[0] * 25 + c[1] * 5 + c[2] + 1 for c, _ in chosen], np.uint64))
        parts = k + 1
        part = (place >> np.uint64(20)) % np.uint64(parts)
        sums = _sums(part, value, parts)
        number = np.arange(parts, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        poor = np.bincount(part.astype(np.int64), minlength=parts) <= POOR
        rich = _mixed(sums[~poor] + seed + number[~poor])
        if not poor.any():
            return rich
        thirds = _sums(part * np.uint64(3) + (place >> np.uint64(8)) % np.uint64(3), value, 3 * parts).reshape(parts, 3)
        which = np.flatnonzero(poor)
        after = (which + 1) % parts
        own = _mixed(sums[which] + seed + number[which] + np.uint64(1))
        joined = [_mixed(own + sums[after] - thirds[after, i] + np.uint64((i + 2) * int(_STEP) % (1 << 64))) for i in range(3)]
        return np.concatenate([rich, *joined])


def _sums(part: np.ndarray, value: np.ndarray, parts: int) -> np.ndarray:
    """Sums of values by part, modulo 2^64. The halves are added apart, exactly."""
    part = part.astype(np.int64)
    low = np.bincount(part, (value & _LOW).astype(np.float64), parts).astype(np.uint64)
    high = np.bincount(part, (value >> np.uint64(32)).astype(np.float64), parts).astype(np.uint64)
    return low + (high << np.uint64(32))


def sketch(features: np.ndarray, percent: int) -> np.ndarray:
    """Parity, for each bit, of the number of features that fall on it.

    The bits are four times as many as the differences that similar sets of this size may have,
    rounded up to a power of two. A sketch of twice the length folds onto one half by XOR.
    """
    words = SKETCH
    while 64 * words * (100 + percent) < 8 * len(features) * (100 - percent):
        words *= 2
    odd = np.bincount((features >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _profile_task(words: int, percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, one, two, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words) if text else np.empty(0, np.uint64)
                sizes.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(_mixed(s, 0xE7037ED1A0B428DB).sum(dtype=np.uint64).astype(np.int64)))
                sketches.append(sketch(s, percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc", "n", "s1", "s2", "sketch"],
            )

    return task


def _signature_task(words: int, percent: int, buckets: int):
    """Signatures with their documents, in lists by bucket, so that few rows are shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = Signatures(percent)
        for batch in slices(batches):
            found, owners = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(text, words) if text and doc is not None else ()
                if len(s):
                    found.append(signatures.of(s))
                    owners.append(np.full(len(found[-1]), doc))
            if not found:
                continue
            sigs, docs = np.concatenate(found), np.concatenate(owners)
            bucket = (sigs % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            sigs, docs, bucket = sigs[order].view(np.int64), docs[order], bucket[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            offsets = pa.array(np.append(starts, len(sigs)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts]), pa.ListArray.from_arrays(offsets, pa.array(sigs)), pa.ListArray.from_arrays(offsets, pa.array(docs))],
                names=["bucket", "sigs", "docs"],
            )

    return task


def _star_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature and document: each further member of a signature once, with its smallest."""
    sig, hub, end = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        sigs = np.concatenate([sig, batch.column("sig").to_numpy(zero_copy_only=False)])
        docs = np.concatenate([hub, batch.column("doc").to_numpy(zero_copy_only=False)])
        if not len(sigs):
            continue
        first = np.concatenate([[True], sigs[1:] != sigs[:-1]])
        hubs = docs[np.flatnonzero(first)][np.cumsum(first) - 1]
        before = np.concatenate([docs[:1], docs[:-1]])
        if len(end) and len(docs) > 1:
            before[1] = end[0] if not first[1] else before[1]
        more = ~first & (docs != hubs) & (docs != before)
        sig, hub, end = sigs[-1:], hubs[-1:], docs[-1:]
        if more.any():
            yield pa.RecordBatch.from_arrays([pa.array(sigs[more]), pa.array(hubs[more]), pa.array(docs[more])], names=["sig", "hub", "doc"])


def allowed_differences(n1: Column, n2: Column, percent: int) -> Column:
    return F.floor((n1 + n2) * (100 - percent) / (100 + percent))


def _block_task(percent: int):
    """Pairs of one block, or of two, that are in different components and pass the screens."""

    def pairs(group: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kind, comp, n, bits, side = (group[c] for c in ("kind", "comp", "n", "sketch", "side"))
        if (comp == comp[0]).all():
            return
        two = side.any() and not side.all()
        for start in range(0, len(kind), 256):
            part = slice(start, start + 256)
            if bits[part].size * len(kind) <= 1 << 21:
                differ = np.bitwise_count(bits[part, None] ^ bits[None]).sum(2, dtype=np.int64)
            else:
                differ = np.zeros((len(kind[part]), len(kind)), np.int64)
                for w in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[part, w, None] ^ bits[None, :, w])
            sizes = n[part, None] + n[None, :]
            fits = (differ * (100 + percent) <= sizes * (100 - percent)) & (comp[part, None] != comp[None, :])
            fits &= 100 * np.minimum(n[part, None], n[None, :]) >= percent * np.maximum(n[part, None], n[None, :])
            fits &= side[part, None] < side[None, :] if two else kind[part, None] < kind[None, :]
            i, j = np.nonzero(fits)
            if len(i):
                a, b = kind[part][i], kind[j]
                yield np.minimum(a, b), np.maximum(a, b)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            key = np.stack([table.column(c).to_numpy() for c in ("sig", "b1", "b2")])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            columns = {c: table.column(c).to_numpy() for c in ("kind", "comp", "n", "side")}
            lists = table.column("sketch").combine_chunks()
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            for start, end in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                if end - start > 2:
                    group = {c: v[start:end] for c, v in columns.items()}
                    group["sketch"] = _folded(values, ends[start : end + 1])
                    for a, b in pairs(group):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            key = np.stack([table.column(c).to_numpy() for c in ("sig", "b1", "b2")])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            cut = int(starts[-1])  # the last group may go on in the next batch
            if held and (cut or tuple(key[:, 0]) != last):
                head = next((int(s) for s in starts if tuple(key[:, s]) != last), table.num_rows)
                held.append(table.slice(0, head))
                yield from flush()
                held = []
                if head < cut:
                    held = [table.slice(head, cut - head)]
                    yield from flush()
                held = [table.slice(max(cut, head))]
            elif cut:
                held = [table.slice(0, cut)]
                yield from flush()
                held = [table.slice(cut)]
            else:
                held.append(table)
            last = tuple(key[:, -1])
        if held and sum(t.num_rows for t in held):
            yield from flush()

    return task


def _folded(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sketches of one group, each folded to the length of the shortest."""
    lengths = np.diff(ends)
    least = int(lengths.min())
    if (lengths == least).all():
        return values[ends[0] : ends[-1]].reshape(-1, least)
    return np.stack([np.bitwise_xor.reduce(values[i:j].reshape(-1, least), axis=0) for i, j in zip(ends[:-1], ends[1:], strict=True)])


def _half(bits: Column) -> Column:
    """A sketch folded to half its length."""
    size = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))


def _set_task(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "features"])

    return task


def _fitting(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marked for broadcast if its ``rows`` fit the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= FACT_BYTES else df


class JaccardJoin:
    """Links between the rows of ``docs`` (``doc``, ``text``)."""

    def __init__(self, docs: DataFrame, words: int, percent: int) -> None:
        self.docs, self.words, self.percent = docs, words, percent
        self.spark = docs.sparkSession
        profile = stored(arrow_map(docs, _profile_task(words, percent), "doc bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>"))
        self.profile = profile
        full = profile.where("n > 0 and doc is not null")
        alike = full.groupBy("n", "s1", "s2").agg(F.min("doc").alias("kind"), F.count(F.lit(1)).alias("rows"))
        total = full.count()
        self.kinds = stored(hot_split_join(full.select("doc", "n", "s1", "s2"), alike, ["n", "s1", "s2"], "rows", total).select("doc", "kind", "n").distinct())
        self.total = total
        self.fact_bytes = full.agg(F.sum(64 + 8 * F.size("sketch"))).first()[0] or 0

    def _stars(self, folder: str) -> DataFrame:
        buckets = max(1024, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # Of copies, and most rows may be copies, one stands for all.
        ones = self.kinds.where("doc = kind").select("doc").distinct()
        docs = self.docs.join(_fitting(ones, self.total, 16), "doc", "left_semi")
        packed = arrow_map(docs, _signature_task(self.words, self.percent, buckets), "bucket int, sigs array<bigint>, docs array<bigint>")
        rows = packed.repartition("bucket").select(F.inline(F.arrays_zip(F.col("sigs").alias("sig"), F.col("docs").alias("doc"))))
        arrow_map(rows.sortWithinPartitions("sig", "doc"), _star_task, "sig bigint, hub bigint, doc bigint").write.parquet(folder)
        return self.spark.read.parquet(folder)

    def _sides(self, pairs: DataFrame, left: str, right: str) -> DataFrame:
        """Documents of pairs replaced by their kinds, screened by size and sketch; distinct ``a < b``."""
        kinds = _fitting(self.kinds, self.total, 64)
        if self.total * 64 > FACT_BYTES:
            pairs = pairs.distinct()
        for side, name in (("1", left), ("2", right)):
            pairs = pairs.join(kinds.select(F.col("doc").alias(name), F.col("kind").alias("k" + side), F.col("n").alias("n" + side)), name)
        near = pairs.where((F.col("k1") != F.col("k2")) & (100 * F.least("n1", "n2") >= self.percent * F.greatest("n1", "n2")))
        near = near.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()
        sketches = _fitting(self.profile.select("doc", "n", "sketch").distinct(), self.fact_bytes, 1)
        for side, name in (("1", "a"), ("2", "b")):
            near = near.join(sketches.select(F.col("doc").alias(name), F.col("n").alias("n" + side), F.col("sketch").alias("s" + side)), name)
        one, two = F.size("s1"), F.size("s2")
        near = near.withColumn("s1", F.when(one == 2 * two, _half(F.col("s1"))).otherwise(F.col("s1")))
        near = near.withColumn("s2", F.when(two == 2 * F.size("s1"), _half(F.col("s2"))).otherwise(F.col("s2")))
        differ = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        screened = (F.size("s1") != F.size("s2")) | (differ <= allowed_differences(F.col("n1"), F.col("n2"), self.percent))
        return near.where(screened).select("a", "b").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs of kinds whose sets are similar."""
        pairs = stored(pairs)
        needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
        texts = self.docs.join(_fitting(needed, needed.count(), 16), "doc").where("text is not null")
        sets = arrow_map(texts.select("doc", "text"), _set_task(self.words), "doc bigint, features array<bigint>")
        for side, name in (("1", "a"), ("2", "b")):
            pairs = pairs.join(sets.select(F.col("doc").alias(name), F.col("features").alias("f" + side)), name)
        both = F.size(F.array_intersect("f1", "f2"))
        return stored(pairs.where(100 * both >= self.percent * (F.size("f1") + F.size("f2") - both)).select("a", "b").distinct())

    def components(self) -> DataFrame:
        """``doc``, ``n`` and ``component`` (smallest linked document) of every row with features."""
        with scratch(self.spark) as folder:
            stars = self._stars(folder + "/stars")
            links = self.verified(self._sides(stars.select("hub", "doc"), "hub", "doc"))
            first = components(links)
            joined = self.kinds.join(first.withColumnRenamed("node", "kind"), "kind", "left")
            members = stored(joined.select("doc", "kind", "n", F.coalesce("component", "kind").alias("comp")))
            rest = self.verified(self._across(stars, members))
        between = members.select("kind", "comp").distinct()
        for name in ("a", "b"):
            rest = rest.join(between.select(F.col("kind").alias(name), F.col("comp").alias("c" + name)), name)
        second = components(rest.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b").distinct())
        return members.join(second.withColumnRenamed("node", "comp"), "comp", "left").select("doc", "n", F.coalesce("component", "comp").alias("component"))

    def _across(self, stars: DataFrame, members: DataFrame) -> DataFrame:
        """Screened pairs of different components within one signature that were not compared with its smallest."""
        known = _fitting(members.select("doc", "comp").distinct(), self.total, 40)
        of = stars.join(known, "doc").join(known.select(F.col("doc").alias("hub"), F.col("comp").alias("hub_comp")), "hub")
        of = of.select("sig", "hub", "doc", (F.col("comp") != F.col("hub_comp")).alias("far"))
        group = Window.partitionBy("sig", "hub")
        rows = of.withColumns({"more": F.count(F.lit(1)).over(group), "split": F.max("far").over(group)}).where("split and more > 1")
        rows = rows.select("sig", "hub", "doc", F.ceil((F.col("more") + 1) / BLOCK).cast("int").alias("blocks"))
        hubs = rows.groupBy("sig", "hub").agg(F.first("blocks").alias("blocks")).select("sig", F.col("hub").alias("doc"), "blocks")
        rows = rows.select("sig", "doc", "blocks").unionByName(hubs)
        own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        rows = rows.select("sig", "doc", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        keys = ["sig", "b1", "b2"]
        fits = self.fact_bytes <= FACT_BYTES
        facts = members.join(self.profile.select("doc", "n", "sketch").distinct(), ["doc", "n"]).select("doc", "kind", "comp", "n", "sketch")
        rows = rows.repartition(*keys).join(F.broadcast(facts), "doc") if fits else rows.join(facts, "doc").repartition(*keys)
        wide = rows.select(*keys, "kind", "comp", "n", "side", "sketch").sortWithinPartitions(*keys)
        return arrow_map(wide, _block_task(self.percent), "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, words: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row.

    Words are what stands between white space, with A-Z in lower case; a row's set has its distinct
    shingles of ``words`` words, or its whole sequence if it has fewer. Rows link when
    100 times the intersection is at least ``percent`` times the union; ``component_id`` is the
    smallest key reachable. Rows without words have 0 shingles and are their own component. A
    null key is linked with nothing and has a null component. Rows that repeat a key are one
    node; each stays a row. Other columns are left out. An empty table gives an empty table.
    """
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    join = JaccardJoin(rows, words, percent)
    groups = join.components().groupBy("doc").agg(F.min("component").alias("component"))
    found = join.profile.select("doc", "n").join(groups, "doc", "left")
    return found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _fingerprint_task(words: int, text: str):
    """Rows with the size and two sums of their sets, as in profiles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words) if t else np.empty(0, np.uint64) for t in batch.column(text).to_pylist()]
            one = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            two = [int(_mixed(s, 0xE7037ED1A0B428DB).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], one, two))], names=[*batch.schema.names, "n", "s1", "s2"]
            )

    return task


def drop_similar(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the rows of the smallest key of each component. Same columns.

    Of rows with one key, null too, and the same set of shingles one stays, that of the
    smallest text; rows without words all stay. A key is one node: where it has several texts
    and one of them is similar to a text of a smaller key, all its rows go; else its different
    texts all stay. Null keys are compared with null keys only, and only for equal sets.
    """
    groups = stored(similar_groups(docs, words, percent, key, text))
    gone = stored(groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct())
    left = docs.join(_fitting(gone, gone.count(), 16), F.col(f"`{key}`") == F.col("_gone"), "left_anti")
    again = groups.where("n_shingles > 0").groupBy(F.col(key).alias("_again")).count().where("count > 1").select("_again", F.lit(True).alias("_twice"))
    again = stored(again)
    repeated = again.count()
    if not repeated:
        return left
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    back = [F.col(n).alias(c) for c, n in names.items()]
    left = left.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    marked = left.join(_fitting(again, repeated, 16), F.col(names[key]).eqNullSafe(F.col("_again")), "left")
    schema = ", ".join([*(f"{names[f.name]} {f.dataType.simpleString()}" for f in docs.schema), "n bigint, s1 bigint, s2 bigint"])
    rows = arrow_map(marked.where("_twice").select(*names.values()), _fingerprint_task(words, names[text]), schema)
    rows = rows.withColumn("own", F.when(F.col("n") == 0, F.monotonically_increasing_id()))
    one = rows.groupBy(names[key], "n", "s1", "s2", "own").agg(
        F.min_by(F.struct(*names.values()), F.coalesce(names[text], F.lit(""))).alias("r")
    )
    return marked.where("_twice is null").select(*names.values()).unionByName(one.select("r.*")).select(*back)
