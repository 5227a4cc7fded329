"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table (start and stride
from two hashes of its name, so the order visits every slot). Shards take turns; each claims
its next free slot. Shares differ by one slot at most, and a change of the shards moves few
slots besides those of the shard that came or went. The table has ``slots`` rows whatever the
data, so it is broadcast; a row's shard is one look-up of its key's slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
# The table is broadcast, so its size is bounded: about 100 bytes a slot.
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def slot_owners(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index into ``shards`` for every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MOST_SLOTS}")
    at, stride = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        stride.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    owners, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owners[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            owners[at[i]] = i
            free -= 1
            if not free:
                break
    return owners


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo ``slots``; 0 for null."""
    bits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.coalesce(F.pmod(bits, F.lit(slots)), F.lit(0)).cast("int")


def slot_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    owners = slot_owners(shards, slots)
    return spark.createDataFrame([(s, shards[o]) for s, o in enumerate(owners)], "slot int, shard string")


def place(rows: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``rows`` with columns ``slot`` and ``shard`` (of the same name before: replaced).

    Equal keys share a shard; a null key goes to slot 0. Texts are not looked at. Every row
    stays, repeated ones too; an empty table gives an empty table.
    """
    table = slot_table(rows.sparkSession, shards, slots)
    placed = rows.drop("shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(table), "slot", "left").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write_shards(rows: DataFrame, shards: Sequence[str], path: str, key: str = "doc_id", slots: int = SLOTS) -> None:
    """Write one folder of Parquet files per shard. Tasks are dealt by slot, so a shard's rows come from many tasks."""
    place(rows, shards, key, slots).repartition("slot").write.partitionBy("shard").parquet(path)
