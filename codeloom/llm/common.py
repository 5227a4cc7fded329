"""Helpers shared by the operators: shipping the package, Arrow batches, stored intermediates, joins on hot keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import durable, shared_folder

# Rows, and bytes unless one row has more, that a Python task holds as Python objects at a time.
SLICE_ROWS = 256
SLICE_BYTES = 16 << 20
# The largest table, in bytes, that is handed to every task. Larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
# A key is hot when it holds at least one part in so many of all rows; so at most this many keys are hot.
HOT_SHARE = 64
SALTS = 32

# A-Z in lower case, all other bytes as they are; and white space as the contracts list it.
LOWER_ASCII = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def ship(spark: SparkSession) -> None:
    """Give this package's code to the Python workers of all executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="codeloom-code-"), "codeloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("codeloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._codeloom_shipped = True


def file_broadcast(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file's bytes for all tasks; refused beyond ``BROADCAST_BYTES``."""
    size = os.path.getsize(path)
    if size > BROADCAST_BYTES:
        raise ValueError(f"{path} has {size} bytes, more than the {BROADCAST_BYTES} that are broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, rows)
            while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            start += part.num_rows


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's rows in tables of ``rows``; the last has what is left."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            held.append(batch.slice(start, rows - count))
            count += held[-1].num_rows
            start += held[-1].num_rows
            if count == rows:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


# The one model that this worker process keeps for its next tasks: how it was made, and the model.
_model: list = []


def one_model(make: Callable, *args):
    """``make(*args)``, kept until a task needs another model: workers serve the tasks of all operators, and what each remembers would add up."""
    if not _model or _model[0] != (make, args):
        _model.clear()
        _model[:] = [(make, args), make(*args)]
    return _model[1]


def _give_back() -> None:
    """Give back memory that Arrow and the C library keep for later: an idle worker's counts as the executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def _let_go(module: str) -> None:
    """Forget a model of another operator than the task's."""
    if _model and _model[0][0].__module__ != module:
        _model.clear()
        _give_back()


def arrow_map(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    module = task.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(module)
        yield from task(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder."""
    return durable(df)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder beside the checkpoints, which executors share, removed at the end."""
    path = f"{shared_folder(spark)}/codeloom-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def hot_split_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per ``keys`` and the number of ``rows`` it meets in ``count``.

    Keys with at least a ``HOT_SHARE``-th of the ``total`` rows are hot; there are at most
    ``HOT_SHARE`` of them, so their list is broadcast. Their rows are dealt over ``SALTS``
    parts, to each of which their one row of ``keyed`` is copied. ``rows`` is read once.
    """
    bar = max(1000, total // HOT_SHARE)
    hot = keyed.where(F.col(count) >= bar).select(*keys, F.lit(True).alias("_hot"))
    part = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(SALTS))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), part).otherwise(0)).drop("_hot")
    parts = F.when(F.col(count) >= bar, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = keyed.withColumn("_salt", F.explode(parts.cast("array<bigint>"))).drop(count)
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
