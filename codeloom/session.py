"""Session set-up and the two durability/size helpers every loop relies on."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its rows have been counted and found to be below this.
BROADCAST_ROWS = 50_000
# Into how many parts the rows of a key are dealt when they are too many for one task, and from how many rows on they are.
SALTS = 32
HOT_ROWS = 100_000
# How many rows a task sorts or groups, where their number is known.
TASK_ROWS = 500_000
# How many bits a key gets in the table of ``may_hold``, and how many such a table has at most (8 MB).
KEY_BITS = 64
MOST_KEY_BITS = 1 << 26


def spark_session(app: str = "codeloom", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors must reach.

    Where it is unset, a session whose only machine is this one (``local``, not ``local-cluster``)
    gets a folder of its own; any other is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_counted(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """``durable`` plus the count of its rows (those that ``where`` holds for), taken while they are being written.

    A task that Spark has to repeat may be counted twice, never missed: 0 means empty, and
    a count below a size bound proves the bound.
    """
    seen = Observation()
    stored = durable(df.observe(seen, F.count_if(F.lit(True) if where is None else where).alias("rows")))
    return stored, seen.get["rows"]


def uncounted(df: DataFrame) -> DataFrame:
    """A join side whose rows nobody counted: it is sorted and merged, however small Spark takes it for.

    Spark's estimate leaves out what an explode or a compressed file holds, and a side broadcast by it passes
    whole through the driver and lies whole in every task.
    """
    return df.hint("merge")


def placed(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in so many parts that a task gets about ``TASK_ROWS`` of its ``rows``; as it was where nobody counted them.

    The number of shuffle partitions is the session's and stays when the input grows; this one follows the rows.
    """
    if rows is None:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def may_hold(small: DataFrame, keys: list[str], rows: int) -> Callable[..., Column]:
    """A test of values of ``keys``: true for all that ``small`` has and few others, so no row that it rejects can meet ``small``.

    One bit of a table of words per key, ``KEY_BITS`` for each of the ``rows`` up to ``MOST_KEY_BITS``; the table is a scalar
    subquery. As a plain condition it is evaluated where the values are read, before what joins would move.
    """
    bits = min(MOST_KEY_BITS, 1 << max(12, (KEY_BITS * rows).bit_length()))

    def place(*values: Column) -> Column:
        return F.pmod(F.xxhash64(*values), F.lit(bits))

    at = small.select(place(*map(F.col, keys)).alias("at"))
    words = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("held"))
    # Words without a key are zero, so that a word is found by its place.
    every = small.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("bigint").alias("held"))
    whole = words.unionByName(every).groupBy("word").agg(F.max(F.struct(F.col("held") != 0, "held")).getField("held").alias("held"))
    # Stored: whoever tests by it again does not make it again.
    table = durable(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "held"))), lambda w: w["held"]).alias("table"))).scalar()

    def test(*values: Column) -> Column:
        at = place(*values)
        return F.getbit(F.get(table, (at / 64).cast("int")), (at % 64).cast("int")) == 1

    return test


def hot_keys(big: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The ``keys`` with ``HOT_ROWS`` or more rows of ``big``, marked ``_hot``, and how many they are."""
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return durable_counted(counts.filter(F.col("_rows") >= HOT_ROWS).select(*keys, F.lit(True).alias("_hot")))


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: Column,
    small_rows: int,
    how: str = "inner",
    hot_of: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """Join on ``keys`` where one key may hold a large share of ``big``.

    ``small`` is broadcast when its counted ``small_rows`` allow it, so ``big`` never moves. Otherwise the keys
    with ``HOT_ROWS`` or more rows of ``big`` are found by partial counts; their rows take a salt from ``spread_by``
    and only their rows of ``small`` are repeated once per salt, so a hot key is shared by ``SALTS`` tasks
    and no other key is copied. ``how`` must keep ``big`` on the left. Who joins one ``big`` again and again finds its
    ``hot_keys`` once and hands them over as ``hot_of``.
    """
    if small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    hot, n = hot_of or hot_keys(big, keys)
    if n == 0:
        return big.join(small, keys, how)
    marks = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_spread"), F.lit(SALTS))).otherwise(0)
    salted = big.withColumn("_spread", spread_by).join(marks, keys, "left").withColumn("_salt", salt)
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = small.join(marks, keys, "left").withColumn("_salt", F.explode(parts.cast("array<bigint>"))).drop("_hot")
    return salted.drop("_hot", "_spread").join(copies, [*keys, "_salt"], how).drop("_salt")
