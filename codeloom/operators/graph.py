"""Breadth-first walks over the import graph.

A walk is identified by ``walk``; many walks, over one or many projects, advance together,
one join per level. Each level is written to the checkpoint folder, so neither the plan nor
the recovery cost grows with depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import symbols as S
from codeloom.functions.paths import relative_path
from codeloom.operators import components
from codeloom.schema import DEFAULT_MAX_DEPTH, DEFAULT_MAX_RESULTS
from codeloom.session import BROADCAST_ROWS, durable, durable_counted, hot_keys, spread_join


def entry_frame(spark: SparkSession, project: str, entry_points: list[str], walk: str = "walk") -> DataFrame:
    rows = [(walk, project, path, i) for i, path in enumerate(entry_points)]
    return spark.createDataFrame(rows, "walk string, project string, path string, ord bigint")


def _hop_both(imports: DataFrame, frontier: DataFrame, rows: int) -> DataFrame:
    """``_hop`` along imports (dir 0) and importers (dir 1) in one pass over the edges."""
    s, t = F.col("source_path"), F.col("target_path")
    ends = F.array(
        F.struct(s.alias("at"), t.alias("node"), F.lit(0).alias("dir")),
        F.struct(t.alias("at"), s.alias("node"), F.lit(1).alias("dir")),
    )
    doubled = imports.select("project", F.inline(ends))
    return spread_join(doubled, frontier, ["project", "at"], F.col("node"), rows)


def _unseen(found: DataFrame, visited: DataFrame, visited_rows: int) -> DataFrame:
    seen = visited.select("walk", "project", "node")
    if visited_rows <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    return found.join(seen, ["walk", "project", "node"], "left_anti")


def walk_many(
    imports: DataFrame,
    entries: DataFrame,
    max_depth: int = DEFAULT_MAX_DEPTH,
    max_results: int = DEFAULT_MAX_RESULTS,
) -> DataFrame:
    """Walk outward in both directions from each walk's entries.

    ``entries`` is (walk, project, path, ord). Result: (walk, project, node, depth, reason,
    pos). Order inside a level is fixed: by parent position, dependencies before dependents,
    then path. A walk stops growing once it holds ``max_results`` files, so no level keeps
    more than that many rows per walk; rows past it can never be expanded or returned.
    """
    first_seen = entries.groupBy("walk", "project", "path").agg(F.min("ord").alias("ord"))
    by_order = Window.partitionBy("walk").orderBy("ord")
    level, rows = durable_counted(
        first_seen.select(
            "walk",
            "project",
            F.col("path").alias("node"),
            F.lit(0).cast("bigint").alias("depth"),
            F.lit("entry").alias("reason"),
            F.row_number().over(by_order).cast("bigint").alias("pos"),
        )
    )
    visited, total = level, rows

    for depth in range(1, max_depth + 1):
        if rows == 0:
            break
        held = F.max("pos").over(Window.partitionBy("walk"))
        frontier = level.select(
            "walk", "project", F.col("node").alias("at"), F.col("pos").alias("parent"), held.alias("held")
        ).filter(F.col("held") < max_results)
        found = (
            _hop_both(imports, frontier, rows)
            .groupBy("walk", "project", "node")
            .agg(F.min(F.col("parent") * 2 + F.col("dir")).alias("key"), F.max("held").alias("held"))
        )
        rank = F.row_number().over(Window.partitionBy("walk").orderBy("key", "node"))
        # The literal bound lets Spark cut each task's rows per walk before the shuffle.
        level, rows = durable_counted(
            _unseen(found, visited, total)
            .withColumn("rank", rank)
            .filter(F.col("rank") <= max_results)
            .filter(F.col("rank") + F.col("held") <= max_results)
            .select(
                "walk",
                "project",
                "node",
                F.lit(depth).cast("bigint").alias("depth"),
                F.when(F.col("key") % 2 == 0, "dependency").otherwise("dependent").alias("reason"),
                (F.col("held") + F.col("rank")).alias("pos"),
            )
        )
        visited, total = visited.unionByName(level), total + rows

    return visited.filter(F.col("pos") <= max_results)


def attach_symbols(walked: DataFrame, files: DataFrame) -> DataFrame:
    """Add each visited file's symbols; files outside the index keep an empty array."""
    keys, rows = durable_counted(walked.select("project", F.col("node").alias("file_path")).distinct())
    known = spread_join(
        files.select("project", "file_path", "symbols"), keys, ["project", "file_path"], F.col("file_path"), rows
    )
    return (
        walked.withColumnRenamed("node", "file_path")
        .join(known, ["project", "file_path"], "left")
        .withColumn("symbols", F.coalesce("symbols", S.none()))
    )


def walk_import_graph(
    files: DataFrame,
    imports: DataFrame,
    project: str,
    entry_points: list[str],
    max_depth: int = DEFAULT_MAX_DEPTH,
    max_results: int = DEFAULT_MAX_RESULTS,
) -> DataFrame:
    """The single-project walk: (file_path, relative_path, reason, depth, symbols) in walk order."""
    in_project = imports.filter(F.col("project") == project)
    entries = entry_frame(files.sparkSession, project, entry_points)
    walked = walk_many(in_project, entries, max_depth, max_results)
    return (
        attach_symbols(walked, files.filter(F.col("project") == project))
        .orderBy("depth", "pos")
        .select(
            "file_path",
            relative_path(F.col("file_path"), F.col("project")).alias("relative_path"),
            "reason",
            "depth",
            "symbols",
        )
    )


def numbered_starts(starts: DataFrame) -> DataFrame:
    """(walk, project, path, word, bits): each start's place in bitmaps of 64 starts a word."""
    number = F.monotonically_increasing_id()
    rows = durable(starts.select("walk", "project", "path").distinct().withColumn("n", number))
    return rows.select(
        "walk", "project", "path", F.expr("shiftright(n, 6)").alias("word"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bits")
    )


def reach(imports: DataFrame, starts: DataFrame, max_hops: int | None, backwards: bool = True) -> DataFrame:
    """Which starts come to which files, and after how many directed hops (``max_hops`` None: any number).

    ``starts`` are ``numbered_starts``. Result: (project, node, depth, word, bits), where a bit stands for a start that
    is ``depth`` hops away at least, itself 0. All starts advance in one pass over the edges a hop, and a file has one row per word of 64
    starts, merged by OR, not one per start. Backwards follows importers.
    """
    near, far = ("target_path", "source_path") if backwards else ("source_path", "target_path")
    keys = ["project", "node", "word"]
    level, rows = durable_counted(
        starts.groupBy("project", F.col("path").alias("node"), "word").agg(F.bit_or("bits").alias("bits")).withColumn("depth", F.lit(0).cast("bigint"))
    )
    visited, total = level, rows
    ends = imports.select("project", F.col(near).alias("at"), F.col(far).alias("node"))
    hot = None
    depth = 0
    while rows and (max_hops is None or depth < max_hops):
        depth += 1
        if rows > BROADCAST_ROWS:
            hot = hot or hot_keys(ends, ["project", "at"])
        frontier = level.select("project", F.col("node").alias("at"), "word", "bits")
        hop = spread_join(ends, frontier, ["project", "at"], F.col("node"), rows, hot_of=hot)
        found = hop.groupBy(*keys).agg(F.bit_or("bits").alias("bits"))
        seen = visited.groupBy(*keys).agg(F.bit_or("bits").alias("seen"))
        if total <= BROADCAST_ROWS:
            seen = F.broadcast(seen)
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint"))))
        level, rows = durable_counted(
            found.join(seen, keys, "left").select(*keys, fresh.alias("bits"), F.lit(depth).cast("bigint").alias("depth")).filter("bits != 0")
        )
        visited, total = visited.unionByName(level), total + rows
    return visited


def per_start(reached: DataFrame, starts: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(walk, project, path, depth, sums of ``values``) over the files of ``reached``, for starts and depths with any."""
    held = lambda k: F.expr(f"shiftrightunsigned(bits, {k}) & 1")
    sums = [F.array(*[F.sum(held(k) * value) for k in range(64)]).alias(name) for name, value in {"_files": F.lit(1), **values}.items()]
    names = ["_files", *values]
    rows = (
        reached.groupBy("word", "depth")
        .agg(*sums)
        .select("word", "depth", F.posexplode(F.arrays_zip(*names)).alias("bit", "sums"))
        .filter("sums._files > 0")
        .select("depth", "word", F.expr("shiftleft(1L, bit)").alias("bits"), *[F.col(f"sums.{n}").alias(n) for n in values])
    )
    return starts.join(rows, ["word", "bits"]).select("walk", "project", "path", "depth", *values)


def risk_band(direct, transitive, in_cycle):
    return (
        F.when(transitive >= 10, "critical")
        .when((direct >= 6) | in_cycle, "high")
        .when(direct >= 3, "medium")
        .otherwise("low")
    )


def blast_radius(imports: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """Change impact of each start: direct and transitive dependents, cycle membership, risk.

    ``starts`` is (walk, project, path). Importers are followed backwards for ``hops`` hops; a start is in a
    cycle, of whatever length, when it is in a component of two files or more.
    """
    numbered = numbered_starts(starts)
    by_depth = per_start(reach(imports, numbered, hops), numbered, {"n": F.lit(1)})
    dependents = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    counts = by_depth.groupBy("walk", "project", F.col("path").alias("file_path")).agg(
        dependents(F.col("depth") == 1).alias("direct_dependents"), dependents(F.col("depth") > 0).alias("transitive_dependents")
    )
    on_cycle = components.strong_components(imports).select("project", "file_path", F.lit(True).alias("in_cycle"))
    return (
        counts.join(on_cycle, ["project", "file_path"], "left")
        .withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
        .withColumn("risk", risk_band(F.col("direct_dependents"), F.col("transitive_dependents"), F.col("in_cycle")))
        .select("walk", "project", "file_path", "direct_dependents", "transitive_dependents", "in_cycle", "risk")
    )


def dependencies_by_level(files: DataFrame, imports: DataFrame, entries: DataFrame, max_depth: int = 3) -> DataFrame:
    """Dependency levels below each entry: file and symbol counts, direct against transitive."""
    numbered = numbered_starts(entries)
    reached = reach(imports, numbered, max_depth, backwards=False).filter(F.col("depth") > 0)
    nodes = attach_symbols(reached.select("project", "node").distinct(), files)
    sizes = nodes.select("project", F.col("file_path").alias("node"), S.total(F.col("symbols")).alias("n_symbols"))
    counted = per_start(reached.join(sizes, ["project", "node"]), numbered, {"n_files": F.lit(1), "n_symbols": F.col("n_symbols")})
    return (
        counted.groupBy("walk", "project", "depth")
        .agg(F.sum("n_files").alias("n_files"), F.sum("n_symbols").alias("n_symbols"))
        .withColumn("level", F.when(F.col("depth") == 1, "direct").otherwise("transitive"))
    )
