"""Strongly connected components of the import graph, by forward-backward colouring.

Files are first trimmed away that import nothing or that nothing imports. What is left gets whole-number
ids. Every vertex then learns the least id that reaches it and the least id it reaches; both spread along
the edges at once, from the vertices that changed only. A vertex for which they are equal is in the component of
that id. Vertices of one component agree in both, so edges between vertices that differ are dropped, and
the rest goes on until no edge is left. Once few enough edges are left for one task, it takes the same steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import BROADCAST_ROWS, durable, durable_counted, hot_keys, spread_join

# Trimming stops early once a round removes less than this share, or what is left fits one task; it only saves work.
_WORTH_TRIMMING = 0.1


def trimmed(edges: DataFrame, keys: list[str], start: str, end: str, rows: int, rounds: int = 12) -> tuple[DataFrame, int]:
    """``edges`` without those that leave a vertex nothing enters or enter one that nothing leaves, and their count.

    Every edge of every cycle stays, whatever the round count. A vertex is known by ``keys`` and its end of the edge.
    """
    for _ in range(rounds):
        if rows <= BROADCAST_ROWS:
            break
        before = rows
        left = edges.select(*keys, F.col(start).alias(end)).distinct()
        entered = edges.select(*keys, F.col(end).alias(start)).distinct()
        edges, rows = durable_counted(edges.join(left, [*keys, end], "left_semi").join(entered, [*keys, start], "left_semi"))
        if before - rows <= before * _WORTH_TRIMMING:
            break
    return edges, rows


def cyclic_core(imports: DataFrame, rounds: int = 12) -> tuple[DataFrame, int]:
    """Distinct edges (project, s, t) left by trimming the graph of two or more files, and their count.

    Vertices are compared by 64-bit hashes here: two with one hash can only keep an edge more. Nothing is
    trimmed from a graph that fits one task.
    """
    ends = imports.filter(F.col("source_path") != F.col("target_path")).select(
        "project", F.col("source_path").alias("s"), F.col("target_path").alias("t")
    )
    hashed = ends.withColumns({"a": F.xxhash64("project", "s"), "b": F.xxhash64("project", "t")})
    numbers, rows = durable_counted(hashed.select("a", "b").distinct())
    kept, left = trimmed(numbers, [], "a", "b", rows, rounds)
    # A key is one edge, whose rows differ by specifier: none is hot, so the graph need not be read again to count them.
    core = hashed.join(F.broadcast(kept) if left <= BROADCAST_ROWS else kept, ["a", "b"], "left_semi")
    return durable_counted(core.select("project", "s", "t").distinct())


def _numbered(core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (project, path, v) and edges (s, t) of whole-number ids."""
    ends = core.select("project", F.explode(F.array("s", "t")).alias("path")).distinct()
    # Ids are written once, so they are the same whenever they are read.
    vertices = durable(ends.withColumn("v", F.monotonically_increasing_id()))
    source = vertices.select("project", F.col("path").alias("s"), F.col("v").alias("from"))
    target = vertices.select("project", F.col("path").alias("t"), F.col("v").alias("to"))
    edges = core.join(source, ["project", "s"]).join(target, ["project", "t"])
    return vertices, edges.select(F.col("from").alias("s"), F.col("to").alias("t"))


def _coloured(edges: DataFrame) -> DataFrame:
    """(v, into, out): the least id that reaches each vertex, and the least that it reaches."""
    both = F.array(
        F.struct(F.col("s").alias("v"), F.col("t").alias("node"), F.lit(True).alias("ahead")),
        F.struct(F.col("t").alias("v"), F.col("s").alias("node"), F.lit(False).alias("ahead")),
    )
    ways = durable(edges.select(F.inline(both)))
    seen = ways.select("v").distinct().select("v", F.col("v").alias("into"), F.col("v").alias("out"))
    state, fresh = durable_counted(seen.withColumns({"new_into": F.lit(True), "new_out": F.lit(True)}))
    hot = None
    while fresh:
        if fresh > BROADCAST_ROWS:
            hot = hot or hot_keys(ways, ["v"])
        changed = state.filter("new_into or new_out")
        told = (
            spread_join(ways, changed, ["v"], F.col("node"), fresh, hot_of=hot)
            .filter(F.when(F.col("ahead"), F.col("new_into")).otherwise(F.col("new_out")))
            .groupBy(F.col("node").alias("v"))
            .agg(F.min(F.when(F.col("ahead"), F.col("into"))).alias("by_into"), F.min(F.when(~F.col("ahead"), F.col("out"))).alias("by_out"))
        )
        less = {f"new_{c}": F.coalesce(F.col(f"by_{c}") < F.col(c), F.lit(False)) for c in ("into", "out")}
        state, fresh = durable_counted(
            state.join(told, "v", "left").select("v", F.least("into", "by_into").alias("into"), F.least("out", "by_out").alias("out"), *[x.alias(n) for n, x in less.items()]),
            F.col("new_into") | F.col("new_out"),
        )
    return state.select("v", "into", "out")


def _finished(edges: DataFrame) -> DataFrame:
    """(v, label) of the components that ``edges``, at most ``BROADCAST_ROWS`` of them, are split into: the same steps, in one task."""

    def task(batches):
        pairs = [batch for batch in batches if batch.num_rows]
        s, t = (np.concatenate([np.zeros(0, np.int64), *(b[c].to_numpy() for b in pairs)]) for c in ("s", "t"))
        ids, ends = np.unique(np.concatenate([s, t]), return_inverse=True)
        s, t = ends[: len(s)], ends[len(s) :]
        label, unsolved = np.arange(len(ids)), np.ones(len(ids), bool)
        while len(s):
            into, out = np.arange(len(ids)), np.arange(len(ids))
            before = None
            while before is None or (before[0] != into).any() or (before[1] != out).any():
                before = into.copy(), out.copy()
                np.minimum.at(into, t, into[s])
                np.minimum.at(out, s, out[t])
            done = (into == out) & unsolved
            label[done] = into[done]
            unsolved &= ~done
            kept = (into[s] == into[t]) & (out[s] == out[t]) & unsolved[s]
            s, t = s[kept], t[kept]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["v", "label"])

    return edges.coalesce(1).mapInArrow(task, "v bigint, label bigint")


def components_of(core: DataFrame, rows: int) -> DataFrame:
    """``strong_components`` of distinct edges (project, s, t) and their count."""
    vertices, edges = _numbered(core)
    edges, left = durable_counted(edges) if rows else (edges, 0)
    found = vertices.select("v", F.col("v").alias("label")).limit(0)
    while left > BROADCAST_ROWS:
        colours = _coloured(edges)
        found = found.unionByName(colours.filter("into = out").select("v", F.col("into").alias("label")))
        ends = [colours.select(F.col("v").alias(c), F.struct("into", "out").alias(f"of_{c}")) for c in ("s", "t")]
        split = edges.join(ends[0], "s").join(ends[1], "t").filter("of_s = of_t and of_s.into != of_s.out")
        edges, left = durable_counted(split.select("s", "t"))
        edges, left = trimmed(edges, [], "s", "t", left)
    if left:
        found = found.unionByName(_finished(edges))
    within = vertices.join(found, "v")
    named = within.groupBy("label").agg(F.min("path").alias("component"), F.count("*").alias("size")).filter("size > 1")
    return durable(within.join(named, "label").select("project", F.col("path").alias("file_path"), "component", "size"))


def strong_components(imports: DataFrame) -> DataFrame:
    """(project, file_path, component, size) of every file on a cycle of two or more; ``component`` is its least path."""
    return components_of(*cyclic_core(imports))


def in_components(core: DataFrame, components: DataFrame) -> DataFrame:
    """The edges (project, s, t) whose ends are in one component."""
    label = components.select("project", "file_path", "component")
    start = label.withColumnsRenamed({"file_path": "s", "component": "of_s"})
    end = label.withColumnsRenamed({"file_path": "t", "component": "of_t"})
    return core.join(start, ["project", "s"]).join(end, ["project", "t"]).filter("of_s = of_t").select("project", "s", "t")
