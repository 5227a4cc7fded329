"""Enumeration of circular dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import relative_path
from codeloom.operators import components
from codeloom.schema import CYCLE_NODE_CAP
from codeloom.session import durable_counted, spread_join

def find_cycles(imports: DataFrame, max_nodes: int = CYCLE_NODE_CAP) -> DataFrame:
    """All simple cycles of 2..``max_nodes`` files as (project, cycle, length).

    Each cycle appears once, starting at its smallest path and repeating that path at the
    end. Paths grow by one file per round, only from a smallest start and only inside one
    strongly connected component; closed paths leave the loop at once.
    """
    whole, rows = components.cyclic_core(imports)
    core, core_rows = durable_counted(components.in_components(whole, components.components_of(whole, rows)))
    steps = core.select("project", F.col("s").alias("cur"), F.col("t").alias("next"))
    paths = core.filter(F.col("t") > F.col("s")).select(
        "project", F.col("s").alias("start"), F.col("t").alias("cur"), F.array("s", "t").alias("path")
    )
    closed = None
    for nodes in range(2, max_nodes + 1):
        grown, rows = durable_counted(
            spread_join(paths, steps, ["project", "cur"], F.concat_ws("|", "path"), core_rows).filter(
                (F.col("next") == F.col("start"))
                | ((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next")) & F.lit(nodes < max_nodes))
            )
        )
        done = grown.filter(F.col("next") == F.col("start")).select(
            "project", F.array_append("path", F.col("start")).alias("cycle"), F.lit(nodes).cast("bigint").alias("length")
        )
        closed = done if closed is None else closed.unionByName(done)
        paths = grown.filter(F.col("next") != F.col("start")).select(
            "project", "start", F.col("next").alias("cur"), F.array_append("path", F.col("next")).alias("path")
        )
        if rows == 0:
            break
    return closed


def relative_cycles(cycles: DataFrame) -> DataFrame:
    """Report form: project-relative paths, length in files."""
    return cycles.select(
        "project",
        F.transform("cycle", lambda p: relative_path(p, F.col("project"))).alias("cycle"),
        "length",
    )


def cycle_members(cycles: DataFrame) -> DataFrame:
    """How many cycles each file lies on, and the shortest of them."""
    return (
        cycles.select("project", F.explode(F.expr("slice(cycle, 1, size(cycle) - 1)")).alias("file_path"), "length")
        .groupBy("project", "file_path")
        .agg(F.count("*").alias("n_cycles"), F.min("length").alias("shortest"))
    )
