"""Connected components of a link table by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node of ``links`` (``a``, ``b``).

    Each round takes the smallest label among neighbours, with partial sums before the shuffle,
    then follows labels of labels, so the number of rounds grows with the logarithm of a
    chain's length. Every round is stored.
    """
    edges = stored(
        links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct()
    )
    labels = stored(edges.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        seen = edges.join(labels, "node").groupBy("to").agg(F.min("component").alias("m")).withColumnRenamed("to", "node")
        nearer = labels.join(seen, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        roots = nearer.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = nearer.join(roots, "component").select("node", F.least("component", "root").alias("component"), (F.col("root") < F.col("old")).alias("moved"))
        jumped = stored(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return labels
