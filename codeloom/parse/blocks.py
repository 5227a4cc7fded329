"""Nesting for languages whose blocks end with a keyword."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.parse.lexing import before, FILE, so_far, running


def nest(rows: DataFrame, opens: Column, closes: Column, closed_to_view: Column) -> DataFrame:
    """Add ``hidden`` and ``node_end`` to token rows.

    ``opens`` / ``closes`` flag block and bracket tokens; ``closed_to_view`` flags openers
    whose inside is not searched for declarations. ``hidden`` counts such openers around a
    token; ``node_end`` is where an opener's matching closer stops.

    Openers and closers of one nesting level alternate, so each finds its partner as its
    neighbour in a window over (file, level).
    """
    flagged = rows.withColumn("opens", opens).withColumn("closes", closes & ~opens)
    level = running(F.col("opens"), so_far()) - running(F.col("closes"), before())
    flagged = flagged.withColumn("level", F.when(F.col("opens") | F.col("closes"), level))
    by_level = Window.partitionBy(*FILE, "level").orderBy("i")
    shut = F.coalesce(closed_to_view, F.lit(False)) & F.col("opens")
    paired = flagged.withColumn("shut", shut).select(
        "*",
        F.when(F.col("opens"), F.lead("stop").over(by_level)).alias("node_end"),
        F.coalesce(F.col("closes") & F.lag("shut").over(by_level), F.lit(False)).alias("reopens"),
    )
    hidden = running(F.col("shut"), before()) - running(F.col("reopens"), before())
    return paired.withColumn("hidden", hidden)
