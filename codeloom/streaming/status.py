"""Change detection driven by a stream of status rows instead of by polling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codeloom.operators import changes
from codeloom.plans.index import incremental_index
from codeloom.session import durable
from codeloom.sources.listing import existing
from codeloom.sources.store import CodeStore


def watch_status(stream: DataFrame, store: CodeStore) -> DataStreamWriter:
    """Apply a stream of (project, path, code, seq) rows to the store, batch by batch.

    Within a batch the newest row of a path counts. Rows of earlier batches stay in force
    until replaced, so a batch is compared with the snapshot and merged into it. Replaying
    a batch finds no difference and changes nothing.
    """

    def apply(batch: DataFrame, _batch_id: int) -> None:
        latest = batch.groupBy("project", "path").agg(F.max_by("code", "seq").alias("code"))
        latest = durable(latest)
        roots = latest.select("project").distinct()
        last = durable(store.snapshots().join(roots, "project", "left_semi").select("project", "path", "code"))
        current = durable(
            last.join(latest, ["project", "path"], "left_anti").unionByName(latest)
        )
        found = durable(changes.diff_status(last, current, existing(last)))
        with store.change() as change:
            incremental_index(change, found)
            change.save_status(roots, current)

    return stream.writeStream.foreachBatch(apply)
