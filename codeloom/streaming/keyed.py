"""Change detection with a code and a number per path, kept by the stream itself instead of a snapshot table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.plans.index import incremental_index
from codeloom.session import durable
from codeloom.sources.listing import existing
from codeloom.sources.store import CodeStore

_CHANGES = "project string, path string, code string, change string"
_STATE = "projects array<string>, paths array<string>, codes array<string>, seqs array<long>"
# Groups of paths that share one state. A call of the step costs far more than a path in it.
STATE_BUCKETS = 4096


def _text(values: pd.Series) -> list[str | None]:
    return [v if isinstance(v, str) else None for v in values]


def _step(key: tuple[int], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Compare the newest row of each path of a bucket with the one kept; rows that are not newer change nothing."""
    known = {(p, f): (code, seq) for p, f, code, seq in zip(*state.get)} if state.exists else {}
    newest: dict[tuple[str | None, str | None], tuple[str | None, int]] = {}
    for part in rows:
        for p, f, code, seq in zip(_text(part["project"]), _text(part["path"]), _text(part["code"]), part["seq"].tolist()):
            kept = newest.get((p, f)) or known.get((p, f))
            if kept is None or seq > kept[1]:
                newest[p, f] = code, seq
    if not newest:
        return
    found = []
    for path, (code, _) in newest.items():
        was = known.get(path, (None, 0))[0]
        if code is None:
            change = None if was is None else "gone"
        elif code == "D":
            change = "deleted"
        else:
            change = None if code == was else "modified"
        if change:
            found.append((*path, code, change))
    known.update(newest)
    state.update((*map(list, zip(*known)), *map(list, zip(*known.values()))))
    if found:
        yield pd.DataFrame(found, columns=["project", "path", "code", "change"])


def code_changes(stream: DataFrame, buckets: int = STATE_BUCKETS) -> DataFrame:
    """(project, path, code, change) of a stream of (project, path, code, seq) status rows, in append mode.

    ``seq`` orders the rows of a path over the whole stream: within a batch the newest counts, and a row that is
    not newer than what is known, such as a replayed one, changes nothing; rows without ``seq`` are passed over.
    Changes are 'deleted' for a code 'D', 'modified' for another code than before, and 'gone' when a path that had
    a code is sent with none: it left the status, and whether it is deleted only the file system can tell. The
    state is a code and a number per path, in the stream's checkpoint folder, kept by ``buckets`` of paths: a batch
    reads and writes the buckets of its rows. A restarted stream goes on from it and needs the same ``buckets``.
    """
    bucket = F.pmod(F.xxhash64("project", "path"), F.lit(buckets)).alias("bucket")
    rows = stream.filter("seq is not null").select(bucket, "project", "path", "code", "seq")
    return rows.groupBy("bucket").applyInPandasWithState(
        _step, _CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def settled(found: DataFrame) -> DataFrame:
    """(project, path, change) where what is 'gone' is deleted unless it is still on disk."""
    gone = found.filter("change = 'gone'").select("project", "path")
    left = gone.join(existing(gone), ["project", "path"], "left_anti").selectExpr("project", "path", "'deleted' as change")
    return found.filter("change <> 'gone'").select("project", "path", "change").unionByName(left)


def watch_changes(stream: DataFrame, store: CodeStore) -> DataStreamWriter:
    """Apply a stream of (project, path, code, seq) rows to the store; no snapshot is read or written.

    A batch costs what the buckets of its rows cost. Stores polled as well keep their
    snapshots apart from this stream's state, so use one of the two for a project.
    """

    def apply(batch: DataFrame, _batch_id: int) -> None:
        found = durable(settled(durable(batch)))
        with store.change() as change:
            incremental_index(change, found)

    return code_changes(stream).writeStream.outputMode("append").foreachBatch(apply)
