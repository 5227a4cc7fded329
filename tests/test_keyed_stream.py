"""Change detection with a state per path."""

import random

from pyspark.sql import functions as F

from codeloom.operators.changes import diff_status
from codeloom.sources.store import CodeStore
from codeloom.streaming.keyed import code_changes, watch_changes

SCHEMA = "project string, path string, code string, seq bigint"


def drain(writer, folder):
    query = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_same_changes_as_the_batch_diff(spark, tmp_path):
    """The stream is restarted for every batch; late and replayed rows change nothing."""
    draw = random.Random(5)
    known: dict[str, tuple[str | None, int]] = {}
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    sent, seq, expected = [], 0, []
    for number in range(3):
        rows = []
        for _ in range(30):
            seq += 1
            rows.append(("p", f"f{draw.randrange(12)}", draw.choice(["M", "??", "D", "A", None]), seq))
        rows += draw.sample(sent, min(5, len(sent)))  # again
        rows.append(("p", "f1", "M", None))
        sent += rows[:30]
        before = {k: c for k, (c, _) in known.items() if c is not None}
        newer = set()
        for _, path, code, at in rows:
            if at is not None and at > known.get(path, (None, 0))[1]:
                known[path] = (code, at)
                newer.add(path)
        after = {k: c for k, (c, _) in known.items() if c is not None}
        frames = [spark.createDataFrame([("p", k, c) for k, c in d.items()], "project string, path string, code string") for d in (before, after)]
        diff = diff_status(*frames, frames[0].limit(0).select("project", "path")).collect()
        expected += [(number, r.path, r.change) for r in diff if r.path in newer]

        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(SCHEMA).parquet(inbox)
        writer = code_changes(stream).withColumn("n", F.lit(number)).writeStream.format("parquet").option("path", out)
        drain(writer, tmp_path / "progress")
    got = [(r.n, r.path, "deleted" if r.change == "gone" else r.change) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(expected)
    assert any(r.change == "gone" for r in spark.read.parquet(out).collect())


def test_watch_changes(spark, tmp_path):
    tree, inbox = tmp_path / "tree", str(tmp_path / "inbox")
    tree.mkdir()
    (tree / "a.ts").write_text('import "./b";\n')
    (tree / "b.ts").write_text("export const b = 1;\n")
    (tree / "c.ts").write_text("export const c = 1;\n")
    store = CodeStore(spark, "keyed", str(tmp_path / "db"))

    def send(*rows):
        data = [(str(tree), str(tree / name), code, seq) for name, code, seq in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)
        drain(watch_changes(spark.readStream.schema(SCHEMA).parquet(inbox), store), tmp_path / "progress")

    send(("a.ts", "??", 1), ("b.ts", "M", 2), ("b.ts", "??", 3), ("c.ts", "M", 4))
    assert {r.file_path[-4:] for r in store.files().collect()} == {"a.ts", "b.ts", "c.ts"}
    assert [(r.source_path[-4:], r.target_path[-4:]) for r in store.imports().collect()] == [("a.ts", "b.ts")]
    (tree / "b.ts").unlink()
    send(("b.ts", None, 5), ("c.ts", None, 6), ("a.ts", "D", 0))  # gone, committed and late
    assert {r.file_path[-4:] for r in store.files().collect()} == {"a.ts", "c.ts"}
    assert store.imports().count() == 0
    assert store.snapshots().count() == 0


def test_paths_share_states(spark, tmp_path):
    """Many paths are few states, and each path is still compared with its own code."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(2000).selectExpr("if(id % 100 = 0, null, 'p') as project", "if(id = 7, null, 'f' || id) as path", "'M' as code", "id as seq")
    for again in (rows, rows.withColumn("seq", F.col("seq") + 5000).withColumn("code", F.expr("if(seq % 2 = 0, 'A', 'M')"))):
        again.write.mode("append").parquet(inbox)
        found = code_changes(spark.readStream.schema(rows.schema).parquet(inbox), buckets=8)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) == 8
    got = spark.read.parquet(out)
    assert got.filter("code = 'M'").count() == 2000 and got.filter("code = 'A'").count() == 1000
    assert got.filter("path is null").count() == 1 and got.filter("project is null").count() == 40
