"""Stream-driven change detection."""

from codeloom.sources.store import CodeStore
from codeloom.streaming.status import watch_status


def test_watch_status(spark, tmp_path):
    tree, inbox = tmp_path / "tree", tmp_path / "inbox"
    tree.mkdir()
    (tree / "a.ts").write_text('import "./b";\n')
    (tree / "b.ts").write_text("export const b = 1;\n")
    store = CodeStore(spark, "watched", str(tmp_path / "db"))
    schema = "project string, path string, code string, seq bigint"

    def send(*changes):
        rows = [(str(tree), str(tree / name), code, seq) for seq, (name, code) in enumerate(changes)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(inbox))

    def drain():
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        query = (
            watch_status(stream, store)
            .option("checkpointLocation", str(tmp_path / "progress"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    send(("a.ts", "??"), ("b.ts", "M"), ("b.ts", "??"))
    drain()
    assert {r.file_path[-4:] for r in store.files().collect()} == {"a.ts", "b.ts"}
    assert [(r.source_path[-4:], r.target_path[-4:]) for r in store.imports().collect()] == [("a.ts", "b.ts")]
    assert {r.code for r in store.snapshots().collect()} == {"??"}

    (tree / "b.ts").unlink()
    send(("b.ts", "D"))
    drain()
    assert {r.file_path[-4:] for r in store.files().collect()} == {"a.ts"}
    assert store.imports().count() == 0
