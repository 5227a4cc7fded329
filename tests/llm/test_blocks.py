"""A benchmark of many blocks is fetched, broadcast and scanned block by block."""

from codeloom.llm import decontaminate


def test_one_block_at_a_time(spark, monkeypatch):
    events = []
    real_blocks, real_stored = decontaminate.benchmark_blocks, decontaminate.stored

    def blocks(*args, **named):
        for block in real_blocks(*args, **named):
            events.append("block")
            yield block

    def stored(df):
        if "spans" in df.columns:
            events.append("stored")
        return real_stored(df)

    monkeypatch.setattr(decontaminate, "benchmark_blocks", blocks)
    monkeypatch.setattr(decontaminate, "stored", stored)
    texts = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(8)]
    docs = spark.createDataFrame([(i, t + " tail") for i, t in enumerate(texts)] + [(9, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 3, "item_id bigint, text string")
    # Of the repeated items one each counts.
    size = sum(len(t) + 16 for t in texts)
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.contamination(docs, bench, block_bytes=-(-size // 3)).collect()}
    assert got == {i: (12, [str(i)]) for i in range(8)} | {9: (0, [])}
    assert events == ["block", "stored", "block", "stored", "block"]
