"""Rows that repeat a key and a text are one document for the pipeline's second stage."""

from codeloom.llm import jaccard_join


def test_one_row_of_a_key_and_a_set_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [
        (1, a, "p"), (1, a, "p"), (1, a.upper(), "p"), (2, a, "q"), (None, b, "r"), (None, b, "r"), (None, c, "s"), (None, None, "t"), (None, None, "t"),
        (3, "", "u"), (3, "", "u"), (3, "one", "u"), (3, "one", "v"), (4, b + " tail", "w"), (5, "x y", "x"), (5, "other z", "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `own col` string").repartition(3)
    got = jaccard_join.drop_similar(docs)
    assert got.columns == docs.columns
    kept = sorted(((r[0], r[1]) for r in got.collect()), key=repr)
    assert kept == sorted([(1, a.upper()), (None, b), (None, c), (None, None), (None, None), (3, ""), (3, ""), (3, "one"), (4, b + " tail"), (5, "x y"), (5, "other z")], key=repr)
