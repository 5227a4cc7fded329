"""Tables of facts that the driver could not hold beside each other are joined by a shuffle."""

from codeloom.llm import jaccard_join


def test_facts_of_a_hundred_thousand_documents_are_not_broadcast(spark):
    def hinted(rows, row_bytes):
        return "hint" in jaccard_join._fitting(spark.range(10), rows, row_bytes)._jdf.queryExecution().logical().toString().lower()

    assert hinted(10_000, 64 + 8 * jaccard_join.SKETCH)
    assert not hinted(100_000, 64 + 8 * jaccard_join.SKETCH)
