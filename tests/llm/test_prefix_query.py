"""op1_token_counts builds the prefix table of every text and reads count and cut from it."""

import pyarrow as pa
import public_tokenizers

from codeloom.llm import token_counts
from codeloom.llm.catalog import catalog


class Table:
    """Stands for a broadcast vocabulary."""

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        value = f.read()


def test_counts_and_cuts_come_from_the_table(monkeypatch):
    texts = ["one two three's <|endoftext|> ünï 日本語", "", None, "alpha beta " * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["k", "t"])
    apart = next(token_counts._task("k", "t", Table, 10, False)(iter([batch])))

    def never(*_):
        raise AssertionError("counted beside the table")

    monkeypatch.setattr(token_counts.PrefixCounter, "count", never)
    monkeypatch.setattr(token_counts.PrefixCounter, "longest", never)
    found = next(token_counts._task("k", "t", Table, 10, True)(iter([batch])))
    assert found.select(["k", "n_bytes", "n_tokens", "fit_chars"]).equals(apart)


def test_the_query_keeps_prefixes(monkeypatch, spark, tmp_path):
    asked = {}
    real = token_counts.token_counts

    def counts(*args, **named):
        asked.update(named)
        return real(*args, **named)

    monkeypatch.setattr(token_counts, "token_counts", counts)
    spark.createDataFrame([(1, "one two")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries["op1_token_counts"](spark, str(tmp_path))
    assert asked["keep_prefixes"] and [tuple(r)[2:] for r in got.collect()] == [(2, False, None)]
