"""What worker processes keep between tasks."""

import public_tokenizers

from codeloom.llm import bpe, common


def test_a_chunk_of_one_piece_is_remembered_once():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        encoder = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    whole = encoder.encode("so many words, so few")
    assert {"many", "words,"} <= set(encoder._of_chunk)
    assert " many" not in encoder._of_piece and " words" in encoder._of_piece
    assert encoder.encode("so many words, so few") == whole
    assert bpe.StreamDecoder(encoder.merges).feed(whole) == b"so many words, so few"


def test_memory_is_given_back_when_a_task_ends(spark, monkeypatch):
    class Rows:
        sparkSession = spark

        def mapInArrow(self, run, schema):
            return run

    seen = []
    monkeypatch.setattr(common, "_give_back", lambda: seen.append("given back"), raising=False)
    run = common.arrow_map(Rows(), lambda batches: iter(batches), "n int")
    assert [seen.append(b) for b in run(iter([1, 2]))] and seen[-3:] == [1, 2, "given back"]
