"""What worker processes keep between tasks."""

import numpy as np
import public_tokenizers
import tiktoken

from codeloom.llm import bpe, common, language_id, token_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read(path):
    with open(path, "rb") as f:
        return f.read()


def test_a_worker_keeps_one_model_of_all_operators():
    encoder = bpe._encoder(read(BYTE_BPE), public_tokenizers.PATTERN)
    assert bpe._encoder(read(BYTE_BPE), public_tokenizers.PATTERN) is encoder
    common._let_go("codeloom.llm.bpe")
    assert common._model[1] is encoder
    profiler = language_id._profiler(64)
    assert common._model[1] is profiler and encoder not in common._model
    common._let_go("codeloom.llm.jaccard_join")
    assert common._model == []


def test_ids_are_remembered_as_bytes():
    from tiktoken.load import load_tiktoken_bpe

    encoder = bpe.Encoder(read(BYTE_BPE), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(BYTE_BPE), special_tokens={})
    for text in ["one two, two", "a\n b", " lead", "a  b", "", "x" * 70 + " y" * 70, "日本 語 " + "🙂" * 30, "tail ", "\nx y"]:
        for _ in range(2):  # the second time from what is remembered
            assert encoder.encode(text) == library.encode_ordinary(text)
    assert {type(v) for v in encoder._of_chunk.values()} | {type(v) for v in encoder._of_piece.values()} == {bytes}


def test_prefix_tables_of_chunks_are_bytes_and_long_chunks_stay_exact():
    from tokenizers import Tokenizer

    counter, library = token_counts.PrefixCounter(read(WORD_BPE)), Tokenizer.from_file(WORD_BPE)
    long = "?!" * 20 + "日本語🙂" * 90
    for text in ["one two, two", "  a  b ", f"short {long} short", "a\n\nb", ""]:
        expected = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        for _ in range(2):
            found = counter.prefixes(text)
            assert found.dtype == np.int32 and found.tolist() == expected
    assert {type(v) for v in counter._of_chunk.values()} == {bytes}
