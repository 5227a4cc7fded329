"""Packing against the tokenizer library, and bins against bounds and a best-fit packer."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "one Two, three's <|endoftext|> été Straße 日本語 12345 \n\n\t  x".split(" ")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def best_fit(lengths, capacity):
    free, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        used += at == len(free)
        bisect.insort(free, (free.pop(at) if at < len(free) else capacity) - n)
    return used


@pytest.mark.parametrize("seed", range(8))
def test_every_combination_fits_and_all_pieces_are_used(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 64, 500])
    lengths = [draw.randint(1, capacity if seed % 2 else capacity // 3 + 1) for _ in range(draw.choice([5, 300, 5000]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    found = packing.combinations(counts, capacity)
    assert len(found) <= sum(1 + capacity // n for n in counts)
    used = {n: 0 for n in counts}
    for chosen, times in found:
        assert times > 0 and sum(n * c for n, c in chosen.items()) <= capacity
        for n, c in chosen.items():
            used[n] += c * times
    assert used == counts
    bins = sum(times for _, times in found)
    assert -(-sum(lengths) // capacity) <= bins <= best_fit(lengths, capacity) + 1


def test_the_first_bin_is_the_fullest():
    assert packing.combinations({6: 1, 5: 1, 3: 1, 2: 1}, 10)[0] == ({6: 1, 3: 1}, 1)
    assert packing.combinations({7: 1, 2: 4, 1: 1}, 10)[0] == ({7: 1, 2: 1, 1: 1}, 1)


def test_pieces_and_places(spark, library):
    draw = random.Random(9)
    texts = [" ".join(draw.choices(WORDS, k=draw.choice([0, 1, 20, 90, 400]))) for _ in range(120)] + ["a b " * 30_000, "z" * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "null key"), (3, texts[3]), (3, "same key")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({n: F.lit(n) for n in ("ids", "task", "length", "rank", "base")})
    packed = packing.pack(table, VOCABULARY, 256, keep_ids=True)
    got = packed.collect()
    expected = []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start = 0
        first = len(ids) % 256 or 256
        while start < len(ids):
            part = ids[start : first + (0 if not start else start + 256 - first)]
            expected.append((doc, 0 if not start else (start - first) // 256 + 1, start, len(part), zlib.crc32(part.tobytes()), part.tolist()))
            start += len(part)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=repr) == sorted(expected, key=repr)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(len(ids) <= 256 for ids in whole.values()) and sum(map(len, whole.values())) == sum(r.length for r in got)
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)
    assert len(whole) <= best_fit([r.length for r in got], 256)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), VOCABULARY).count() == 0


def test_other_vocabularies_go_through_their_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encode = packing.encoder(f.read())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert [e.tolist() for e in encode(WORDS)] == [library.encode(w, add_special_tokens=False).ids for w in WORDS]


def test_both_libraries_agree_on_every_character(library):
    with open(VOCABULARY, "rb") as f:
        encode = packing.encoder(f.read())
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for start in range(0, len(marks), 1 << 16):
        texts = ["".join(f"a{c}b {c}1  {c}.\n" for c in marks[i : i + 64]) for i in range(start, min(start + (1 << 16), len(marks)), 64)]
        assert [e.tolist() for e in encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
