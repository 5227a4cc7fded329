"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bpe, components, decontaminate, jaccard_join, language_id, quality, sharding, substring_dedup, token_counts, url_filter, warc
from codeloom.llm.common import scratch
from tests.llm import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
random.seed(4)
POOL = ["".join(random.choices("abcdefghij", k=5)) for _ in range(400)]
PASSAGE = " ".join(POOL[:60])
LONG = " ".join(random.choices(POOL, k=6000))
ROWS = [
    (1, "Alpha beta " + PASSAGE + " gamma", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "en"), (5, "12 34 !!", "xx"),
    (6, "delta " + PASSAGE, "en"), (6, "delta " + PASSAGE, "en"), (7, LONG, "fr"), (8, LONG + " tail", "fr"), (None, PASSAGE, None),
    (None, None, "de"), (9, "one", "en"), (10, "ONE", "en"), (11, "x" * 5000, "en"), (12, "one two", "en"), (6, "other text of the same id", "en"),
]
NAMES = ["ids", "n_words", "kept", "doc", "text2", "component_id", "lang_pred", "slot", "shard", "c0", "mark"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string").repartition(3)
    return table.withColumns({n: F.lit(i) for i, n in enumerate(NAMES)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(rows):
    return sorted(((r[0], r[1]) for r in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_token_counts(spark, docs, empty):
    got = token_counts.token_counts(docs, WORD_BPE, budget=10, keep_prefixes=True)
    assert got.count() == len(ROWS) and token_counts.token_counts(empty, WORD_BPE).count() == 0
    assert [tuple(r) for r in got.where("doc_id = 2").collect()] == [(2, 0, 0, None, [0])]
    asked = got.where("doc_id = 1").select(
        "fit_chars", token_counts.longest_within(F.col("prefix_tokens"), F.lit(10)).alias("again"),
        token_counts.tokens_of_prefix(F.col("prefix_tokens"), F.lit(10_000)).alias("all"), "n_tokens",
    ).first()
    assert asked["fit_chars"] == asked["again"] and asked["all"] == asked["n_tokens"]


def test_prefixes_are_exact():
    from tokenizers import Tokenizer

    with open(WORD_BPE, "rb") as f:
        counter = token_counts.PrefixCounter(f.read())
    library = Tokenizer.from_file(WORD_BPE)
    for text in ["a <|endoftext|>b's it're 'll", "ünï 日本語 12!! '", "\x1c x\u00a0y", "e\u0301 Σ"]:
        read = "".join(run for run, _ in counter._runs(text))
        expected = [len(library.encode(read[:i], add_special_tokens=False).ids) for i in range(len(read) + 1)]
        assert counter.prefixes(text).tolist() == expected


def test_language(spark, docs, empty):
    prototypes = language_id.learn(docs)
    got = language_id.predict(docs, prototypes)
    assert got.count() == len(ROWS)
    assert {r["lang_pred"] for r in got.where("doc_id in (2, 3, 4, 5)").collect()} == {"und"}
    assert language_id.predict(empty, prototypes).count() == 0 and language_id.learn(empty) == {}
    assert {tuple(r)[1:] for r in language_id.predict(docs, {}).collect()} == {("und", 0.0)}
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.where("text is null").isEmpty()


def test_warc(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [
        (1, "http://a/\r\nb", "x" + fake + "y"), (2, None, None), (3, "u", ""), (None, "n", "same"), (4, "n", "same"), (5, "n", "same"),
        (6, "z", "WARC/1.0\r\n" * 50), (8, "z", fake), (9, "é", "é" * 3000 + fake + fake + "q" * 5000), (None, None, "only"),
    ]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        with scratch(spark) as folder:
            warc.write_archives(table, folder + "/a")
            assert rows_of(warc.read_digests(spark, folder + "/a")) == sorted(brute.warc(pages), key=repr)
            full = {(r["page"], bytes(r["payload"]).decode()) for r in warc.read_records(spark, folder + "/a").where("kind = 'response'").collect()}
            assert full == {(p, h or "") for p, _, h in pages if p not in (2, 4) and not (p is None and h == "same")}
            warc.write_archives(table.limit(0), folder + "/b")
            assert warc.read_digests(spark, folder + "/b").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


def test_quality(spark, docs, empty):
    got = quality.judge(docs)
    assert got.count() == len(ROWS) and quality.judge(empty).isEmpty()
    counted = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect()), key=repr)
    assert counted == sorted(((d, *brute.quality_base(t[:200] if t is LONG else t)) if t is not LONG else (d, *quality.features(t)[:5]) for d, t, _ in ROWS), key=repr)
    assert not any(r["kept"] for r in got.where("doc_id in (2, 3, 4, 9)").collect())


def test_sharding(spark, docs, empty):
    placed = sharding.place(docs, ["a", "b", "c"], slots=101)
    assert placed.count() == len(ROWS) and sharding.place(empty, ["a"], slots=3).isEmpty()
    assert {r["slot"] for r in placed.where("doc_id is null").collect()} == {0}
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.slot_owners(bad)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination(spark, docs, empty, block):
    items = [(1, PASSAGE), (2, "one"), (3, None), (None, "delta " + POOL[0]), (4, " ".join(POOL[50:70])), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs, bench, block_bytes=block)
    named = [("" if i is None else i, t) for i, t in items]
    expected = brute.contamination([(d, t) for d, t, _ in ROWS], named)
    found = sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in got.collect()), key=repr)
    assert found == sorted(expected, key=repr)
    assert decontaminate.contamination(empty, bench).isEmpty()
    assert decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and pairs(clean.select("doc_id", "text").collect()) == pairs([(d, t) for (d, t, _), e in zip(ROWS, expected, strict=True) if not e[5]])
    cut = decontaminate.decontaminate(docs, bench, "spans")
    assert cut.count() == len(ROWS) and cut.where("doc_id = 12").first()["text"] == " two"


def test_urls(spark):
    urls = [(1, "http://A.ORG/x?y#z"), (2, None), (3, "no scheme"), (4, "http://org?q"), (5, "s://a://b/c"), (None, "http://x.net/" + "p" * 20_000), (1, "http://A.ORG/x?y#z")]
    table = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(table, [("block", "org/")]).collect()}
    assert got == {
        (1, "a.org", "/x", "org/", "block"), (2, "", "", None, "block"), (3, "", "", None, "block"), (4, "org", "", None, "block"),
        (5, "a:", "//b/c", None, "block"), (None, "x.net", "/" + "p" * 20_000, None, "block"),
    }
    assert url_filter.judge_urls(table.limit(0), [("block", "org/")]).isEmpty()


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, docs, empty, size, percent):
    near = [(100 + i, " ".join(POOL[j] if j != 7 * i % 90 or i % 3 else "edit" + str(i) for j in range(90)), "en") for i in range(40)]
    table = docs.unionByName(spark.createDataFrame(near, "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    rows = [(d, t) for d, t, _ in ROWS + near]
    linked, sets = brute.groups(rows, size, percent)
    got = jaccard_join.similar_groups(table, size, percent).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, linked[d]) for d, _ in rows}
    assert sorted((repr(r["doc_id"]), r["n_shingles"]) for r in got) == sorted((repr(d), len(s)) for d, all_sets in sets.items() for s in all_sets)
    assert jaccard_join.similar_groups(empty, size, percent).isEmpty()
    kept = jaccard_join.drop_similar(table, size, percent)
    assert kept.columns == table.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(d) for d, _ in rows if linked[d] == d)


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = [(i, " ".join(POOL[j] if random.random() > 0.06 else f"e{i}-{j}" for j in range(80))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    linked, _ = brute.groups(rows, 3, 60)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(table, 3, 60).collect()} == linked


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id + 1 as a", "id as b")
    got = components.components(links).collect()
    assert len(got) == 301 and {r["component"] for r in got} == {0}


@pytest.mark.parametrize("group_rows", [4096, 1])
def test_substrings(spark, docs, empty, group_rows):
    got = substring_dedup.remove_repeats(docs, group_rows=group_rows)
    assert rows_of(got) == sorted(brute.repeats([(d, t) for d, t, _ in ROWS]), key=repr)
    assert substring_dedup.remove_repeats(empty).isEmpty()
    cut = substring_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS) and cut.where("doc_id = 4").first()["text"] == " \n\t "


def test_bpe(spark, docs, empty):
    got = bpe.encode_decode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    assert pairs((r["doc_id"], bytes(r["decoded"]).decode()) for r in got.collect()) == pairs((d, t or "") for d, t, _ in ROWS)
    assert bpe.encode_decode(empty, BYTE_BPE, public_tokenizers.PATTERN).isEmpty()


def test_streaming_decoder_and_long_pieces():
    with open(BYTE_BPE, "rb") as f:
        encoder = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    text = "ab日本🙂é" * 3000
    ids = encoder.encode(text)
    decoder = bpe.StreamDecoder(encoder.merges)
    assert b"".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) == text.encode() and decoder.finish()
    half = encoder.merges.ids[b"\xe6"] if b"\xe6" in encoder.merges.ids else None
    if half is not None:
        decoder.feed([half])
        assert not decoder.finish()
