"""Every registered query over whole small tables: against SQL, a library, or brute force."""

import base64
import hashlib
import importlib
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from codeloom.llm import quality, sharding
from codeloom.llm.catalog import SHARDS, URL_RULES, catalog
from tests.llm import brute

entry = importlib.import_module("__spark_entry__")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text, lang from documents order by 1").fetchall()


def test_all_are_registered():
    assert set(catalog.queries) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.queries) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.sql))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries[name](spark, SF)
    expected = duck.execute(catalog.sql[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(expected.fetchall(), key=repr)


def test_token_counts_match_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in catalog.queries["op1_token_counts"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, text, _ in docs:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[doc]["n_bytes"], got[doc]["n_tokens"], got[doc]["over_limit"]) == (len(text.encode()), n, n > 2048)
        if n > 2048:
            cut = got[doc]["fit_chars"]
            counts = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in (cut, cut + 1)]
            assert counts[0] <= 2048 < counts[1]


def test_language_of_held_out_rows(spark, docs):
    got = {r["doc_id"]: r for r in catalog.queries["op2_language_id"](spark, SF).collect()}
    tested = [(got[d]["lang_pred"] == lang) for d, _, lang in docs if got[d]["held_out"]]
    assert tested and sum(tested) / len(tested) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_counts_and_verdicts(spark, duck, docs):
    got = {r["doc_id"]: r for r in catalog.queries["op4_quality"](spark, SF).collect()}
    for doc, text, _ in docs:
        counts = brute.quality_base(text)
        assert tuple(got[doc][1:6]) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert got[doc]["base_failed"] == failed and not (failed and got[doc]["kept"])
    labels = dict(duck.execute("select doc_id, quality from labels").fetchall())
    judged = [(got[d]["kept"], bool(q)) for d, q in labels.items() if not got[d]["base_failed"]]
    assert sum(a == b for a, b in judged) / len(judged) >= 0.95


def test_sharding_by_turns(spark, docs):
    owners = sharding.slot_owners(SHARDS)
    shares = [owners.count(i) for i in range(len(SHARDS))]
    assert max(shares) - min(shares) <= 1
    fewer = sharding.slot_owners(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owners, fewer, strict=True) if a != len(SHARDS) - 1)
    assert moved < 0.1 * len(owners)
    for r in catalog.queries["op5_sharding"](spark, SF).collect():
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, SHARDS[owners[slot]])


def test_url_rules_and_verdicts(spark, duck):
    urls = dict(duck.execute("select page_id, url from pages").fetchall())
    right = []
    for r in catalog.queries["op7_url_filter"](spark, SF).collect():
        rest = urls[r["page_id"]].split("://", 1)[1]
        place = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:place].translate(brute.LOWER), rest[place:].split("?")[0].split("#")[0]
        fits = [(len(t), t, v) for v, t in URL_RULES for h in [t.split("/")[0]] if (host == h or host.endswith("." + h)) and path.startswith(t[len(h) :])]
        rule = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[1])
        if rule[1]:
            assert r["verdict"] == rule[2]
            right.append((r["score"] >= 0.5) == (rule[2] == "allow"))
        else:
            assert r["verdict"] == ("allow" if r["score"] >= 0.5 else "block")
    assert sum(right) / len(right) > 0.9


def test_bpe_matches_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in catalog.queries["op10_bpe"](spark, SF).collect()}
    for doc, text, _ in docs:
        ids = library.encode_ordinary(text)
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), text.encode())]
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"], got[doc]["decoded_sha256"]) == (len(ids), *digests)
        assert got[doc]["valid_utf8"]


def test_pipeline_against_brute_force(spark, duck):
    pipeline = importlib.import_module("corpus_pipeline")
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontaminate", "bpe"]
    first = pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    kept = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert len(kept) == duck.execute("select count(*) from documents").fetchone()[0]  # all have letters
    linked, _ = brute.groups(kept, 5, 80)
    kept = [(d, t) for d, t in kept if linked[d] == d]
    kept = [(d, left if gone else t) for (d, t), (_, _, gone, left) in zip(kept, brute.repeats(kept), strict=True)]
    items = duck.execute("select item_id, text from benchmark").fetchall()
    clean = [d for d, *_, bad in brute.contamination(kept, items) if not bad]
    texts = dict(kept)
    got = {r["doc_id"]: r["decoded_sha256"] for r in pipeline.run(spark, SF).collect()}
    assert got == {d: hashlib.sha256(texts[d].encode()).hexdigest() for d in clean}


def test_quality_fit_prefers_agreeing_rules():
    import numpy as np

    patterns = np.array([[1, 1, 1, 1], [-1, -1, -1, 1], [0, 1, 1, 1], [-1, -1, 0, 1]])
    prior, chance = quality.fit_votes(patterns, np.array([900.0, 80, 50, 10]))
    assert (quality.posterior(patterns, prior, chance) > 0.5).tolist() == [True, False, True, False]
