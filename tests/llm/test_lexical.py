"""Ranked search against a plain version, with skipped blocks, ties, nulls and repeated rows."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=20):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counted = [(d, c, c.total()) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for d, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(times * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            scored.append((-score, d is None, d or 0, d))
        scored = sorted(s for s in scored if s[0] < 0)[:k]
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(scored, 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    clash = {n: F.lit(n) for n in ("query", "rank", "score", "n", "terms", "group")}
    return sorted(map(tuple, lexical.search(docs.withColumns(clash), items.withColumns(clash), k).collect()), key=repr)


def corpus(n, seed=1):
    draw = random.Random(seed)
    pool = ["".join(draw.choices("abcdeéß日1", k=4)) for _ in range(300)]
    topics = [draw.sample(pool, 40) for _ in range(12)]
    docs = [(i, " ".join(draw.choices(draw.choice(topics), k=draw.choice([0, 3, 30, 300])))) for i in range(n)]
    items = [(i, "; ".join(draw.choices(draw.choice(topics), k=draw.choice([1, 5, 30])))) for i in range(25)]
    return docs, items


def test_small_shards_and_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 200)
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "PER_PIVOT", 4)
    monkeypatch.setattr(lexical, "GROUP_TERMS", 60)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 500)
    docs, items = corpus(700)
    assert found(spark, docs, items, 7) == plain(docs, items, 7)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    docs, items = corpus(60)
    docs += [(None, "alpha Beta"), (None, None), (61, None), (62, ""), (63, " .;"), (64, "ALPHA beta"), (64, "alpha beta"), (5, "alpha beta")]
    docs += [(100 + i, "alpha beta") for i in range(40)] + [(70, "alpha " * 200_000)]
    items += [(None, "beta"), (1, "alpha alpha BETA"), (90, None), (91, "..."), (92, "nowhere"), (1, "alpha alpha BETA")]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(5)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_blocks_are_skipped_and_summaries_are_exact():
    draw = np.random.default_rng(2)
    queries = [Counter({int(t): 1 for t in draw.choice(40, 3, replace=False)}) for _ in range(6)]
    (group,) = lexical.groups(queries)
    topic = draw.integers(0, 4, 3000)
    here = draw.random((3000, len(group.terms))) < np.where(np.arange(len(group.terms)) % 4 == topic[:, None], 0.6, 0.02)
    factors = np.where(here, draw.integers(1, 1_000_000, here.shape), 0).astype(np.int32)
    weights = draw.integers(1, 9000, len(group.terms))
    shard = lexical.Shard(group, factors, *lexical.Shard.build(group, factors, weights))
    for c, partners in enumerate(group.partners):
        blocks = shard.members[shard.first[c] : shard.first[c + 1]]
        assert sorted(np.concatenate(blocks)) == list(np.flatnonzero(factors[:, c]))
        assert max(map(len, blocks)) <= lexical.BLOCK
        for rows, summary in zip(blocks, shard.summaries[c], strict=True):
            assert (summary == factors[rows][:, partners].max(axis=0)).all()
    seen = 0
    for _, columns, times in group.queries:
        scores = factors[:, columns].astype(np.int64) @ (weights[columns] * times)
        worst, got = 1, np.zeros(0, np.int64)
        asked = shard.scores(columns, weights[columns] * times, 1, 10)
        part = next(asked, None)
        while part:
            seen += len(part[0])
            got = np.sort(np.concatenate([got, part[1]]))[-10:]
            worst = int(got[0]) if len(got) == 10 else 1
            try:
                part = asked.send(worst)
            except StopIteration:
                part = None
        assert (got == np.sort(scores)[-10:]).all()
    assert seen < 0.9 * sum((factors[:, c].any(axis=1)).sum() for _, c, _ in group.queries)
