"""Hard negatives against a plain version, with pruned blocks, ties, nulls and repeated rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import hard_negatives

SCHEMA = "id bigint, label bigint, vector array<bigint>"


def plain(rows, positives=5, negatives=5, low=80):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    by_id = lambda r: (r[0] is None, r[0] or 0)
    out = []
    for i, (anchor, label, v) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, r[2])), r) for j, r in enumerate(rows) if j != i]
        scored.sort(key=lambda s: (-s[0], *by_id(s[1])))
        for top, p in [s for s in scored if s[1][1] == label][:positives]:
            fits = [s for s in scored if s[1][1] != label and low * top <= 100 * s[0] <= 100 * top][:negatives]
            out += [(anchor, p[0], n, r[0], top, s) for n, (s, r) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({n: F.lit(n) for n in ("row", "length", "anchor", "window", "rank")})
    return sorted(map(tuple, hard_negatives.mine(table, F.col("id") % 100 == 0, **more).collect()), key=repr)


def cloud(n, seed=3, labels=4, spread=0.15, dims=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels * 2, dims))
    kind = draw.integers(0, labels * 2, n)
    vectors = np.floor(100 * (centres[kind] + spread * draw.normal(size=(n, dims))) * draw.choice([0.1, 1, 3], n)[:, None]).astype(int)
    return [(i, int(k % labels), v.tolist()) for i, (k, v) in enumerate(zip(kind, vectors))]


def test_clusters_of_unequal_length(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = cloud(900)
    assert mined(spark, rows) == plain(rows)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(i, i % 2, [3, 4]) for i in range(150)] + [(100, 0, [3, 4]), (100, 0, [3, 4]), (None, 1, [3, 4]), (None, 0, [3, 4])]
    rows += [(200, None, [3, 4]), (300, 1, None), (400, 0, [None, 4]), (500, 1, [0, 0]), (600, 0, []), (601, 1, [0, 0]), (700, 1, [-3, -4])]
    rows += [(7, 1, [3, 4, 9]), (800, 0, [0, 0, 5])]
    assert mined(spark, rows) == plain(rows)


def test_large_components_stay_exact(spark):
    rows = [(i * 50, i % 2, [(1 << 26) + i, (1 << 26) - 3 * i]) for i in range(12)]
    assert mined(spark, rows) == plain(rows)
    with pytest.raises(ValueError):
        mined(spark, [(0, 0, [1 << 40])])


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1])]) == []


def test_pruning_leaves_out_rows_but_none_that_count():
    rows = cloud(2000, seed=5, spread=0.05, dims=16)
    matrix = np.array([r[2] for r in rows])
    lengths = np.sqrt((matrix**2).sum(axis=1))
    order = np.argsort(hard_negatives.unit(matrix, lengths), axis=0, kind="stable").T.astype(np.uint16)
    block = hard_negatives.Block(0, pa.array(range(2000)), np.zeros(2000), matrix, order)
    anchors = matrix[::50].astype(float)
    scores = anchors @ matrix.T
    least = np.sort(scores, axis=1)[:, -20]
    whole, pruned = block.candidates(anchors, lengths[::50], least)
    kept = {a: set(r.tolist()) for a, r in pruned} | {a: set(range(2000)) for a in whole}
    assert len(pruned) > 5 and any(len(r) < 400 for _, r in pruned)
    for a in range(len(anchors)):
        assert set(np.flatnonzero(scores[a] >= least[a])) <= kept.get(a, set())
