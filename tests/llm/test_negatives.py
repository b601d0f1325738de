"""Scores by lookups against products, and mined rows against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import negatives as ng


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    live = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    by_rank = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for at, (i, v, c) in enumerate(live):
        if i is None or not anchors(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, d) for k, (j, w, d) in enumerate(live) if k != at]  # noqa: B905
        for s, j, _ in sorted((r for r in scored if r[2] == c), key=by_rank)[:positives]:
            window = [r for r in scored if r[2] != c and low * s <= 100 * r[0] <= high * s]
            out += [(i, j, k, r[1], s, r[0]) for k, r in enumerate(sorted(window, key=by_rank)[:negatives], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark):
    return lambda data: spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<float>, label int, block int, score string")


@pytest.mark.parametrize("d,most", [(1, 1), (8, 100), (13, 3000), (64, 145)])
def test_scores(d, most):
    rng = np.random.default_rng(d)
    rows, anchors = rng.integers(-most, most + 1, (300, d)), rng.integers(-most, most + 1, (7, d))
    planes = ng.bit_planes(rows, (most + 1).bit_length() + 1)
    assert np.array_equal(ng.scores(ng.subset_sums(anchors, np.int64), planes, 128), rows @ anchors.T)


def test_odd_rows(table):
    rng = random.Random(6)
    vector = lambda n=6: [rng.gauss(0.3, 1) for _ in range(n)]
    same = vector()
    data = [(i, vector(), rng.randrange(3)) for i in range(120)]
    data += [(200 + i, same, i % 2) for i in range(40)]  # ties
    data += [(10, same, 0), (10, same, 0), (None, same, 1), (None, vector(), 0)]  # repeated rows, null ids
    data += [(300, None, 1), (301, vector(), None), (302, [1.0, None], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 1), (310, [], 1), (320, vector(3), 2), (330, vector(11), 2), (340, [0.0] * 6, 1)]
    anchor = F.col("vec_id") % 10 == 0
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in data]
    want = brute(data, lambda i: i % 10 == 0)
    assert len(want) > 200
    assert got(ng.mine(table(data), anchor, block_rows=32)) == want
    assert got(ng.mine(table(data), anchor, 2, 7, 10, 100)) == brute(data, lambda i: i % 10 == 0, 2, 7, 10, 100)


def test_many_anchors(table, monkeypatch):
    rng = random.Random(8)
    data = [(i // 2, [float(np.float32(rng.choice((0.1, 0.4, 1.0)) * rng.choice((-1, 1, 1)))) for _ in range(4)], int(i % 20 > 12)) for i in range(320)]
    want = brute(data, lambda i: True)
    assert len(want) > 1000
    assert got(ng.mine(table(data), F.lit(True), block_rows=32)) == want  # one shard, scored in parts
    monkeypatch.setattr(ng, "ANCHORS", 64)
    assert got(ng.mine(table(data), F.lit(True), block_rows=32)) == want
    assert ng.mine(table(data), F.lit(True), 0).count() == ng.mine(table(data), F.lit(True), 5, 0).count() == 0


def test_no_table_goes_to_the_driver(table, monkeypatch):
    """The size that Spark expects of a small table says nothing about pairs of its blocks: they must not be broadcast."""
    plans, keep = [], ng.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ng, "materialise", lambda df, name: plans.append((name, plan(df))) or keep(df, name))
    rng = random.Random(9)
    data = [(i, [rng.gauss(0.3, 1) for _ in range(6)], i % 3) for i in range(200)]
    out = ng.mine(table(data), F.col("vec_id") % 10 == 0, block_rows=32)
    plans.append(("result", plan(out)))
    assert out.count() > 0
    assert [name for name, p in plans if "Broadcast" in p] == []
    assert [name for name, p in plans if "Generate" in p] == []  # nor is a block written once for every other


def test_large_components(table, spark):
    data = [(i, [float(1000 * i), float(-3 * i), 7.5], i % 2) for i in range(40)]
    assert got(ng.mine(table(data), F.col("vec_id") % 5 == 0)) == brute(data, lambda i: i % 5 == 0)
    with pytest.raises(ValueError, match="do not fit"):
        ng.mine(table([(0, [1e30], 1), (1, [1.0], 1)]), F.col("vec_id") == 0)


def test_no_rows(table):
    assert ng.mine(table([]), F.col("vec_id") == 0).count() == 0
    assert ng.mine(table([(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") == 0).count() == 0
    assert ng.mine(table([(0, [1.0], 1), (2, [0.6], 2)]), F.col("vec_id") == 0).count() == 0  # no positive


def test_table(spark, sf_dir, read):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in read("embeddings").collect()]
    assert got(ng.query(spark, sf_dir)) == brute(rows, lambda i: i % 50 == 0)
