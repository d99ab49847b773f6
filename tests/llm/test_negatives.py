"""Hard negatives in small trees and on odd rows, against every pair."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rivulet.llm import negatives


def plain(rows, anchors, positives=5, wanted=3):
    ok = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, v in ok:
        if not anchors(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j, z == y) for j, z, w in ok if j != i))
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            found = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:wanted]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(found)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def same(spark, rows, anchors, **how):
    index = negatives.Index(negatives.integer_rows(vectors(spark, rows).withColumn("leaf", F.lit("x")).withColumn("cell", F.lit(1)).repartition(3)), **how)
    got = negatives.hard_negatives(index, index.rows.where(anchors))
    assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: eval(anchors.replace("vec_id", str(i)).replace("=", "==")))
    return index


def clustered(n, dims, seed, spread=0.15):
    r = random.Random(seed)
    heads = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    return [(k, [h + r.gauss(0, spread) for h in r.choice(heads)], r.randint(0, 3)) for k in range(n)]


def test_deep_trees_rule_leaves_out(spark):
    rows = clustered(900, 6, 4)
    index = same(spark, rows, "vec_id % 40 = 0", fan=4, leaf=12, cell=50)
    assert index.tree.leaves > 30
    # windows that are narrow reach few of the leaves
    q = np.array([np.floor(256 * np.float32(v).astype(float)) for _, v, _ in rows[:20]])
    top = np.sort((q @ q.T), axis=1)[:, -2:-1].astype(np.int64)
    reached = sum(len(at) for _, at in index.tree.left(q, top, top + 10))
    assert reached < 0.5 * index.tree.leaves * len(q)


def test_hot_leaves_ties_and_a_small_sample(spark):
    rows = clustered(200, 4, 9) + [(1000 + k, [1.0, 2.0, 0.5, 0.0], k % 3) for k in range(300)] + [(2000 + k, [0.5, 1.5, 0.5, 0.0], k % 2) for k in range(40)]
    index = same(spark, rows, "vec_id % 60 = 0", sample=100, fan=4, leaf=20, cell=32)
    assert (index.cells[:, 1] > 1).any()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [0.1 * k, 1.0 - 0.05 * k, 0.3], k % 2) for k in range(12)]
    rows += [(20, None, 1), (21, [None, 1.0, 0.0], 1), (22, [nan, 1.0, 0.0], 0), (23, [inf, 0.0, 0.0], 0), (24, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (25, [], 0), (26, [0.7], 1), (0, [0.0, 1.0, 0.3], 0), (0, [0.5, 0.5, 0.5], 1), (30, [0.0, 0.0, 0.0], 0), (31, [0.0, 0.0, 0.0], 1)]
    same(spark, rows, "vec_id % 5 = 0", fan=2, leaf=3, cell=4)
    same(spark, rows[:1], "vec_id % 5 = 0")
    same(spark, [], "vec_id % 5 = 0")


def test_sums_that_doubles_cannot_hold(spark):
    rows = [(k, [100_003.0 * (1 + k % 3) + k, 90_001.0 + k, 7.0], k % 2) for k in range(14)]
    index = same(spark, rows, "vec_id % 5 = 0", fan=2, leaf=4, cell=5)
    assert index.exact
    rows = [(k, [100_003.0 * (900 + k % 3) + 64 * k, 900_001.0 * 64 + 64 * k, 7.0], k % 2) for k in range(14)]
    assert not same(spark, rows, "vec_id % 5 = 0", fan=2, leaf=4, cell=5).exact
