"""Hard negatives against scoring all rows."""

import math

import numpy as np
from pyspark.sql import types as T

from sentifold.llm import negatives

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("row", T.StringType()), T.StructField("score", T.LongType()),
])


def plain(rows):
    sound = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        sound.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for n, (a, own, x) in enumerate(sound):
        if a % 50:
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y))  # noqa: B023, B905, E731  (zeros fill up)
        ranked = sorted((-score(y), i, m, label) for m, (i, label, y) in enumerate(sound) if m != n)
        for p, positive, _, _ in [r for r in ranked if r[3] == own][:5]:
            fit = [(i, -s) for s, i, _, label in ranked if label != own and -50 * p <= -100 * s <= -95 * p]
            out += [(a, positive, k, i, -p, s) for k, (i, s) in enumerate(fit[:3], 1)]
    return sorted(out)


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    out = negatives.mined(df, **sizes)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == plain(rows)
    return got


def clusters(seed, n, d, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, d))
    label = rng.integers(10, size=n)
    x = centres[label] * (1 - spread) + rng.standard_normal((n, d)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v, int(k)) for i, v, k in zip(range(n), x.astype(np.float32).tolist(), label, strict=True)]


ODD = [
    (None, [0.5] * 24, 3), (700, None, 3), (750, [0.5] * 24, None), (800, [0.5, None], 2), (850, [float("nan")] * 24, 2), (900, [float("inf")] * 24, 2),
    (1000, [], 4), (1050, [0.25, -0.5], 4), (1100, [0.0] * 24, 5), (1001, [1.0] * 24, 4), (1001, [1.0] * 24, 4), (1050, [0.25, -0.5], 4), (-50, [-0.5] * 24, -3),
]


def test_equals_scoring_all_rows(spark):
    assert len(check(spark, clusters(1, 600, 24, 0.4) + ODD)) > 50


def test_many_units_equal_vectors_and_ties(spark):
    rows = clusters(2, 300, 5, 0.5)
    rows += [(1000 + i, rows[3][1], i % 4) for i in range(200)] + [(2000 + i, [0.5, 0.5, 0.5, 0.5, 0.0], 1) for i in range(120)]
    assert len(check(spark, rows, anchors_at_once=4, rows_at_once=100)) > 50


def test_empty_table_and_no_anchor(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, [1.0], 2), (2, [1.0], 2)]) == []


def test_large_components_are_exact(spark):
    check(spark, [(50, [4.1e6, 1e6], 1), (51, [4e6, 1e5], 1), (52, [3.3e6, 1e4], 2), (53, [3.9e6, 1.0], 1), (54, [3.5e6, 9e2], 2)])


def test_intervals_hold_every_score_and_rule_out_most():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((400, 64)) / 8)
    x[0] = 0
    turned = negatives.isometry(64)
    assert np.allclose(turned.T @ turned, np.eye(64))
    code, along, vv = negatives.codes(x, turned)
    low, high = negatives.intervals(negatives.Planes(x[:50], turned), slice(0, 50), code, along, vv, np.einsum("ij,ij->i", x, x))
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.sort(exact, axis=1)[:, -6:-5]
    assert (high < fifth).mean() > 0.3
