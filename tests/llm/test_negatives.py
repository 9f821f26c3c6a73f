import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives_=10, low=30, high=90):
    rows = [(i, label, np.floor(256 * np.array(v, np.float64))) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    known = lambda i: (i is None, i or 0)
    out, seen = [], set()
    for a, label, q in rows:
        if a is None or a % every or (a, label, tuple(q)) in seen:
            continue
        seen.add((a, label, tuple(q)))
        scored = [(int(q @ v), i, own) for i, own, v in rows if len(v) == len(q)]
        order = lambda x: (-x[0], known(x[1]))
        good = sorted(((s, i) for s, i, own in scored if own == label and i != a), key=order)[:positives]
        for sp, p in good:
            bad = sorted(((s, i) for s, i, own in scored if own != label and low * sp <= 100 * s <= high * sp), key=order)[:negatives_]
            out += [(a, p, r, i, sp, s) for r, (s, i) in enumerate(bad, 1)]
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in negatives.mine(df, **how).collect()), key=repr)


def made(n, kind, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, 12))
    rows = []
    for i in range(n):
        v = rng.standard_normal(12) if kind == "gaussian" else centres[i % 8] + 0.1 * rng.standard_normal(12)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 4))))
    return rows


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
@pytest.mark.parametrize("at_once", [4096, 4])
def test_equals_brute_force(spark, kind, at_once):
    rows = made(900, kind)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    assert len(want) > 300
    assert got(df, at_once=at_once, pivots=6, sample=200) == want


def test_ties_repeats_and_nulls(spark):
    rng = random.Random(2)
    base = [[0.5, -0.25, 1.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0], [-1e-30, 0.4999, 2.0]]
    rows = [(i % 300 if i % 11 else None, rng.choice(base), rng.choice([0, 1, 1, 2, None])) for i in range(700)]
    rows += [(100, None, 1), (100, [1.0, None, 1.0], 1), (200, [1.0, float("nan"), 1.0], 1), (0, [float("inf"), 0.0, 0.0], 1), (100, [1.0, 2.0], 1), (7, [1.0, 1.5], 1), (8, [1.0, 1.0], 0), (0, [], 0), (1, [], 0), (2, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "far", "goal", "score", "rank", "slice", "dims"):
        df = df.withColumn(name, F.lit("own"))
    assert got(df) == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-(2**18), 2**18, 4)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(df) == brute(rows)


def test_brackets_hold_and_prune(spark):
    rows = made(600, "clustered", 3)
    v = np.floor(256 * np.array([r[1] for r in rows]))
    top = (v * v).sum(1).max()
    pivots = negatives.Pivots.of(v, top, 8)
    far, own = pivots.rows(v), pivots.anchors(v)
    d = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + top - 2 * v @ v.T))
    lower = np.abs(own[:, None] - far[None]).max(2)
    upper = (own[:, None] + far[None]).min(2)
    assert (lower <= d + 1e-6 * np.sqrt(top)).all() and (d <= upper + 1e-6 * np.sqrt(top)).all()
    assert (lower > np.sort(d, 1)[:, [20]]).mean() > 0.5


def test_empty_table(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
