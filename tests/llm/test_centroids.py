"""Centroid clustering against plain integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sequor.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k, rounds, dim, scale=64, seed=1):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda j: (apart(v, c[j]), j))
    for _ in range(rounds):
        who = [near(v) for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), w in zip(kept, who) if w == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, near(v), apart(v, c[near(v)])) for i, v in kept]
    inertia = [sum(d for _, w, d in out if w == j) for j in range(len(c))]
    top = (1 << 63) - 1
    return [(i, j, min(d, top), min(inertia[j], top), min(sum(inertia), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out]


def vectors(scale):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(8)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 7), (203, [1.0] * 7 + [None]), (204, [float("nan")] + [0.0] * 7), (205, [float("inf")] * 8), (206, [1.0] * 9)]
    return rows + rows[:5] + [(None, [0.5] * 8), (None, [0.25] * 8)] + [(i, rows[0][1]) for i in range(300, 340)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 2e9, 1e30, 1.7e308])
def test_cluster_equals_plain_integers(spark, scale):
    rows = vectors(scale)
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, centroids.cluster(df, k=6, dim=8).collect()), key=str)
    assert got == sorted(plain(rows, 6, 3, 8), key=str)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "a"), (3, [5.0, 0.0], "a")], SCHEMA)
    assert sorted(map(tuple, centroids.cluster(df, k=16, dim=2).collect())) == sorted(plain([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 0.0])], 16, 3, 2))
    assert centroids.cluster(df.limit(0), dim=2).count() == 0
    assert centroids.cluster(df, dim=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_choose_the_arithmetic():
    assert centroids._exact_type((1 << 53) - 1) is np.float64 and centroids._exact_type(1 << 53) is np.int64 and centroids._exact_type(1 << 63) is object
    rng = np.random.default_rng(0)
    for most in (1 << 20, 1 << 23, 1 << 27, 1 << 40):
        x = rng.integers(-most, most, (50, 16)).astype(np.float64)
        c = np.array([[int(v) for v in r] for r in rng.integers(-most, most, (5, 16))], dtype=object)
        who, apart = centroids.nearest(x, c)
        want = [[sum((int(a) - b) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
        assert who.tolist() == [w.index(min(w)) for w in want] and [int(v) for v in apart] == [min(w) for w in want]
        assert centroids.sums(x, who, 5).tolist() == [[sum(int(v) for v, w in zip(col, who) if w == j) for col in x.T] for j in range(5)]
