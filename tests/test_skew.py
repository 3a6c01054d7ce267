import random

import pytest
from pyspark.sql import functions as F

from sequor.operators import components
from sequor.operators.skew import hot_limit, join_hot


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot_equals_a_join(spark, how):
    rows = spark.createDataFrame([(0, i) for i in range(60)] + [(i % 7, i) for i in range(40)] + [(None, 1), (99, 2)], "k int, v int")
    facts = spark.createDataFrame([(i, f"f{i}") for i in range(7)], "k int, f string")
    got = sorted(map(tuple, join_hot(rows, facts, "k", 20, how).collect()), key=str)
    assert got == sorted(map(tuple, rows.join(facts, "k", how).select("k", "v", "f").collect()), key=str)


def test_hot_keys_are_bounded():
    assert hot_limit(10) == 2_000 and hot_limit(10**12) * 50_000 == 10**12


@pytest.mark.parametrize("hub", ["least", "greatest", "middle"])
def test_a_star_of_a_third_of_all_nodes_stays_spread(spark, monkeypatch, hub):
    """The rows of the hub's key never meet in one task: no shuffled side of a join holds it."""
    n = 3000
    at = {"least": 0, "greatest": n + 1, "middle": n // 2}[hub]
    pairs = [(at, i) for i in range(1, n // 3) if i != at] + [(n + 10 + i, n + 11 + i) for i in range(0, 200, 2)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(components, "hot_limit", lambda rows: 100)
    largest = []
    true = components.join_hot

    def watched(rows, facts, key, limit):
        hot = {r[key] for r in rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()}
        out = true(rows, facts, key, limit)
        left = [r.n for r in rows.where(~F.col(key).isin(*hot) if hot else F.lit(True)).groupBy(key).agg(F.count("*").alias("n")).collect()]
        largest.append(max(left, default=0))
        return out

    monkeypatch.setattr(components, "join_hot", watched)
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    star = {at, *(i for i in range(1, n // 3))}
    assert all(got[x] == min(star) for x in star) and all(got[n + 11 + i] == n + 10 + i for i in range(0, 200, 2))
    assert max(largest) <= 100


def test_components_of_random_graphs(spark):
    rng = random.Random(11)
    for n, m in ((30, 20), (60, 60), (40, 200)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        up = list(range(n))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            p, q = sorted((root(a), root(b)))
            up[q] = p
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a int, b int"), "a", "b").collect()}
        assert got == {x: root(x) for a, b in pairs for x in (a, b) if a != b}
