"""Contributions to a tree ensemble against brute force over all coalitions, and against a fitted model's own predictions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailveil import dims
from mailveil.operators import contributions, models


def grow(rng, features, depth):
    nodes = []

    def add(depth):
        place = len(nodes)
        nodes.append(None)
        if depth == 0 or rng.random() < 0.15:
            nodes[place] = contributions.Node(-1, 0.0, -1, -1, float(rng.normal(0, 40)))
        else:
            nodes[place] = contributions.Node(int(rng.integers(features)), float(rng.normal()), add(depth - 1), add(depth - 1), 0.0)
        return place

    add(depth)
    return nodes


def risk(trees, row):
    total = 0.0
    for nodes in trees:
        node = nodes[0]
        while node.feature >= 0:
            node = nodes[node.left if row[node.feature] <= node.threshold else node.right]
        total += node.value
    return min(100.0, max(0.0, total))


def test_values_equal_all_coalitions():
    rng = np.random.default_rng(3)
    group_of = [0, 0, 1, 2, 2, 3, 4, 4]
    for _ in range(20):
        trees = [grow(rng, 8, 4) for _ in range(6)]
        own, base = rng.normal(size=8).tolist(), rng.normal(size=8).tolist()
        got, mine, theirs = contributions.values(trees, own, base, group_of)

        def held(groups, own=own, base=base, trees=trees):
            return risk(trees, [own[k] if group_of[k] in groups else base[k] for k in range(8)])

        assert mine == pytest.approx(held(range(5))) and theirs == pytest.approx(held(()))
        for g in range(5):
            others = [x for x in range(5) if x != g]
            want = sum(math.factorial(n) * math.factorial(4 - n) / math.factorial(5) * (held((*s, g)) - held(s)) for n in range(5) for s in itertools.combinations(others, n))
            assert got.get(g, 0.0) == pytest.approx(want, abs=1e-9)
        assert sum(got.values()) == pytest.approx(mine - theirs)


def test_fitted_model_is_explained_in_full(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (300, len(dims.FEATURES))).astype(float)
    rows = [("c", f"S{k:03d}", *map(float, v), float(min(100, 20 * v[0] + 15 * v[8] * v[25] + 5 * v[33]))) for k, v in enumerate(x)]
    df = spark.createDataFrame([*rows, *[("d", *r[1:]) for r in rows[:5]]], ["capture_id", "session_id", *dims.FEATURES, "rule_risk"])
    model = models.train_risk(df, iterations=5, depth=4)
    told = contributions.contributions(model, df)
    sums = told.groupBy("capture_id", "session_id").agg(F.sum("phi").alias("total"), F.max("risk").alias("risk"), F.max("reference_risk").alias("base"), F.count("*").alias("n"))
    both = models.predict_risk(model, df, None).select("capture_id", "session_id", "model_risk").join(sums, ["capture_id", "session_id"]).collect()
    assert len(both) == 305 and {r.n for r in both} == {11}
    assert all(r.risk == pytest.approx(r.model_risk) and r.total == pytest.approx(r.risk - r.base) for r in both)
    assert contributions.contributions(model, df.limit(0)).collect() == []


def test_groups_partition_the_features():
    members = [name for _, group in dims.FEATURE_GROUPS for name in group]
    assert members == dims.FEATURES
