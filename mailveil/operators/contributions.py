"""Exact contributions of feature groups to the fitted risk model, against the reference session.

A session's coalition takes the groups it names from the session and the others from the reference. Instead of scoring a row for
each of the 2**k coalitions, each tree is walked once: where the session and the reference part ways at a node, the walk goes both
ways and notes that the node's group must be taken, or left. A leaf then counts for the coalitions that hold all it took and
none it left. Risks are held to 0-100, which no sum over leaves can express; so the leaves are added up for each coalition of the
k groups that some tree tells apart, the sums are held to the range, and the groups' values come from the differences.

The trees (fitted on a bounded number of nodes) go to the workers with the function; equal feature rows are explained once. A
group that no node tells apart gets 0. The values of a session add up to its risk minus the risk of the reference.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailveil import dims
from mailveil.session import ship_package

KEYS = ["capture_id", "session_id"]
LOWEST, HIGHEST = 0.0, 100.0


class Node(NamedTuple):
    """A leaf has no feature (-1) and a value, already times its tree's weight."""

    feature: int
    threshold: float
    left: int
    right: int
    value: float


def trees_of(model) -> list[list[Node]]:
    """The nodes of a fitted ensemble of regression trees, each tree from its root."""
    out = []
    for tree, weight in zip(model._java_obj.trees(), model.treeWeights, strict=True):
        nodes: list = []

        def add(node, weight=weight, nodes=nodes) -> int:
            place = len(nodes)
            nodes.append(None)
            if node.subtreeDepth() == 0:
                nodes[place] = Node(-1, 0.0, -1, -1, weight * node.prediction())
            else:
                split = node.split()
                nodes[place] = Node(split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), 0.0)
            return place

        add(tree.rootNode())
        out.append(nodes)
    return out


def reached(nodes: list[Node], own: list[float], reference: list[float], group_of: list[int]) -> Iterator[tuple[int, int, float]]:
    """(groups taken, groups left, value) of the leaves that some coalition reaches; groups are bits."""
    todo = [(0, 0, 0)]
    while todo:
        place, taken, left = todo.pop()
        node = nodes[place]
        if node.feature < 0:
            yield taken, left, node.value
            continue
        bit = 1 << group_of[node.feature]
        mine = node.left if own[node.feature] <= node.threshold else node.right
        theirs = node.left if reference[node.feature] <= node.threshold else node.right
        if mine == theirs or taken & bit:
            todo.append((mine, taken, left))
        elif left & bit:
            todo.append((theirs, taken, left))
        else:
            todo += [(mine, taken | bit, left), (theirs, taken, left | bit)]


def values(trees: list[list[Node]], own: list[float], reference: list[float], group_of: list[int]) -> tuple[dict[int, float], float, float]:
    """The value of each group that matters, and the risks of the session and of the reference."""
    leaves = [leaf for nodes in trees for leaf in reached(nodes, own, reference, group_of)]
    used = 0
    for taken, left, _ in leaves:
        used |= taken | left
    groups = [g for g in range(used.bit_length()) if used >> g & 1]
    masks = np.arange(1 << len(groups))
    risk = np.zeros(len(masks))

    def packed(bits: int) -> int:
        return sum(1 << k for k, g in enumerate(groups) if bits >> g & 1)

    for taken, left, value in leaves:
        need, without = packed(taken), packed(left)
        risk[(masks & need == need) & (masks & without == 0)] += value
    risk = np.clip(risk, LOWEST, HIGHEST)
    n, held = len(groups), np.array([m.bit_count() for m in range(len(masks))])
    weight = np.array([math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n) for s in range(n)])
    out = {}
    for k, g in enumerate(groups):
        without = masks[masks >> k & 1 == 0]
        out[g] = float((weight[held[without]] * (risk[without | 1 << k] - risk[without])).sum())
    return out, float(risk[-1]), float(risk[0])


def contributions(model, features: DataFrame) -> DataFrame:
    """capture_id, session_id, feature_group, phi, risk and reference_risk: a row for each session and group.

    `risk` is what the model says of the session, held to 0-100 but not rounded. Null features count as their reference.
    """
    ship_package(features.sparkSession)
    trees = trees_of(model)
    reference = [float(dims.FEATURE_REFERENCE.get(name, 0.0)) for name in dims.FEATURES]
    names = [name for name, _ in dims.FEATURE_GROUPS]
    group_of = [next(g for g, (_, members) in enumerate(dims.FEATURE_GROUPS) if name in members) for name in dims.FEATURES]
    vector = F.array(*[F.coalesce(F.col(name).cast("double"), F.lit(reference[k])) for k, name in enumerate(dims.FEATURES)])
    each = features.select(vector.alias("vector")).distinct()
    schema = pa.schema([("vector", pa.list_(pa.float64())), ("feature_group", pa.string()), ("phi", pa.float64()), ("risk", pa.float64()), ("reference_risk", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column(0).to_pylist():
                phi, risk, base = values(trees, own, reference, group_of)
                rows += [(own, name, phi.get(g, 0.0), risk, base) for g, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(schema))], schema=schema)

    told = each.mapInArrow(work, "vector array<double>, feature_group string, phi double, risk double, reference_risk double")
    # both sides grow with the sessions, whatever the sizes of their files suggest, so neither is sent through the driver
    return features.select(*KEYS, vector.alias("vector")).join(told.hint("merge"), "vector").drop("vector")
