"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting.

Every feature of a text is cut into bins at quantiles. In each round, feature by feature, a shallow tree over the bins of one
feature is fitted to what the model still gets wrong and added, shrunk, to that feature's lookup table; after that the same
is done for the pairs of features that leave the largest interactions, on grids of coarser bins. A score is the logistic
value of the sum of one table entry for each feature and pair, so scoring is binning and additions on whole columns.

Training reads at most `SAMPLE` labelled rows (their features, never their texts, come to the driver); scoring reads every
text whole. Empty, null and wordless texts have zero features and get the tables' value there. Rows that repeat an id are
scored each for itself; other columns are left out. Without both labels the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import features, rows

SAMPLE, FOLDS, HELD, CUT = 16_000, 4, 2, 0.7
BINS, GRID, PAIRS, ROUNDS, RATE, LEAVES = 64, 8, 8, 60, 0.15, 4
#: Least rows' weight of a leaf, and what is added to it.
LEAST, PENALTY = 4.0, 1.0


@dataclass
class Model:
    """Bin edges of the features, an additive table for each, and grids for pairs of them."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        cells = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.coarse)]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            total += grid[cells[i], cells[j]]
        return rows.sigmoid(total)


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Leaf values, by bin, of a tree of at most LEAVES leaves over ordered bins, grown by the best split."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + PENALTY)
    leaves = [(0, len(gradient))]
    while len(leaves) < LEAVES:
        best = None
        for a, b in leaves:
            c = np.arange(a + 1, b)
            c = c[(h[c] - h[a] >= LEAST) & (h[b] - h[c] >= LEAST)]
            if len(c):
                won = gain(a, c) + gain(c, b) - gain(a, b)
                k = int(np.argmax(won))
                if won[k] > 1e-9 and (best is None or won[k] > best[0]):
                    best = (won[k], a, b, int(c[k]))
        if best is None:
            break
        _, a, b, c = best
        leaves[leaves.index((a, b)):leaves.index((a, b)) + 1] = [(a, c), (c, b)]
    out = np.zeros(len(gradient))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + PENALTY)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the single features, then of the pairs with the largest interactions."""
    if len(y) == 0 or y.min() == y.max():
        return Model([], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), [])
    edges = [_cuts(x[:, k], BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for k, cell in enumerate(cells):
            p = rows.sigmoid(total)
            step = RATE * _tree(np.bincount(cell, y - p, len(tables[k])), np.bincount(cell, p * (1 - p), len(tables[k])))
            tables[k] += step
            total += step[cell]
    coarse = [_cuts(x[:, k], GRID) for k in range(x.shape[1])]
    cells = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]
    p = rows.sigmoid(total)
    found = []
    for i in range(len(cells)):
        for j in range(i):
            cell, shape = cells[i] * (len(coarse[j]) + 1) + cells[j], (len(coarse[i]) + 1) * (len(coarse[j]) + 1)
            g, h = np.bincount(cell, y - p, shape), np.bincount(cell, p * (1 - p), shape)
            found.append((float((g**2 / (h + PENALTY)).sum()), i, j))
    pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(ROUNDS // 2):
        for (i, j), grid in zip(pairs, grids, strict=True):
            p = rows.sigmoid(total)
            cell = cells[i] * grid.shape[1] + cells[j]
            g, h = (np.bincount(cell, v, grid.size).reshape(grid.shape) for v in (y - p, p * (1 - p)))
            # A shallow tree on one feature of the pair, then one on the other inside each of its leaves.
            outer = _tree(g.sum(1), h.sum(1))
            step = np.zeros_like(grid)
            for leaf in np.unique(outer):
                mine = outer == leaf
                step[mine] = RATE * _tree(g[mine].sum(0), h[mine].sum(0))
            grid += step
            total += step.ravel()[cell]
    return Model(edges, base, tables, coarse, pairs, grids)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled rows of the training folds."""
    chosen = rows.labelled_sample(docs, labels, "quality", rows.fold("doc_id", FOLDS) == HELD, sample)

    def work(text, label):
        return {"label": label, "x": list(features.matrix(text.to_pylist()))}

    seen = rows.per_batch(chosen, pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))]), work).toPandas()
    x = np.array(seen["x"].tolist(), float).reshape(len(seen), len(features.NAMES))
    return fit(x, seen["label"].to_numpy(float))


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def work(doc_id, held_out, text):
        return {"doc_id": doc_id, "held_out": held_out, "score": model.score(features.matrix(text.to_pylist()))}

    source = docs.select(F.col("doc_id").cast("long"), rows.fold("doc_id", FOLDS) == HELD, F.coalesce("text", F.lit("")))
    return rows.per_batch(source, SCORED, work).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, by a model of the labelled ones outside the held-out fold."""
    docs = rows.documents(spark, folder)
    return score(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
