"""What keeps the driver and the Python workers small."""

import numpy as np

from mailveil import dims
from mailveil.llm import rows, toxicity
from mailveil.operators import contributions, models


def test_contributions_are_not_broadcast(spark):
    """Sessions and told vectors both grow with the input; a broadcast of either passes through the driver."""
    x = np.random.default_rng(1).integers(0, 3, (200, len(dims.FEATURES))).astype(float)
    df = spark.createDataFrame([("c", f"S{k}", *map(float, v), float(20 * v[0])) for k, v in enumerate(x)], ["capture_id", "session_id", *dims.FEATURES, "rule_risk"])
    told = contributions.contributions(models.train_risk(df, iterations=2, depth=3), df)
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()


def test_runs_are_counted_in_small_pieces(spark, monkeypatch):
    """A byte of text gives up to three different runs, so a piece of some megabytes would take a gigabyte of objects."""
    seen, real = {}, rows.per_batch

    def noted(df, schema, work, most=rows.SLICE_BYTES):
        seen[work.__name__] = most
        return real(df, schema, work, most)

    monkeypatch.setattr(rows, "per_batch", noted)
    docs = spark.createDataFrame([(k, "plain words here" if k % 2 else "vile words here") for k in range(60)], "doc_id long, text string")
    toxicity.train(docs, docs.selectExpr("doc_id", "cast(1 - doc_id % 2 as int) as toxic"))
    assert seen["count_runs"] <= 1 << 18 and seen["count_windows"] <= 1 << 18
