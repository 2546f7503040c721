"""The network on many rows: numpy passes against differences, MLlib's fit and repeated runs."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabwright.operators import models, network, scoring

SIZES = [3, 5, 4, 2]


def table(spark, n=900, parts=3):
    rng = np.random.default_rng(1)
    x = rng.random((n, 3))
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, label double").repartition(parts)
    return df.select(array_to_vector(F.array("a", "b", "c")).alias("features"), "label").cache(), x, y


def test_gradient_is_that_of_small_steps():
    rng = np.random.default_rng(2)
    w, x, y = rng.normal(size=sum((a + 1) * b for a, b in zip(SIZES, SIZES[1:]))), rng.normal(size=(20, 3)), rng.integers(0, 2, 20)
    loss, gradient = network.loss_and_gradient(x, y, w, SIZES)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        above, below = (network.loss_and_gradient(x, y, w + s, SIZES)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((above - below) / 2e-6, rel=1e-4, abs=1e-6)
    assert loss > 0


def test_a_pass_covers_all_rows_and_slices_agree(spark, monkeypatch):
    df, x, y = table(spark)
    w = np.random.default_rng(3).normal(size=sum((a + 1) * b for a, b in zip(SIZES, SIZES[1:])))
    monkeypatch.setattr(network, "ROWS", 64)
    blocks = network.packed(df, 3)
    loss, gradient = network.loss_and_gradient(x, y.astype(int), w, SIZES)
    for sent in (network.SENT, 0):
        monkeypatch.setattr(network, "SENT", sent)
        got = network.passes(blocks, SIZES, 900)(w)
        assert got[0] == pytest.approx(loss / 900) and np.allclose(got[1], gradient / 900)


def test_lbfgs_finds_the_least_of_a_quadratic():
    scale = np.array([1.0, 10.0, 100.0])
    w, losses = network.lbfgs(lambda w: (float((scale * (w - 2) ** 2).sum()) + 1, 2 * scale * (w - 2)), np.zeros(3), 50, 1e-9)
    assert np.allclose(w, 2, atol=1e-4) and losses == sorted(losses, reverse=True)


def test_many_rows_are_fitted_as_well_as_by_mllib(spark, monkeypatch):
    df, x, y = table(spark)
    own = models.feed_forward(3, hidden=(5, 4), max_iter=60)
    usual = own.fit(df)
    used = []
    monkeypatch.setattr(models, "NETWORK_ROWS", 100)
    monkeypatch.setattr(network, "lbfgs", lambda *a, work=network.lbfgs: used.append(work(*a)) or used[-1])
    start = own._at(df.limit(1)).toArray()
    fitted = own.fit(df)
    first, losses = network.loss_and_gradient(x, y.astype(int), start, SIZES)[0] / 900, used[0][1]
    at_end = [network.loss_and_gradient(x, y.astype(int), m.weights.toArray(), SIZES)[0] / 900 for m in (usual, fitted)]
    assert len(used) == 1 and losses[0] == pytest.approx(first) and losses[-1] == pytest.approx(at_end[1])
    assert at_end[1] < max(1.2 * at_end[0], 0.05)
    assert scoring.roc_auc(models.score_table(fitted, df)).first()["auc"] > 0.98
    with pytest.raises(ValueError):
        own.fit(df.withColumn("label", F.lit(2.0)))
