"""Distances of numbers and level codes against one-hot vectors laid out in full."""

import random

import numpy as np
import pytest

from tabwright.operators import knn, scale
from tabwright.operators.pivot_tree import distances


def one_hot(rows, nums, sizes):
    out = [list(r[:nums]) for r in rows]
    for i, r in enumerate(rows):
        for code, size in zip(r[nums:], sizes):
            out[i] += [1.0 if code == j else 0.0 for j in range(size)]
    return np.array(out, float)


def mixed_rows(n, seed=1):
    rng = random.Random(seed)
    return [[rng.choice([0.0, 1.5, rng.uniform(0, 9)]), rng.uniform(-2, 2), float(rng.randrange(4)), float(rng.randrange(30))] for _ in range(n)]


def test_equals_the_dense_distance():
    rows = mixed_rows(80)
    dense = one_hot(rows, 2, (4, 30))
    want = np.sqrt(((dense[:, None] - dense[None]) ** 2).sum(axis=2))
    assert np.allclose(distances(np.array(rows), np.array(rows), 2), want, atol=1e-6)


@pytest.mark.parametrize("tuning", [{}, {"leaf_rows": 16, "fan_out": 4}])
def test_search_equals_brute_force(spark, tuning):
    rows = mixed_rows(400) + [mixed_rows(1)[0]] * 40
    dense = one_hot(rows, 2, (4, 30))
    df = spark.createDataFrame(list(enumerate(rows)), "id long, vec array<double>")
    got = {}
    for r in knn.knn(df, df, 3, True, codes=2, **tuning).collect():
        got.setdefault(r["t_id"], []).append((r["rank"], r["dist"]))
    for i, found in got.items():
        d = np.sqrt(((dense - dense[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [x for _, x in sorted(found)] == pytest.approx(np.sort(d)[:3].tolist(), abs=1e-9)
    assert len(got) == len(rows)


def test_hundred_thousand_levels(spark):
    df = spark.range(200_000).selectExpr("id", "CAST(id % 1000 AS DOUBLE) AS x", "concat('level', id % 100000) AS t",
                                         "CASE WHEN id % 20000 = 7 THEN NULL ELSE concat('y', id % 100000) END AS y")
    done = scale.impute_knn(df, "y", "id", 1).where("id % 20000 = 7").collect()
    # the row with the same level and number is 100,000 away or missing itself, then the nearest of equal number
    assert len(done) == 10 and all(r["y"] is not None for r in done)
    design, codes = scale._mixed_design(df, "y", "id")
    assert codes == 1 and len(design.first()["vec"]) == 2
