"""Teachers fitted together, and binned densities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import audit, profile
from tabwright.session import stored


def plain_fit(x, y, l2=1.0):
    """Newton's method for one model, by itself."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ w)
    return w


def table(spark, n, seed, shift):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, rng.normal(shift, 1, 3))) for i in range(n)], "id long, `a.b` double, c double, d double")


COLS = ["a.b", "c", "d"]


def test_equals_separate_fits_and_shards_are_equal(spark):
    rows = stored(audit.equal_shards(table(spark, 430, 1, 0.7), table(spark, 900, 2, 0.0), COLS, "id", 6))
    got = rows.toPandas()
    assert got.groupby(["shard", "_y"]).size().tolist() == [430 // 6] * 12
    weights = audit.fit_teachers(rows, COLS, 6)
    for i in range(6):
        mine = got[got["shard"] == i]
        assert weights[i] == pytest.approx(plain_fit(mine[COLS].to_numpy(), mine["_y"].to_numpy()), abs=1e-6)


def test_passes_do_not_depend_on_the_number_of_teachers(spark):
    jobs = {}
    for k in (2, 12):
        rows = stored(audit.equal_shards(table(spark, 600, 1, 0.7), table(spark, 600, 2, 0.0), COLS, "id", k))
        spark.sparkContext.setJobGroup(f"teachers-{k}", "")
        audit.fit_teachers(rows, COLS, k)
        jobs[k] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"teachers-{k}"))
        spark.sparkContext.setJobGroup("", "")
    assert jobs[12] <= jobs[2] + 6


def test_separable_shards_end(spark):
    rows = spark.createDataFrame([(0, float(i > 9), float(i - 9.5) * 100) for i in range(20)], "shard int, _y double, x double")
    weights = audit.fit_teachers(rows, ["x"], 1)
    assert np.isfinite(weights).all() and weights[0, 1] > 0
    with pytest.raises(ValueError):
        audit.equal_shards(rows.limit(1).withColumn("id", F.lit(1)), rows.withColumn("id", F.lit(1)), ["x"], "id", 4)


def test_labels_stay_in_a_small_budget(spark):
    cand = table(spark, 400, 2, 0.0)
    got = audit.pate_ensemble(table(spark, 400, 1, 4.0), cand, COLS, "id", 40, epsilon=40.0)
    assert 0 < got.count() <= 400 and got.agg(F.max("epsilon_spent")).first()[0] >= 0
    assert audit.pate_ensemble(table(spark, 400, 1, 4.0), cand, COLS, "id", 5).count() < got.count()  # the default budget is 1
    votes = audit.teachers_say(cand, COLS, "id", np.array([[0.0, 1.0, 0.0, 0.0], [9.0, 0.0, 0.0, 0.0]])).collect()
    assert {r["n0"] + r["n1"] for r in votes} == {2} and {r["n1"] for r in votes} == {1, 2}


def test_binned_curve_keeps_its_error(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 3000), rng.normal(9, 0.3, 1000)])
    df = spark.createDataFrame([(float(v), "g" if i % 3 else "h", 5.0) for i, v in enumerate(values)], "x double, g string, flat double")
    exact = {(r["g"], r["i"]): (r["x"], r["density"]) for r in profile.kde_curve(df, "x", 64, by="g").collect()}
    rows = profile.binned_curves(df, ["x", "flat"], 64, by="g").collect()
    got = {(r["g"], r["i"]): (r["x"], r["density"]) for r in rows if r["column"] == "x"}
    assert got.keys() == exact.keys()
    for g in "gh":
        mine = values[[i for i in range(len(values)) if ("g" if i % 3 else "h") == g]]
        h = mine.std(ddof=1) * len(mine) ** -0.2
        bins = 2 ** np.ceil(np.log2(16 * np.ptp(mine) / h))
        bound = (np.ptp(mine) / bins) ** 2 / (8 * h ** 3 * np.sqrt(2 * np.pi))
        assert bound < 0.0005 / (h * np.sqrt(2 * np.pi))
        assert all(abs(got[g, i][1] - exact[g, i][1]) <= bound + 1e-12 and got[g, i][0] == pytest.approx(exact[g, i][0]) for i in range(64))
    assert all(r["density"] is None for r in rows if r["column"] == "flat")


def test_columns_of_more_than_ten_values_get_curves(spark):
    df = spark.range(400).select(*[(F.col("id") % n).cast("double").alias(f"c{n}") for n in (1, 9, 10, 11, 12, 300)], F.col("id").cast("string").alias("t"))
    assert profile.many_valued(df, df.columns[:-1]) == ["c11", "c12", "c300"]
    curves, shares = profile.compare_values(df, df.where("c300 < 50"), df.columns)
    assert {r["column"] for r in curves.select("column").distinct().collect()} == {"c11", "c12", "c300"}
    assert {r["column"] for r in shares.select("column").distinct().collect()} == {"c1", "c9", "c10", "t"}
    none, _ = profile.compare_values(df, df, ["t"])
    assert none.count() == 0
