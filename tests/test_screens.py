"""Supervised bins, Boruta's test, one-hot names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabwright.operators import categorical, screens


def test_blocks_are_monotone_and_pool_equal_rates():
    rng = random.Random(1)
    for _ in range(200):
        counts = [(n, rng.randint(0, n)) for n in (rng.randint(1, 9) for _ in range(rng.randint(1, 12)))]
        blocks = screens._monotone_blocks(counts)
        rates = [sum(e for _, e in counts[a:b + 1]) / sum(n for n, _ in counts[a:b + 1]) for a, b in blocks]
        assert blocks[0][0] == 0 and blocks[-1][1] == len(counts) - 1 and all(y[0] == x[1] + 1 for x, y in zip(blocks, blocks[1:]))
        assert rates == sorted(set(rates)) or rates == sorted(set(rates), reverse=True)
        fewer = screens._fewer_blocks(counts, blocks, 2, 0.5)
        assert len(fewer) <= 2 and fewer[0][0] == 0 and fewer[-1][1] == len(counts) - 1


def test_bins_of_a_known_relation(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 10 == 9, None).otherwise(F.col("id") % 100).alias("a.b"),
                                    ((F.col("id") % 100) >= 50).cast("int").alias("y"), F.lit(3.0).alias("flat"), F.lit(1).alias("one"))
    rows = screens.binned_information(df, ["a.b", "flat"], "y", max_bins=4).collect()
    mine = sorted((r for r in rows if r["column"] == "a.b"), key=lambda r: r["bin"])
    assert mine[0]["bin"] == 0 and mine[0]["n"] == 1000 and len(mine) <= 5 and sum(r["n"] for r in mine) == 10_000
    assert [r["woe"] for r in mine[1:]] == sorted(r["woe"] for r in mine[1:]) and mine[1]["lower"] is None and mine[-1]["upper"] is None
    assert all(x["upper"] == y["lower"] for x, y in zip(mine[1:], mine[2:])) and mine[0]["information_value"] > 1
    flat = [r for r in rows if r["column"] == "flat"]
    assert len(flat) == 1 and abs(flat[0]["information_value"]) < 1e-6
    assert not screens.binned_information(df, ["a.b"], "one").collect()


def test_coin_chances():
    assert screens._at_least(0, 7) == 1 and screens._at_least(7, 7) == 1 / 128
    assert screens._at_least(9, 10) == pytest.approx(11 / 1024)


def test_boruta_confirms_signal_and_rejects_noise(spark, monkeypatch):
    cols, seen = ["signal", "noise", "coin"], []

    class Forest:
        def __init__(self, *args, seed):
            self.seed = seed

        def fit(self, frame):
            seen.append(frame.columns)
            live = [c for c in frame.columns if c in cols]
            mine = {"signal": 9.0, "noise": 0.0, "coin": 9.0 * (self.seed % 2)}
            return [mine[c] for c in live] + [1.0] * len(live)

    monkeypatch.setattr(screens, "random_forest", Forest)
    monkeypatch.setattr(screens, "_weights", lambda values: values)
    monkeypatch.setattr(screens, "assembled", lambda df, names, y: df.select(*names))
    df = spark.range(20).select("id", *[F.col("id").alias(c) for c in cols], F.lit(1).alias("y"))
    history = screens.boruta_rounds(df, cols, "y", "id", rounds=12).collect()
    last = {r["feature"]: (r["state"], r["hits"], r["played"]) for r in history if r["round"] == 12}
    sure = math.ceil(math.log2(3 / 0.05))  # rounds until one side of a fair coin is out of the question
    assert last == {"signal": ("confirmed", sure, sure), "noise": ("rejected", 0, sure), "coin": ("tentative", 6, 12)}
    assert "noise" in seen[sure - 1] and "noise" not in seen[sure] and "shadow_noise" not in seen[sure] and "signal" in seen[-1]
    assert {r["feature"]: r["confirmed"] for r in screens.boruta(df, cols, "y", "id").collect()} == {"signal": True, "noise": False, "coin": False}


def test_one_hot_names_never_collide(spark):
    df = spark.createDataFrame([("1_x", "x", "p"), ("y", "y", "q")], "a string, a_1 string, a_y string")
    out = categorical.one_hot(df, ["a", "a_1"], drop_first=False)
    assert out.columns == ["a_y", "a_1_x", "a_y__2", "a_1_x__2", "a_1_y"]
    assert sorted(map(tuple, out.collect())) == [("p", 1.0, 0.0, 1.0, 0.0), ("q", 0.0, 1.0, 0.0, 1.0)]


def test_vector_form_of_the_encode_driver(spark):
    df = spark.range(12_000).select(F.col("id"), F.concat(F.lit("v"), F.col("id") % 6000).alias("k"), F.when(F.col("id") % 2 == 0, "NO").otherwise("<30").alias("readmitted"))
    out = categorical.encode_categoricals(df, "readmitted", hot="vector")
    assert out.columns == ["id", "k_vec", "readmitted"] and out.first()["k_vec"].size == 5999
    with pytest.raises(ValueError):
        categorical.encode_categoricals(df, "readmitted", hot=True)


def test_home_order_is_ranked_once_for_all_columns(spark, monkeypatch):
    salts, rank = [], screens.hash_rank
    monkeypatch.setattr(screens, "hash_rank", lambda df, seed, salt, *a, **k: (salts.append(salt), rank(df, seed, salt, *a, **k))[1])
    monkeypatch.setattr(screens, "score_table", lambda model, df: df.selectExpr("CAST(label AS INT) AS label", "1D AS score"))
    df = spark.range(40).selectExpr("id", "id % 3 AS a", "id % 5 AS b", "id % 2 AS y")
    assert screens.permutation_importance(None, df, ["a", "b"], "y", "id").count() == 2
    assert salts.count("home") == 1 and {"move/a", "move/b"} <= set(salts)


def test_shuffled_columns_meet_by_their_slots_and_once_by_key(spark):
    df = spark.range(50).selectExpr("id", "id * 2 AS a", "id * 3 AS b", "id * 5 AS c").cache()
    out = screens.shuffled_columns(df, ["a", "b", "c"], "id", 4, "s_").cache()
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == list(range(50)) and all(r["a"] == 2 * r["id"] for r in rows)
    for c, k in (("s_a", 2), ("s_b", 3), ("s_c", 5)):
        assert sorted(r[c] for r in rows) == [k * i for i in range(50)] and any(r[c] != k * r["id"] for r in rows)
    plan = screens.shuffled_columns(df, ["a", "b", "c"], "id", 4, "s_")._jdf.queryExecution().optimizedPlan().toString()
    by_slot, by_key = (sum("Join" in line and name in line for line in plan.splitlines()) for name in ("_slot", "id#"))
    assert by_slot == 3 and by_key == 1
