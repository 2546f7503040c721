"""Small inline frames for the decided semantics, properties and skewed inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.functions import order, rand, text
from tabwright.operators import audit, categorical, knn, profile, recode, relational, sample, scale, scoring, textrows
from tabwright.operators import unitcode
from tabwright.session import scratch_path
from tabwright.sources import state, tables


def col(df, name):
    return [r[name] for r in df.collect()]


def test_na_tokens_and_missing_path(spark):
    path = scratch_path(spark, "na") + ".csv"
    rows = [(1, "?"), (2, "None"), (3, "NULL"), (4, ""), (5, "Norm")]
    tables.write_table(spark.createDataFrame(rows, "id int, a string"), path)
    got = tables.read_table(spark, ["/nowhere/x.csv", path], "id int, a string").orderBy("id")
    assert col(got, "a") == [None, None, None, None, "Norm"]
    with pytest.raises(FileNotFoundError, match="nowhere"):
        tables.read_table(spark, ["/nowhere/x.csv"])


def test_label_codes_sort_as_text_or_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (10,), (None,)], "c int")
    as_text = {r["c"]: r["n"] for r in categorical.label_encode(df.withColumn("n", F.col("c")), ["n"]).collect()}
    assert as_text == {1: 0, 10: 1, 2: 2, None: 3}
    native = categorical.label_encode(df.withColumn("n", F.col("c")), ["n"], order="native")
    assert {r["c"]: r["n"] for r in native.collect()} == {1: 0, 2: 1, 10: 2, None: None}


def test_scalers_use_population_and_zero_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (4.0, 5.0)], "a double, b double")
    assert scale.fit_standard(df, ["a"])["a"][1] == pytest.approx(1.299038, abs=1e-6)
    assert set(col(scale.standardize(df, ["b"]), "b")) == {0.0}
    assert set(col(scale.normalize(df, ["b"]), "b")) == {0.0}


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert profile.smallest_modes(df, ["c"], "string") == {"c": "a"}


def test_diagnosis_groups(spark):
    want = {"250": "Diabetes", "2505": "Diabetes", "459": "Circulatory", "459.81": "Other", "785": "Circulatory",
            "V27": "Other", "E909": "Other", "1d": "Other", None: "Other"}
    df = spark.createDataFrame([(k,) for k in want], "c string")
    got = {r["c"]: r["g"] for r in df.withColumn("g", recode.icd9_group(F.col("c"))).collect()}
    assert got == want
    pre = spark.createDataFrame([("250.8",), ("8",), ("V27",)], "c string")
    assert col(pre.withColumn("p", recode.icd9_prefix(F.col("c"))), "p") == ["25", "00", "V2"]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.3,)], "x double")
    got = scale.denormalize(df, {"x": (0.0, 5.0)})
    assert col(got, "x") == [0, 0, 1, 2]


def test_decode_top_bound_is_clamped(spark):
    df = spark.createDataFrame([(1.0,), (0.2,), (0.0,)], "x double")
    uppers = [(0.5, "a"), (0.9999999999999999, "b")]
    assert col(df.withColumn("d", relational.decode_case("x", uppers)), "d") == ["b", "a", "a"]
    limits = spark.createDataFrame([(0.0, 0.5, "a"), (0.5, 0.9999999999999999, "b")],
                                   "lower double, upper double, category string")
    got = {r["x"]: r["d"] for r in relational.decode_by_limits(df, limits, "x", "d").collect()}
    assert got == {1.0: "b", 0.2: "a", 0.0: "a"}


def test_best_row_breaks_ties_and_puts_null_last(spark):
    df = spark.createDataFrame([(1, 7, 3.0), (1, 5, 3.0), (1, 2, None), (2, 9, None)], "k int, id int, stay double")
    got = {r["k"]: r["id"] for r in relational.keep_best(df, "k", "stay", "id").collect()}
    assert got == {1: 5, 2: 9}


def test_float_text(spark):
    cases = {0.5: "0.5", 37677024.0: "37677024", 1e8: "100000000", 0.1: "0.1", None: "NA", 1 / 3: "0.333333333333333",
             5e-05: "5e-05", 8235.193333333335: "%.15g" % 8235.193333333335, 1.5e15: "%.15g" % 1.5e15, -2.25: "-2.25"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    got = {r["x"]: r["t"] for r in df.withColumn("t", text.value_text(F.col("x"), "double")).collect()}
    assert got == cases


def test_float_text_agrees_with_c_formatting_on_ties(spark):
    rng = np.random.default_rng(0)
    values = [float(f"{x:.16g}"[:17] + "5") for x in rng.uniform(1, 1e6, 4000)] + rng.uniform(0.001, 1e9, 2000).tolist()
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.withColumn("t", text.value_text(F.col("x"), "double")).collect():
        assert r["t"] == "%.15g" % r["x"]


def test_privacy_bound_hand_values(spark):
    gaps = [0, 2, 4, 6, 8, 10]
    df = spark.createDataFrame([(g,) for g in gaps], "gap int")
    got = col(df.withColumn("a", audit.moment_terms(F.col("gap"), 1.0, 1)[0]), "a")
    assert got == pytest.approx([4, 4, 0.329, 0.062, 0.011, 0.002], abs=6e-4)


def test_epsilon_grows_with_queries(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 6).alias("n0"),
                                (10 - F.col("id") % 6).alias("n1"))
    a = audit.privacy_epsilon(df.where("row_id < 10"), 1.0, 1e-5).first()["epsilon"]
    b = audit.privacy_epsilon(df, 1.0, 1e-5).first()["epsilon"]
    assert b > a
    spent = audit.within_budget(df, "row_id", 1.0, 1e-5, a)
    assert 0 < spent.count() < 40


def test_probit_is_accurate(spark):
    from statistics import NormalDist
    ps = [1e-6, 0.01, 0.024, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.withColumn("z", rand.probit(F.col("p"))).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-7)


def test_beta_quantiles_stay_on_their_side(spark):
    low, high = unitcode.beta_quantiles(0.3, False), unitcode.beta_quantiles(0.3, True)
    assert low[0] == 0.0 and low[-1] == pytest.approx(0.3) and high[0] == pytest.approx(0.3) and high[-1] == 1.0
    assert all(a <= b for a, b in zip(low, low[1:]))


# ---------------------------------------------------------------- order helpers on large and skewed keys


def test_running_sums_over_many_keys(spark):
    n = 30_000
    df = spark.range(n).select(((F.col("id") * 7919) % n - 100).alias("k"), F.lit(1).alias("w"),
                               (F.col("id") % 3).alias("g"))
    df = df.withColumn("g", F.when(F.col("k") % 10 < 8, 0).otherwise(1))
    got = order.running_sums(df, ["k"], {"upto": "w"}, by=["g"]).toPandas().sort_values(["g", "k"])
    assert len(got) == n
    for _, part in got.groupby("g"):
        assert part["upto"].tolist() == list(range(1, len(part) + 1))


def test_key_rank_with_text_quotes_and_nulls(spark):
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") == 5, None).otherwise(
        F.concat(F.lit("a'\\\"b"), F.lpad(F.col("id").cast("string"), 6, "0"))).alias("k"))
    got = order.key_rank(df, ["k"]).toPandas()
    assert got.loc[got["k"].isna(), "rank"].tolist() == [1]
    rest = got.dropna().sort_values("k")
    assert rest["rank"].tolist() == list(range(2, n + 1))


def test_hash_rank_and_flag_with_hot_group(spark):
    df = spark.range(20_000).withColumn("y", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold"))
    ranked = order.hash_rank(df, 1, "s", "id", ["y"]).toPandas()
    for _, part in ranked.groupby("y"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    picked = order.hash_flag(df, [("hot", 777), ("cold", 3)], 1, "s", "id", ["y"]).toPandas()
    assert picked.groupby("y")["picked"].sum().to_dict() == {"hot": 777, "cold": 3}
    both = ranked.merge(picked, on=["id", "y"])
    assert ((both["rank"] <= both["y"].map({"hot": 777, "cold": 3})) == (both["picked"] == 1)).all()


def test_median_of_hot_values(spark):
    df = spark.range(30_001).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 7).alias("x"),
                                    F.lit(None).cast("double").alias("gone"))
    values = sorted(5.0 if i % 3 == 0 else i / 7 for i in range(30_001))
    assert order.exact_medians(df, ["x", "gone"]) == {"x": values[15_000], "gone": None}


# ---------------------------------------------------------------- nearest neighbours


def brute(t, s, k, exclude):
    out = {}
    for i, v in t.items():
        rows = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in s.items()
                      if not (exclude and i == j))
        out[i] = rows[:k]
    return out


@pytest.mark.parametrize("pivots,chunk", [(1, 64), (12, 16)])
@pytest.mark.parametrize("exclude", [True, False])
def test_knn_equals_brute_force_with_copies(spark, pivots, chunk, exclude):
    rng = np.random.default_rng(3)
    points = {i: [float(x) for x in rng.integers(0, 40, 3)] for i in range(300)}
    for i in range(0, 300, 3):  # a third of the rows are copies of one point
        points[i] = [7.0, 7.0, 7.0]
    df = spark.createDataFrame(list(points.items()), "id long, vec array<double>")
    got = {}
    for r in knn.knn(df, df, 3, exclude, pivots=pivots, chunk=chunk).collect():
        got.setdefault(r["t_id"], []).append((r["rank"], r["dist"], r["s_id"]))
    want = brute(points, points, 3, exclude)
    for i, rows in want.items():
        assert [(d, j) for _, d, j in sorted(got[i])] == [(pytest.approx(d), j) for d, j in rows]


def test_knn_far_clusters_and_other_table(spark):
    rng = np.random.default_rng(4)
    s = {i: [float(x) for x in rng.normal((i % 5) * 100, 1, 2)] for i in range(400)}
    t = {1000 + i: [float(x) for x in rng.normal((i % 7) * 60, 20, 2)] for i in range(150)}
    sdf, tdf = (spark.createDataFrame(list(x.items()), "id long, vec array<double>") for x in (s, t))
    got = {r["t_id"]: (r["dist"], r["s_id"]) for r in knn.knn(tdf, sdf, 1, pivots=16, chunk=32).collect()}
    for i, rows in brute(t, s, 1, False).items():
        assert got[i] == (pytest.approx(rows[0][0]), rows[0][1])


def test_copies_are_neighbours_at_zero(spark):
    rows = [("tr", 1, [1.0, 1.0]), ("tr", 2, [1.0, 1.0]), ("tr", 3, [4.0, 5.0]), ("te", 4, [1.0, 1.0]), ("te", 5, [9.0, 9.0])]
    nn = audit.nn_table(spark.createDataFrame(rows, "dataset string, id long, vec array<double>"))
    got = {(r["row_id"], r["s"]): r["dist"] for r in nn.collect()}
    assert got[(1, "tr")] == 0.0 and got[(4, "tr")] == 0.0 and got[(3, "tr")] == 5.0
    assert audit.nn_divergence(nn).first()["n_not_finite"] > 0


# ---------------------------------------------------------------- properties


def test_distance_of_a_table_to_itself_is_zero(spark):
    df = spark.range(500).select((F.col("id") % 17 / 3).alias("a"))
    assert audit.wasserstein_1(df, df, ["a"]).first()["wasserstein"] == pytest.approx(0)
    assert audit.wasserstein_1(df, df.select((F.col("a") + 2).alias("a")), ["a"]).first()["wasserstein"] == pytest.approx(2)


def test_auc_ignores_monotone_maps_and_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "label int, score double")
    assert scoring.roc_auc(df).first()["auc"] == 0.875
    assert scoring.roc_auc(df.withColumn("score", F.exp("score"))).first()["auc"] == 0.875


def test_wide_moments_equal_expression_moments(spark):
    df = spark.range(400).select(*[((F.col("id") * (i + 3)) % (11 + i)).cast("double").alias(f"c{i}") for i in range(14)])
    cols = df.columns
    n1, m1, c1 = audit.moments(df, cols[:6])
    n2, m2, c2 = audit.moments(df, cols)
    assert n1 == n2 and np.allclose(m1, m2[:6]) and np.allclose(c1, c2[:6, :6])


def test_split_quotas(spark):
    df = spark.range(101).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    got = sample.stratified_split(df, "y", 0.3, 1, "id").groupBy("y").agg(F.sum("is_test").alias("n")).collect()
    assert sum(r["n"] for r in got) == math.ceil(101 * 0.3)
    parts = sample.shards(df, 4, 1, "id").groupBy("shard").count().collect()
    assert [r["count"] for r in parts] == [25] * 4


def test_encoder_files_round_trip(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 2, i / 4) for i in range(40)], "id long, s string, b long, x double")
    enc = unitcode.fit_unit_encoder(df, "id")
    prefix = scratch_path(spark, "enc")
    state.save_encoder(enc, prefix)
    loaded = state.load_encoder(spark, prefix, enc.dtypes, enc.kinds)
    back = unitcode.unit_decode(unitcode.unit_encode(df, enc, 1, "id"), loaded).withColumn("x", F.round("x", 9))
    assert all(r["n_different"] == 0 for r in profile.table_roundtrip(df, back, "id").collect())


def test_unseen_levels(spark):
    df = spark.createDataFrame([(i, "aab"[i % 3], i % 5 + 10) for i in range(60)], "id long, s string, o long")
    enc = unitcode.fit_unit_encoder(df, "id")
    new = spark.createDataFrame([(1, "zzz", 99), (2, None, 1)], "id long, s string, o long")
    back = unitcode.unit_decode(unitcode.unit_encode(new, enc, 1, "id"), enc).orderBy("id").collect()
    assert [(r["s"], r["o"]) for r in back] == [("a", 14), ("a", 10)]


def test_parse_first_key_wins(spark):
    rows = [(1, "x Class_1 | a=1 | a=2 | b = q "), (2, "nothing"), (3, ""), (4, "Class_0=3")]
    got = {r["id"]: r["pairs"] for r in textrows.text_to_map(
        spark.createDataFrame(rows, "id int, t string"), "t").collect()}
    assert got == {1: {"a": "1", "b": "q"}, 2: None, 3: None, 4: None}


def test_long_categories_join_instead_of_inlining(spark, monkeypatch):
    df = spark.createDataFrame([(0, f"c{i % 7}", float(i)) for i in range(70)], "y int, k string, x double")
    contract = profile.profile_contract(df, "y")
    new = spark.createDataFrame([("c3", 5.0), ("zz", -1.0), (None, 500.0)], "k string, x double")
    want = textrows.cast_to_contract(new, contract).collect()
    monkeypatch.setattr(textrows, "INLINE_CATEGORIES", 2)
    got = textrows.cast_to_contract(new, contract).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_recodes_apply_to_a_stream(spark):
    path = scratch_path(spark, "stream")
    spark.range(50).select("id", F.lit("No").alias("insulin")).write.parquet(path)
    live = spark.readStream.schema("id long, insulin string").parquet(path)
    out = recode.binary_flags(live).writeStream.format("memory").queryName("flags").option(
        "checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("flags").agg(F.sum("insulin")).first()[0] == 0 and spark.table("flags").count() == 50


# ---------------------------------------------------------------- plans


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_expression_operators_stay_in_the_jvm(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for out in (recode.binarize, ):
        assert "Python" not in plan(df.select(out(F.col("o_totalprice"))))
    assert "Python" not in plan(sample.stratified_split(df, "o_orderstatus", 0.2, 1, "o_orderkey"))
    assert "Python" not in plan(order.hash_rank(df, 1, "s", "o_orderkey", ["o_orderstatus"]))
    split = plan(sample.bernoulli_split(df.select("o_orderkey"), 0.5, 1, "o_orderkey"))
    assert "Exchange" not in split and "ReadSchema: struct<o_orderkey:bigint>" in split


def test_no_cross_joins_and_partial_limits(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, vec array<double>")
    got = plan(knn.knn(v, v, 1, exclude_self=True))
    assert "CartesianProduct" not in got and "NestedLoop" not in got


def test_regression_imputation_uses_text_levels(spark):
    rows = [(i, "abc"[i % 3], float(i % 7), None if i % 10 == 0 else {"a": 1.0, "b": 5.0, "c": 9.0}["abc"[i % 3]] + 2 * (i % 7))
            for i in range(210)]
    df = spark.createDataFrame(rows, "id long, k string, x double, y double")
    got = scale.impute_regress(df, "y", "id").where(F.col("id") % 10 == 0)
    for r in got.collect():
        assert r["y"] == pytest.approx({"a": 1.0, "b": 5.0, "c": 9.0}[r["k"]] + 2 * r["x"], abs=1e-3)
