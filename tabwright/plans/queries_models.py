"""Queries: model fits, selection, train-on-synthetic comparison, feature screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import generate as G
from tabwright.operators import models as M
from tabwright.operators import scoring as E
from tabwright.operators import screens as D
from tabwright.operators.sample import stratified_split
from tabwright.operators.scale import normalize
from tabwright.plans import readmission as plans
from tabwright.plans.registry import Tables, encounters, query, r, rounded
from tabwright.session import materialize

FEATURES = ["price", "customer", "day", "priority"]
_Y = "CASE WHEN o_totalprice + 300 * (o_custkey % 500) > 330000 THEN 1 ELSE 0 END"


def order_features(t: Tables):
    """Numeric order features in [0, 1] with a binary status label."""
    df = t("orders", "o_orderkey AS id", "o_totalprice AS price", "CAST(o_custkey AS DOUBLE) AS customer",
           "CAST(unix_date(CAST(o_orderdate AS DATE)) AS DOUBLE) AS day",
           "CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS priority", f"{_Y} AS y")
    return normalize(df, FEATURES)


def halves(t: Tables):
    tagged = materialize(stratified_split(order_features(t), "y", 0.3, 42, "id"))
    return (tagged.where(F.col("is_test") == i).drop("is_test") for i in (0, 1))


# rows and positives of the test part, by largest remainder; fits cannot be repeated in SQL, so a bar stands for their quality
TEST_SQL = f"""
    WITH c AS (SELECT {_Y} AS y, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total, ceil(sum(n) * 0.3) AS want FROM c),
         e AS (SELECT y, floor(n * want / total) AS base, n * want / total - floor(n * want / total) AS rest, want FROM c, t),
         q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= want - sum(base) OVER () THEN 1 ELSE 0 END AS k, want FROM e)
    SELECT CAST(max(want) AS BIGINT) AS n_test, CAST(sum(CASE WHEN y = 1 THEN k ELSE 0 END) AS BIGINT) AS n_positive, TRUE AS above_bar FROM q"""


def fitted(t: Tables, make, bar: float):
    """Test rows, positives among them, and whether the fitted model's area on them reaches ``bar``."""
    train, test = (materialize(M.assembled(x, FEATURES, "y")) for x in halves(t))
    scored = M.score_table(make(train).fit(train), test)
    counts = scored.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.col("label") == 1).alias("n_positive"))
    return counts.withColumn("above_bar", F.lit(E.roc_auc(scored).scalar() >= bar))


@query("logistic_fit_m01", TEST_SQL)
def logistic_fit(t: Tables):
    return fitted(t, lambda train: M.logistic(train.count()), 0.8)


@query("tree_fit_m02", TEST_SQL)
def tree_fit(t: Tables):
    return fitted(t, lambda train: M.decision_tree(max_depth=8), 0.8)


@query("forest_fit_m03", TEST_SQL)
def forest_fit(t: Tables):
    return fitted(t, lambda train: M.random_forest(trees=100, max_depth=20, min_split=7), 0.85)


@query("boosted_fit_m04", TEST_SQL)
def boosted_fit(t: Tables):
    return fitted(t, lambda train: M.boosted_trees(), 0.85)


@query("network_fit_m05", TEST_SQL)
def network_fit(t: Tables):
    return fitted(t, lambda train: M.feed_forward(len(FEATURES), hidden=(64, 32, 32, 32, 8), max_iter=100), 0.9)


_MODELS = (*M.ZOO, "multinb", "xgb")
_WEAK = "bernoulli_bayes"  # sees only whether a feature is above zero, which nearly all are here


@query("model_comparison_m06", " UNION ALL ".join(f"SELECT '{m}' AS model, TRUE AS above_bar" for m in _MODELS))
def model_comparison(t: Tables):
    train, test = (materialize(M.assembled(x, FEATURES, "y")) for x in halves(t))
    rows = [(name, M.train_eval(name, train, test, len(FEATURES), scale=0.5)[0] >= (0.45 if name == _WEAK else 0.8)) for name in _MODELS]
    return t.spark.createDataFrame(rows, "model string, above_bar boolean")


@query("recursive_elimination_m07", "SELECT i AS n_features, TRUE AS in_range, TRUE AS one_chosen FROM range(1, 5) r(i)")
def recursive_elimination(t: Tables):
    _, table = M.rfecv("Logistic", order_features(t), FEATURES, "y", "id", step=1, cv=5)
    one = table.where("chosen").count() == 1
    return table.select(F.col("n_features").cast("bigint").alias("n_features"), F.col("mean_recall").between(0, 1).alias("in_range"),
                        F.lit(one).alias("one_chosen"))


@query("importance_table_m08_d07", """
    SELECT * FROM (VALUES ('price', TRUE), ('customer', TRUE), ('day', FALSE), ('priority', FALSE)) v(feature, matters)""")
def importance(t: Tables):
    train = M.assembled(order_features(t), FEATURES, "y")
    table = M.importance_table(M.random_forest(100, 20).fit(train), FEATURES, t.spark)
    return table.select("feature", (F.col("rank") <= 2).alias("matters"))


def synthetic_orders(train, n: int):
    made = G.gen_gaussian(train, n, [*FEATURES, "y"]).drop("replica")
    label = F.when(F.col("y") > 0.5, 1).otherwise(0)
    return made.select(F.col("row_id").alias("id"), *[F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)).alias(c)
                                                      for c in FEATURES], label.alias("y"))


@query("train_on_synthetic_m09", " UNION ALL ".join(f"SELECT '{m}' AS model, TRUE AS real_above_bar, TRUE AS synthetic_in_range" for m in (*M.ZOO, "mean")))
def train_on_synthetic(t: Tables):
    train, test = halves(t)
    fake = synthetic_orders(train, train.count())
    table = M.utility_table(*[materialize(M.assembled(x, FEATURES, "y")) for x in (train, fake, test)], len(FEATURES))
    return table.select("model", (F.col("auc_original") >= 0.45).alias("real_above_bar"), F.col("auc_synthetic").between(0, 1).alias("synthetic_in_range"))


@query("best_candidate_m10", "SELECT * FROM (VALUES ('gaussian', TRUE), ('kernel', TRUE)) v(candidate, above_bar)")
def best_candidate(t: Tables):
    train, _ = halves(t)
    n = train.count()
    cands = {"gaussian": synthetic_orders(train, n),
             "kernel": G.gen_parzen(train, n, 0.05, [*FEATURES, "y"], "id").withColumn("y", (F.col("y") > 0.5).cast("int"))}
    ready = {name: M.assembled(c, FEATURES, "y") for name, c in cands.items()}
    table = M.best_candidate(ready, M.assembled(train, FEATURES, "y"))[1]
    return table.select("candidate", (F.col("auc") >= 0.6).alias("above_bar"))


@query("experiment_m11")
def experiment(t: Tables):
    df = plans.engineer_v2(encounters(t))
    return plans.run_experiment(df, plans.Experiment(model="Logistic", params={"max_iter": 1000}))


# ---------------------------------------------------------------- screens

_COLS = ("l_quantity", "l_extendedprice", "l_discount")
_ANOVA = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", {r('(sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 4)} AS f_value FROM (
        SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)"""
    for c in _COLS)


@query("anova_f_d01", _ANOVA)
def anova_f(t: Tables):
    return rounded(D.anova_f(t("lineitem", "l_returnflag", *_COLS), list(_COLS), "l_returnflag"), 4)


_IV = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", value, {r('woe')} AS woe, {r('sum((pe - po) * woe) OVER ()')} AS information_value FROM (
        SELECT value, pe, po, ln(pe / po) AS woe FROM (
            SELECT CAST({e} AS VARCHAR) AS value, (sum(y) + 0.5::DOUBLE) / sum(sum(y)) OVER () AS pe, (sum(1 - y) + 0.5::DOUBLE) / sum(sum(1 - y)) OVER () AS po
            FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) GROUP BY 1))"""
    for c, e in (("l_linestatus", "l_linestatus"), ("l_linenumber", "l_linenumber")))


@query("information_value_d02", _IV)
def information_value(t: Tables):
    df = t("lineitem", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "l_linestatus", "l_linenumber")
    return rounded(D.information_value(df, ["l_linestatus", "l_linenumber"], "y"))


_EVENTS = "SELECT CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS x, CASE WHEN l_quantity * 3 + l_partkey % 97 > 130 THEN 1 ELSE 0 END AS y FROM lineitem"


@query("binned_information_d02", f"""
    WITH t AS ({_EVENTS}), e AS (SELECT DISTINCT unnest(quantile_disc(x, [{', '.join(f'{i}/12.0' for i in range(1, 12))}])) AS edge FROM t WHERE x IS NOT NULL),
    f AS (SELECT (SELECT count(*) FROM e WHERE edge < x) AS b, count(*) AS n, sum(y) AS ev FROM t WHERE x IS NOT NULL GROUP BY 1),
    c AS (SELECT row_number() OVER (ORDER BY b) AS i, b, n, ev FROM f),
    d AS (SELECT CASE WHEN sum(n) * sum(i * ev) - sum(ev) * sum(i * n) >= 0 THEN 1 ELSE -1 END AS s FROM c),
    j AS (SELECT x.i AS a, z.i AS z, d.s * sum(m.ev) / CAST(sum(m.n) AS DOUBLE) AS rate FROM c x, c z, c m, d WHERE x.i <= z.i AND m.i BETWEEN x.i AND z.i GROUP BY x.i, z.i, d.s),
    lo AS (SELECT c.i, j.a, min(rate) AS rate FROM c JOIN j ON j.a <= c.i AND j.z >= c.i GROUP BY c.i, j.a),
    iso AS (SELECT i, max(rate) AS rate FROM lo GROUP BY i),
    g AS (SELECT rate, min(b) AS b0, max(b) AS b1, sum(n) AS n, sum(ev) AS ev FROM iso JOIN c USING (i) GROUP BY rate),
    k AS (SELECT CAST(row_number() OVER (ORDER BY b0) AS INT) AS bin, CASE WHEN b0 > (SELECT min(b) FROM c) THEN (SELECT list(edge ORDER BY edge) FROM e)[b0] END AS lower,
                 CASE WHEN b1 < (SELECT max(b) FROM c) THEN (SELECT list(edge ORDER BY edge) FROM e)[b1 + 1] END AS upper, n, ev FROM g
          UNION ALL SELECT 0, NULL, NULL, count(*), sum(y) FROM t WHERE x IS NULL),
    w AS (SELECT *, (ev + 0.5::DOUBLE) / sum(ev) OVER () AS pe, (n - ev + 0.5::DOUBLE) / sum(n - ev) OVER () AS po FROM k)
    SELECT 'x' AS "column", bin, lower, upper, CAST(n AS BIGINT) AS n, CAST(ev AS BIGINT) AS events, {r('ln(pe / po)')} AS woe, {r('sum((pe - po) * ln(pe / po)) OVER ()')} AS information_value FROM w""")
def binned_information(t: Tables):
    df = t("lineitem", "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS x",
           "CASE WHEN l_quantity * 3 + l_partkey % 97 > 130 THEN 1 ELSE 0 END AS y")
    out = D.binned_information(df, ["x"], "y", max_bins=12, fine_bins=12, accuracy=10_000_000)
    return rounded(out, 6, ["woe", "information_value"])


@query("correlation_screen_d03", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})')} AS correlation, abs(corr({a}, {b})) > 0.5 AS flagged FROM lineitem"
    for i, a in enumerate(_COLS) for b in _COLS[i + 1:]))
def correlation_screen(t: Tables):
    return rounded(D.correlation_screen(t("lineitem", *_COLS), list(_COLS), 0.5))


_SIGNAL = "SELECT * FROM (VALUES ('price', TRUE), ('customer', TRUE), ('day', FALSE), ('priority', FALSE)) v(feature, {})"


@query("boruta_d05", _SIGNAL.format("confirmed"))
def boruta(t: Tables):
    return D.boruta(order_features(t), FEATURES, "y", "id").select("feature", "confirmed")


@query("permutation_importance_d06", _SIGNAL.format("matters"))
def permutation_importance(t: Tables):
    df = order_features(t)
    model = M.random_forest(100, 10).fit(M.assembled(df, FEATURES, "y"))
    return D.permutation_importance(model, df, FEATURES, "y", "id").select("feature", (F.col("auc_drop") > 0.005).alias("matters"))
