"""Queries: score metrics, fidelity and privacy audits, generators, row text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.rand import hash_uniform
from tabwright.operators import audit as A
from tabwright.operators import generate as G
from tabwright.operators import profile as P
from tabwright.operators import scoring as E
from tabwright.operators import textrows as X
from tabwright.operators.recode import binarize
from tabwright.plans.queries_features import _draw_sql
from tabwright.plans.registry import SCORED, SCORES, Tables, query, r, rounded, u, z
from tabwright.session import materialize, stored


def scored(t: Tables):
    return t("lineitem", *SCORED)


def predicted(t: Tables, threshold: float = 0.5):
    return scored(t).withColumn("pred", binarize(F.col("score"), threshold))


_CELLS = """count(*) FILTER (WHERE label = 1 AND score >= {h}) AS tp, count(*) FILTER (WHERE label = 0 AND score >= {h}) AS fp,
    count(*) FILTER (WHERE label = 1 AND score < {h}) AS fn, count(*) FILTER (WHERE label = 0 AND score < {h}) AS tn"""

# ---------------------------------------------------------------- score metrics


@query("split_recall_e01", f"""
    SELECT split, {r('tp / (tp + fn)')} AS value FROM (SELECT split, {_CELLS.format(h='0.5::DOUBLE')} FROM {SCORES} GROUP BY split)""")
def split_recall(t: Tables):
    return rounded(E.split_metric(predicted(t), "recall"))


@query("split_accuracy_e01", f"""
    SELECT split, {r('(tp + tn) / (tp + tn + fp + fn)')} AS value FROM (SELECT split, {_CELLS.format(h='0.5::DOUBLE')} FROM {SCORES} GROUP BY split)""")
def split_accuracy(t: Tables):
    return rounded(E.split_metric(predicted(t), "accuracy"))


_CURVE = f"""(SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM {SCORES} GROUP BY 1))"""
_AUC = f"(SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) / max(p * n) FROM {_CURVE})"


@query("metric_row_e02", f"""
    SELECT {r('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {r('tp / (tp + fp)')} AS precision, {r('tp / (tp + fn)')} AS recall,
           {r('2 * tp / (2 * tp + fp + fn)')} AS f1, {r(_AUC)} AS roc_auc FROM (SELECT {_CELLS.format(h='0.3::DOUBLE')} FROM {SCORES})""")
def metric_row(t: Tables):
    return rounded(E.metric_row(scored(t), 0.3))


@query("confusion_matrix_e03", f"""
    SELECT y AS label, p AS pred, count(label) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(y, p)
    LEFT JOIN {SCORES} s ON s.label = y AND CASE WHEN s.score >= 0.5 THEN 1 ELSE 0 END = p GROUP BY 1, 2""")
def confusion_matrix(t: Tables):
    return E.confusion_matrix(predicted(t))


@query("classification_report_e04", f"""
    WITH c AS (SELECT {_CELLS.format(h='0.5::DOUBLE')} FROM {SCORES}),
         k AS (SELECT '1' AS class, tp / (tp + fp) AS p, tp / (tp + fn) AS rc, 2 * tp / (2 * tp + fp + fn) AS f, tp + fn AS s FROM c
               UNION ALL SELECT '0', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fp + fn), tn + fp FROM c)
    SELECT class, {r('p')} AS precision, {r('rc')} AS recall, {r('f')} AS f1, CAST(s AS BIGINT) AS support FROM k
    UNION ALL SELECT 'macro avg', {r('avg(p)')}, {r('avg(rc)')}, {r('avg(f)')}, CAST(sum(s) AS BIGINT) FROM k
    UNION ALL SELECT 'weighted avg', {r('sum(p * s) / sum(s)')}, {r('sum(rc * s) / sum(s)')}, {r('sum(f * s) / sum(s)')}, CAST(sum(s) AS BIGINT) FROM k""")
def classification_report(t: Tables):
    return rounded(E.classification_report(predicted(t)))


@query("roc_auc_e05", f"SELECT {r(_AUC)} AS auc")
def roc_auc(t: Tables):
    return rounded(E.roc_auc(scored(t)))


_FINE = ["CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "l_extendedprice / 1000 AS score", "l_linestatus"]
_FINE_CURVE = f"""(SELECT l_linestatus, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY l_linestatus) AS p, sum(neg) OVER (PARTITION BY l_linestatus) AS n FROM
    (SELECT l_linestatus, score, sum(label) AS pos, sum(1 - label) AS neg FROM (SELECT {', '.join(_FINE)} FROM lineitem) GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY l_linestatus ORDER BY score DESC))"""


@query("roc_auc_many_scores_e05", f"""
    SELECT l_linestatus, {r('sum(neg * (tp - pos / 2.0::DOUBLE)) / max(p * n)')} AS auc FROM {_FINE_CURVE} GROUP BY 1""")
def roc_auc_many_scores(t: Tables):
    return rounded(E.roc_auc(t("lineitem", *_FINE), ["l_linestatus"]))


@query("roc_points_e06_w04", f"""
    SELECT {r('score')} AS threshold, {r('fp / n')} AS fpr, {r('tp / p')} AS tpr FROM {_CURVE}
    UNION ALL SELECT NULL, 0, 0""")
def roc_points(t: Tables):
    return rounded(E.roc_points(scored(t)))


@query("average_precision_e07", f"""
    SELECT l_linestatus, {r('sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / max(p)')} AS average_precision FROM {_FINE_CURVE} GROUP BY 1""")
def average_precision(t: Tables):
    return rounded(E.average_precision(t("lineitem", *_FINE), ["l_linestatus"]))


@query("best_threshold_e08", f"""
    SELECT {r('score')} AS threshold, position, {r('j')} AS youden_j FROM (
        SELECT score, tp / p - fp / n AS j, row_number() OVER (ORDER BY score DESC) AS position FROM {_CURVE})
    ORDER BY round(j, 12) DESC, score DESC LIMIT 1""")
def best_threshold(t: Tables):
    return rounded(E.best_threshold(scored(t)))


@query("separability_e09", f"""
    WITH s AS (SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_quantity / 50 AS score FROM lineitem),
         g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1),
         c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)
    SELECT (SELECT {r('avg(CASE WHEN y = 1 THEN CAST(score > 0.5 AS INT) ELSE CAST(score < 0.5 AS INT) END)')} FROM s) AS accuracy,
           {r('sum(neg * (tp - pos / 2.0::DOUBLE)) / max(p * n)')} AS auc FROM c""")
def separability(t: Tables):
    df = t("lineitem", "l_linestatus", "l_quantity / 50 AS score")
    real, fake = (df.where(F.col("l_linestatus") == s) for s in ("F", "O"))
    return rounded(E.separability(real, fake))


# ---------------------------------------------------------------- nearest-neighbour audits

_TAG = "CASE vec_id % 4 WHEN 0 THEN 'tr' WHEN 1 THEN 'te' WHEN 2 THEN 'synth_0' ELSE 'synth_1' END"
_NN = f"""(SELECT t, s, row_id, min(d) AS dist FROM (
    SELECT a.g AS t, b.g AS s, a.vec_id AS row_id, list_distance(a.e, b.e) AS d
    FROM (SELECT vec_id, {_TAG} AS g, embedding::DOUBLE[] AS e FROM embeddings) a, (SELECT vec_id, {_TAG} AS g, embedding::DOUBLE[] AS e FROM embeddings) b
    WHERE a.vec_id <> b.vec_id) GROUP BY ALL)"""


def nn(t: Tables):
    rows = t("embeddings", f"{_TAG} AS dataset", "vec_id AS id", "embedding AS vec")
    return A.nn_table(rows)


@query("nearest_distances_v01", f"SELECT t, s, row_id, {r('dist')} AS dist FROM {_NN}")
def nearest_distances(t: Tables):
    return rounded(nn(t))


_PAIR = f"(SELECT x.t, x.s, x.dist AS d_ts, y.dist AS d_tt FROM {_NN} x JOIN {_NN} y ON x.row_id = y.row_id AND y.s = y.t AND x.s <> x.t)"
_BOTH = "SELECT least(t, s) AS a, greatest(t, s) AS b, {value} FROM (SELECT t, s, {one} FROM " + _PAIR + " GROUP BY 1, 2) GROUP BY 1, 2"


@query("adversarial_accuracy_v02", _BOTH.format(
    value=r("sum(v) / 2") + " AS accuracy", one="avg(CASE WHEN d_ts > d_tt THEN 1.0 ELSE 0 END) AS v"))
def adversarial_accuracy(t: Tables):
    return rounded(A.adversarial_accuracy(materialize(nn(t))))


@query("audit_averages_v02", f"""
    SELECT CASE WHEN starts_with(a, 'synth') AND starts_with(b, 'synth') THEN 'aa' WHEN NOT starts_with(a, 'synth') AND NOT starts_with(b, 'synth') THEN 'rr'
           WHEN a = 'tr' OR b = 'tr' THEN 'ra' ELSE 'rat' END AS comparison, {r('avg(accuracy)')} AS accuracy FROM ({_BOTH.format(
    value='sum(v) / 2 AS accuracy', one='avg(CASE WHEN d_ts > d_tt THEN 1.0 ELSE 0 END) AS v')}) GROUP BY 1""")
def audit_averages(t: Tables):
    return rounded(A.audit_summary(A.adversarial_accuracy(materialize(nn(t))), "accuracy"))


@query("neighbour_discrepancy_v03", _BOTH.format(value=r("sum(v) / 2") + " AS discrepancy", one="avg(d_ts) AS v"))
def neighbour_discrepancy(t: Tables):
    return rounded(A.nn_discrepancy(materialize(nn(t))))


@query("neighbour_divergence_v04", _BOTH.format(
    value=r("sum(v) / 2") + " AS divergence, CAST(sum(k) AS BIGINT) AS n_not_finite",
    one="avg(CASE WHEN d_ts > 0 AND d_tt > 0 THEN ln(d_ts / d_tt) END) AS v, count(*) FILTER (WHERE NOT (d_ts > 0 AND d_tt > 0)) AS k"))
def neighbour_divergence(t: Tables):
    return rounded(A.nn_divergence(materialize(nn(t))))


@query("identifiability_v05", f"""
    WITH p AS (SELECT p_partkey AS k, p_size * 1.0::DOUBLE AS a, p_retailprice / 10 AS b, p_partkey % 2 = 0 AS real FROM part),
         w AS (SELECT (SELECT -sum(q * ln(q)) FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM p WHERE real GROUP BY round_even(a, 0))) AS wa,
                      (SELECT -sum(q * ln(q)) FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM p WHERE real GROUP BY round_even(b, 0))) AS wb),
         d AS (SELECT x.k, y.real, min(sqrt(((x.a - y.a) / wa) ** 2 + ((x.b - y.b) / wb) ** 2)) AS d FROM p x, p y, w WHERE x.real AND x.k <> y.k GROUP BY 1, 2)
    SELECT {r('avg(CASE WHEN fake < own - 1e-9 THEN 1.0 ELSE 0 END)')} AS identifiability, count(*) AS n_rows
    FROM (SELECT k, max(d) FILTER (WHERE real) AS own, max(d) FILTER (WHERE NOT real) AS fake FROM d GROUP BY 1)""")
def identifiability(t: Tables):
    df = t("part", "p_partkey", "CAST(p_size AS DOUBLE) AS a", "p_retailprice / 10 AS b")
    real, fake = (df.where(F.col("p_partkey") % 2 == i) for i in (0, 1))
    return rounded(A.identifiability(real, fake, ["a", "b"], "p_partkey"))


# ---------------------------------------------------------------- distributions and linear utility

_WASS = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", {r('sum(abs(ca / na - cb / nb) * gap)', 4)} AS wasserstein FROM (
        SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb, lead(v) OVER w - v AS gap FROM (
            SELECT {c} AS v, count(*) FILTER (WHERE l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)
        WINDOW w AS (ORDER BY v))""" for c in ("l_quantity", "l_discount", "l_extendedprice"))


@query("wasserstein_v06", _WASS)
def wasserstein(t: Tables):
    df = t("lineitem", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice")
    real, fake = (df.where(F.col("l_linestatus") == s) for s in ("F", "O"))
    return rounded(A.wasserstein_1(real, fake, ["l_quantity", "l_discount", "l_extendedprice"]), 4)


def _r2_sql(y: str, x: str, side: str) -> str:
    return (f"(SELECT 1 - sum(({y} - (b0 + b1 * {x})) ** 2) / (var_pop({y}) * count(*)) FROM lineitem, "
            f"(SELECT regr_intercept({y}, {x}) AS b0, regr_slope({y}, {x}) AS b1 FROM lineitem WHERE l_linestatus = 'F') m "
            f"WHERE l_linestatus = '{side}')")


@query("linear_utility_v07", f"""
    SELECT 'l_quantity' AS "column", {r(_r2_sql('l_quantity', 'l_extendedprice', 'O'))} AS r2_a, {r(_r2_sql('l_quantity', 'l_extendedprice', 'F'))} AS r2_b
    UNION ALL SELECT 'l_extendedprice', {r(_r2_sql('l_extendedprice', 'l_quantity', 'O'))}, {r(_r2_sql('l_extendedprice', 'l_quantity', 'F'))}""")
def linear_utility(t: Tables):
    df = t("lineitem", "l_linestatus", "l_quantity", "l_extendedprice")
    real, fake = (df.where(F.col("l_linestatus") == s) for s in ("F", "O"))
    return rounded(A.utility_r2(real, fake, real, ["l_quantity", "l_extendedprice"]))


@query("linear_utility_wide_v07")
def linear_utility_wide(t: Tables):
    cols = [f"e{i}" for i in range(64)]
    df = t("embeddings", "vec_id", *[f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(64)])
    train, test = (df.where(F.col("vec_id") % 2 == i) for i in (0, 1))
    return A.utility_r2(train, test, None, cols)


_SHARE = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, {r("count(*) FILTER (WHERE l_linestatus = 'F') / sum(count(*) FILTER (WHERE l_linestatus = 'F')) OVER ()")} AS share_a,
           {r("count(*) FILTER (WHERE l_linestatus = 'O') / sum(count(*) FILTER (WHERE l_linestatus = 'O')) OVER ()")} AS share_b FROM lineitem GROUP BY {c}"""
    for c in ("l_returnflag", "l_linenumber", "l_suppkey"))


@query("value_distributions_v08", _SHARE)
def value_distributions(t: Tables):
    cols = ["l_returnflag", "l_linenumber", "l_suppkey"]
    df = t("lineitem", "l_linestatus", *cols)
    real, fake = (df.where(F.col("l_linestatus") == s) for s in ("F", "O"))
    return rounded(P.value_shares(real, fake, cols))


# ---------------------------------------------------------------- votes and privacy

_VOTE_U = u(9, "vote", "concat(event_id, '-', k)")
_VOTES = f"""(SELECT event_id AS row_id, count(*) FILTER (WHERE v = 0) AS n0, count(*) FILTER (WHERE v = 1) AS n1 FROM (
    SELECT event_id, CASE WHEN {_VOTE_U} < 0.5::DOUBLE + (event_id % 5) * 0.1::DOUBLE THEN 1 ELSE 0 END AS v FROM events, range(10) g(k)) GROUP BY 1)"""


def votes(t: Tables):
    each = t("events", "event_id").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("teacher"))
    chance = hash_uniform(9, "vote", F.concat(F.col("event_id").cast("string"), F.lit("-"), F.col("teacher").cast("string")))
    bar = F.lit(0.5) + (F.col("event_id") % 5) * F.lit(0.1)
    return A.teacher_votes(each.select(F.col("event_id").alias("row_id"), "teacher", (chance < bar).cast("int").alias("vote")))


@query("teacher_votes_v09", f"SELECT row_id, n0, n1 FROM {_VOTES}")
def teacher_votes(t: Tables):
    return votes(t)


_LAP_U = f"({u(13, 'laplace', 'row_id')} - 0.5::DOUBLE)"


@query("noisy_majority_v10", f"""
    SELECT row_id, n0, n1, CAST((n1 - 2.0::DOUBLE * sign({_LAP_U}) * ln(1 - 2 * abs({_LAP_U}))) / (n0 + n1) > 0.5::DOUBLE AS INT) AS noisy_label FROM {_VOTES}""")
def noisy_majority(t: Tables):
    return A.noisy_label(votes(t), 2.0, 13)


def _eps_sql(lam: float, delta: float) -> str:
    g, big = f"({lam}::DOUBLE * abs(n0 - n1))", f"exp(2 * {lam}::DOUBLE)"
    return f"""
    SELECT l, sum(CASE WHEN q < ({big} - 1) / ({big} * {big} - 1) THEN least(safe, ln((1 - q) * pow((1 - q) / greatest(1 - q * {big}, 1e-300), l) + q * exp(2 * {lam}::DOUBLE * l)))
               ELSE safe END) AS alpha
    FROM (SELECT l, (2 + {g}) / (4 * exp({g})) AS q, 2 * {lam}::DOUBLE * {lam}::DOUBLE * l * (l + 1) AS safe FROM {_VOTES}, range(1, 21) s(l)) GROUP BY l"""


@query("privacy_moments_v11", f"SELECT CAST(l AS INT) AS moment_order, {r('alpha', 4)} AS alpha FROM ({_eps_sql(1.0, 1e-5)})")
def privacy_moments(t: Tables):
    return rounded(A.privacy_moments(votes(t), 1.0), 4)


@query("privacy_epsilon_v11", f"""
    SELECT {r('min((alpha + ln(CAST(100000 AS DOUBLE))) / l)', 4)} AS epsilon, (SELECT count(*) FROM events) AS n_queries FROM ({_eps_sql(0.5, 1e-5)})""")
def privacy_epsilon(t: Tables):
    return rounded(A.privacy_epsilon(votes(t), 0.5, 1e-5), 4)


@query("private_labels_v12")
def private_labels(t: Tables):
    df = t("orders", "o_orderkey", "o_orderstatus", "o_totalprice / 500000 AS a", "o_custkey / 1500 AS b",
           "CAST(o_orderkey % 7 AS DOUBLE) / 7 AS c")
    real, cand = df.where("o_orderstatus <> 'O'"), df.where("o_orderstatus = 'O'")
    return A.pate_ensemble(real, cand, ["a", "b", "c"], "o_orderkey", 10, 2000.0, 1e-5)


@query("equal_teachers_v12", """
    SELECT CAST(shard AS INT) AS shard, least((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'), (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R')) // 8 AS n_real,
           least((SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'), (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R')) // 8 AS n_candidate,
           TRUE AS at_optimum, TRUE AS better_than_chance, TRUE AS others_agree FROM range(8) r(shard)""")
def equal_teachers(t: Tables):
    key = "concat_ws('/', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING)) AS k"
    df = t("lineitem", key, "l_returnflag", "l_discount * 10 AS a", "l_tax * 10 AS b",
           "l_quantity / 50 + CASE WHEN l_returnflag = 'R' THEN 0.6D ELSE 0D END AS c")
    real, cand = df.where("l_returnflag = 'R'"), df.where("l_returnflag <> 'R'")
    cols, k = ["a", "b", "c"], 8
    rows = stored(A.equal_shards(real, cand, cols, "k", k))
    weights = A.fit_teachers(rows, cols, k)
    mine = F.element_at(F.array(*[F.array(*map(F.lit, w)) for w in weights.tolist()]), F.col("shard") + 1)
    x = [F.lit(1.0), *[F.col(c) for c in cols]]
    z = sum((mine[i] * v for i, v in enumerate(x)), F.lit(0.0))
    p = 1 / (1 + F.exp(-z))
    pulls = [F.abs(F.sum((p - F.col("_y")) * v) + (F.first(mine[i]) if i else 0)) for i, v in enumerate(x)]
    votes = F.lit(0)
    for w in weights.tolist():
        votes = votes + (sum((F.lit(a) * v for a, v in zip(w, x)), F.lit(0.0)) > 0).cast("int")
    agree = F.avg(((votes * 2 > k) == (F.col("_y") == 1)).cast("double"))
    right = F.avg(((z > 0) == (F.col("_y") == 1)).cast("double"))
    return rows.groupBy("shard").agg(
        F.count_if(F.col("_y") == 1).alias("n_real"), F.count_if(F.col("_y") == 0).alias("n_candidate"),
        (F.greatest(*pulls) < 1e-5 * F.count(F.lit(1))).alias("at_optimum"), (right >= 0.7).alias("better_than_chance"), (agree >= 0.7).alias("others_agree"))


# ---------------------------------------------------------------- generators

_MV = """(SELECT avg(p_size) AS ma, avg(p_retailprice) AS mb, sqrt(var_pop(p_size) + 1e-6) AS la,
    covar_pop(p_size, p_retailprice) / sqrt(var_pop(p_size) + 1e-6) AS lab, var_pop(p_retailprice) + 1e-6 AS vb FROM part)"""


@query("gaussian_rows_g01", f"""
    SELECT CAST(id // n AS INT) AS replica, id % n AS row_id, {r('ma + la * z0', 5)} AS p_size, {r('mb + lab * z0 + sqrt(vb - lab * lab) * z1', 5)} AS p_retailprice
    FROM {_MV}, (SELECT id, n, {z(42, 'z0', 'id')} AS z0, {z(42, 'z1', 'id')} AS z1 FROM
        (SELECT unnest(range(2 * (SELECT count(*) FROM part))) AS id, (SELECT count(*) FROM part) AS n))""")
def gaussian_rows(t: Tables):
    part = t("part", "p_size", "p_retailprice")
    return rounded(G.gen_gaussian(part, part.count(), ["p_size", "p_retailprice"], 42, replicas=2), 5)


@query("kernel_rows_g02", f"""
    SELECT _draw AS row_id, {r(f"p_size + 0.25::DOUBLE * {z(42, 'kernel/p_size', '_draw')}")} AS p_size,
           {r(f"p_retailprice + 0.25::DOUBLE * {z(42, 'kernel/p_retailprice', '_draw')}")} AS p_retailprice
    FROM ({_draw_sql('part', 'p_partkey', 'boot', '(SELECT count(*) FROM part)')}) JOIN part ON p_partkey = k""")
def kernel_rows(t: Tables):
    part = t("part", "p_partkey", "p_size", "p_retailprice")
    return rounded(G.gen_parzen(part, part.count(), 0.25, ["p_size", "p_retailprice"], "p_partkey", 42))


@query("kernel_sweep_g02", f"""
    WITH n AS (SELECT count(*) AS n FROM supplier)
    SELECT _draw AS row_id, CAST((_draw - 1) // (n * 7) AS INT) AS step, CAST((_draw - 1) // n % 7 + 1 AS INT) AS replica,
           {r('0.28336393686529654::DOUBLE / pow(2, (_draw - 1) // (n * 7))')} AS bandwidth,
           {r(f"s_acctbal / 1000 + 0.28336393686529654::DOUBLE / pow(2, (_draw - 1) // (n * 7)) * {z(42, 'kernel/balance', '_draw')}")} AS balance
    FROM ({_draw_sql('supplier', 's_suppkey', 'boot', '(SELECT 77 * n FROM n)')}) JOIN supplier ON s_suppkey = k, n""")
def kernel_sweep(t: Tables):
    df = t("supplier", "s_suppkey", "s_acctbal / 1000 AS balance")
    return rounded(G.parzen_sweep(df, df.count(), ["balance"], "s_suppkey", 42))


@query("additive_noise_rows_g03")
def additive_noise_rows(t: Tables):
    df = t("part", "p_partkey", "CAST(p_size AS DOUBLE) AS size", "p_retailprice / 100 AS price",
           "CAST(p_partkey % 10 AS DOUBLE) AS code")
    return G.gen_additive(df, ["size", "price", "code"], "p_partkey")


@query("correlated_table_g04")
def correlated_table(t: Tables):
    train, test = G.gen_correlated(t.spark, t("orders").count(), 5, 0.1)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def part_table(t: Tables):
    return t("part", "p_partkey", "CAST(p_size > 25 AS BIGINT) AS y", "CAST(p_size AS BIGINT) AS size",
             "p_retailprice AS price", "p_type AS kind", "CAST(p_partkey % 4 AS DOUBLE) / 2 AS step",
             "p_name AS name").drop("p_partkey")


_C = "contract/1"
_SUP = "[0.0, 0.5, 1.0, 1.5]"


@query("contract_rows_g05", f"""
    WITH k AS (SELECT list_sort(list(DISTINCT p_type)) AS kinds, list_sort(list(DISTINCT p_name)) AS names, min(p_retailprice) AS lo, max(p_retailprice) AS hi,
                      min(p_size) AS a, max(p_size) AS b, count(*) AS n FROM part)
    SELECT row_id, 1::BIGINT AS y, CAST(floor({u(42, _C + '/size', 'row_id')} * (b - a + 1)) AS BIGINT) + a AS size,
           {r(f"lo + {u(42, _C + '/price', 'row_id')} * (hi - lo)")} AS price,
           kinds[CAST(floor({u(42, _C + '/kind', 'row_id')} * len(kinds)) AS INT) + 1] AS kind,
           CAST(({_SUP})[CAST(floor({u(42, _C + '/step', 'row_id')} * 4) AS INT) + 1] AS DOUBLE) AS step,
           names[CAST(floor({u(42, _C + '/name', 'row_id')} * len(names)) AS INT) + 1] AS name
    FROM k, (SELECT unnest(range(1, (SELECT count(*) FROM part) + 1)) AS row_id)""")
def contract_rows(t: Tables):
    df = part_table(t)
    return rounded(G.gen_from_contract(P.profile_contract(df, "y"), 1, df.count(), t.spark), 6, ["price"])


# ---------------------------------------------------------------- row text

_COLS = ["y", "size", "price", "kind", "step"]
_TEXT = """concat('Class_', y, ' | y=', y, ' | size=', size, ' | price=', printf('%.15g', price), ' | kind=', kind, ' | step=', printf('%.15g', step))"""
_PART = """(SELECT p_partkey AS id, CAST(p_size > 25 AS BIGINT) AS y, p_size AS size, p_retailprice AS price, p_type AS kind, CAST(p_partkey % 4 AS DOUBLE) / 2 AS step FROM part)"""


def text_rows(t: Tables):
    df = t("part", "p_partkey AS id", "CAST(p_size > 25 AS BIGINT) AS y", "CAST(p_size AS BIGINT) AS size",
           "p_retailprice AS price", "p_type AS kind", "CAST(p_partkey % 4 AS DOUBLE) / 2 AS step")
    return X.rows_to_text(df, "y", cols=_COLS)


@query("rows_to_text_x01", f"SELECT id, {_TEXT} AS text FROM {_PART}")
def rows_to_text(t: Tables):
    return text_rows(t).select("id", "text")


# deterministic damage, the same text in both engines
_DAMAGE = """CASE WHEN id % 11 = 0 THEN '' WHEN id % 11 = 1 THEN replace(text, 'kind=', 'kind=Z') WHEN id % 11 = 2 THEN replace(text, ' | size=', ' , size = ')
    WHEN id % 11 = 3 THEN concat('noise ', text, ' | size=999 | kind=NA') WHEN id % 11 = 4 THEN replace(text, 'price=', 'price=x')
    WHEN id % 11 = 5 THEN replace(text, 'size=', 'size=7') WHEN id % 11 = 6 THEN 'Class_1 | y=1 | size=3' WHEN id % 11 = 7 THEN 'no pairs at all'
    WHEN id % 11 = 8 THEN replace(text, 'step=', 'step=0.3') WHEN id % 11 = 9 THEN concat(text, '</s>') ELSE text END"""
_BROKEN = f"(SELECT id, label, {_DAMAGE} AS text FROM (SELECT id, y AS label, {_TEXT} AS text FROM {_PART}))"
_PAIRS = f"""(SELECT id, label, k, trim(v) AS v FROM (
    SELECT id, label, k, v, row_number() OVER (PARTITION BY id, k ORDER BY i) AS rn FROM (
        SELECT id, label, unnest(regexp_extract_all(body, '([A-Za-z0-9_\\-]+)\\s*=\\s*([^|\\n\\r]+)', 1)) AS k,
               unnest(regexp_extract_all(body, '([A-Za-z0-9_\\-]+)\\s*=\\s*([^|\\n\\r]+)', 2)) AS v,
               unnest(range(1, len(regexp_extract_all(body, '([A-Za-z0-9_\\-]+)\\s*=\\s*([^|\\n\\r]+)', 1)) + 1)) AS i
        FROM (SELECT id, label, CASE WHEN instr(trim(text), 'Class_') > 0 THEN substr(trim(text), instr(trim(text), 'Class_')) ELSE trim(text) END AS body FROM {_BROKEN})))
    WHERE rn = 1 AND NOT starts_with(k, 'Class_'))"""


def parsed_rows(t: Tables):
    broken = text_rows(t).select("id", F.col("y").alias("label"), "text").withColumn("text", F.expr(_DAMAGE))
    return X.text_to_map(broken, "text")


@query("parse_text_x02", f"SELECT id, k, v FROM {_PAIRS}")
def parse_text(t: Tables):
    return parsed_rows(t).select("id", F.explode("pairs").alias("k", "v"))


_CLEAN = r"nullif(nullif(trim(regexp_replace(trim(v), '<EOR>|</s>', '', 'g')), 'NA'), '')"
_WIDE = f"""(SELECT id, label, {', '.join(f"max({_CLEAN}) FILTER (WHERE k = '{c}') AS r_{c}, max(CAST(k = '{c}' AS INT)) AS h_{c}" for c in _COLS)}
    FROM {_PAIRS} GROUP BY 1, 2)"""
_B = """(SELECT min(p_size) AS s0, max(p_size) AS s1, min(p_retailprice) AS p0, max(p_retailprice) AS p1,
    (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mk, (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS ms,
    (SELECT p_retailprice FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mp,
    (SELECT CAST(p_partkey % 4 AS DOUBLE) / 2 FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mt, list(DISTINCT p_type) AS kinds FROM part)"""
_SIZE = "CASE WHEN try_cast(r_size AS DOUBLE) IS NOT NULL THEN CAST(round_even(greatest(least(try_cast(r_size AS DOUBLE), s1), s0), 0) AS BIGINT) END"
_PRICE = "CASE WHEN try_cast(r_price AS DOUBLE) IS NOT NULL THEN greatest(least(try_cast(r_price AS DOUBLE), p1), p0) END"
_KIND = "CASE WHEN r_kind IS NULL THEN NULL WHEN list_contains(kinds, r_kind) THEN r_kind ELSE mk END"
_STEP = f"list_min(list_transform({_SUP}, lambda s: {{'d': abs(greatest(least(try_cast(r_step AS DOUBLE), 1.5), 0) - s), 's': s}})).s"
_STEP = f"CASE WHEN try_cast(r_step AS DOUBLE) IS NOT NULL THEN CAST({_STEP} AS DOUBLE) END"


def text_contract(t: Tables):
    return P.profile_contract(text_rows(t).select(*_COLS), "y")


@query("coerce_values_x03", f"SELECT id, {_SIZE} AS size, {_PRICE} AS price, {_KIND} AS kind, {_STEP} AS step FROM {_WIDE}, {_B}")
def coerce_values(t: Tables):
    rows = parsed_rows(t).where("pairs is not null")
    return X.coerce(rows, text_contract(t), fill=False).select("id", "size", "price", "kind", "step")


@query("column_defaults_x04", f"""
    SELECT 'y' AS "column", CAST((SELECT CAST(p_size > 25 AS BIGINT) FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS VARCHAR) AS value
    UNION ALL SELECT 'size', CAST(ms AS VARCHAR) FROM {_B} UNION ALL SELECT 'price', CAST(mp AS VARCHAR) FROM {_B}
    UNION ALL SELECT 'kind', mk FROM {_B} UNION ALL SELECT 'step', CAST(mt AS VARCHAR) FROM {_B}""")
def column_defaults(t: Tables):
    return X.defaults(text_contract(t), t.spark)


_ACCEPTED = f"""(SELECT id, label, coalesce({_SIZE}, ms) AS size, coalesce({_PRICE}, mp) AS price, coalesce({_KIND}, mk) AS kind, coalesce({_STEP}, mt) AS step
    FROM {_WIDE}, {_B} WHERE h_size + h_price + h_kind + h_step >= 3)"""


@query("accept_rows_x05", f"SELECT id, label AS y, size, price, kind, step FROM {_ACCEPTED}")
def accept_rows(t: Tables):
    return X.accept(parsed_rows(t), text_contract(t), "label").select("id", *_COLS)


@query("contract_cast_x06", f"""
    SELECT CAST(event_id % 2 AS BIGINT) AS y, CAST(round_even(greatest(least(value, s1), s0), 0) AS BIGINT) AS size, greatest(least(value * 20, p1), p0) AS price,
           mk AS kind, CAST(list_min(list_transform({_SUP}, lambda s: {{'d': abs(greatest(least(value / 20, 1.5), 0) - s), 's': s}})).s AS DOUBLE) AS step FROM events, {_B}""")
def contract_cast(t: Tables):
    df = t("events", "value / 20 AS step", "event_type AS kind", "value AS size", "value * 20 AS price",
           "CAST(event_id % 2 AS DOUBLE) AS y")
    return X.cast_to_contract(df, text_contract(t))


@query("ingest_stats_x07", f"""
    SELECT label AS class_label, count(*) AS requested_rows, count(*) AS total_attempts, count(*) FILTER (WHERE p IS NULL) AS parse_failures,
           count(*) FILTER (WHERE p IS NOT NULL AND h < 3) AS coercion_failures, count(*) FILTER (WHERE h >= 3) AS accepted_rows,
           count(*) - count(*) FILTER (WHERE h >= 3) AS rejected_rows, count(*) - count(*) FILTER (WHERE h >= 3) AS resampled_rows
    FROM (SELECT b.id, b.label, w.id AS p, h_size + h_price + h_kind + h_step AS h FROM {_BROKEN} b LEFT JOIN {_WIDE} w ON w.id = b.id) GROUP BY 1""")
def ingest_stats(t: Tables):
    return X.ingest_stats(parsed_rows(t), text_contract(t), "label")


@query("ingest_stats_json_x07")
def ingest_stats_json(t: Tables):
    return X.stats_json(X.ingest_stats(parsed_rows(t), text_contract(t), "label", {0: 10**3, 1: 10**3}))


_FILL = " UNION ALL ".join(f"""
    SELECT {c} AS y, size, price, kind, step FROM {_ACCEPTED} WHERE label = {c} UNION ALL
    SELECT {c}, a.size, a.price, a.kind, a.step FROM ({_draw_sql(f'(SELECT id FROM {_ACCEPTED} WHERE label = {c})', 'id', f'assemble/{c}',
                                                            f'(SELECT (SELECT count(*) FROM {_PART} WHERE y = {c}) - (SELECT count(*) FROM {_ACCEPTED} WHERE label = {c}))')}) d
    JOIN {_ACCEPTED} a ON a.id = d.k""" for c in (0, 1))


@query("class_matched_rows_g06", f"SELECT CAST(y AS BIGINT) AS y, size, {r('price')} AS price, kind, step FROM ({_FILL})")
def class_matched_rows(t: Tables):
    source = text_rows(t).select(*_COLS)
    counts = P.class_counts(source, "y").first()
    made = G.assemble(parsed_rows(t), P.profile_contract(source, "y"),
                      {0: counts["n_class_0"], 1: counts["n_class_1"]}, "label", "id")
    return rounded(made, 6, ["price"])
