"""Registered queries for cases at the edge: loaded state, nulls, rare zeros, one class, large integers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import categorical as L
from tabwright.operators import profile as P
from tabwright.operators import relational as J
from tabwright.operators import sample as M
from tabwright.operators import scale as X
from tabwright.operators import scoring as E
from tabwright.operators import unitcode as C
from tabwright.plans.queries_tables import positions
from tabwright.plans.registry import ENCOUNTERS, Tables, encounters, query, r, rounded
from tabwright.session import scratch_path
from tabwright.sources import state as S

# a table with nulls in a nominal, an ordinal, a binary and a numeric column
_HOLES = ["p_partkey", "CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS s", "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS BIGINT) END AS o",
          "CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 3 = 0 AS BIGINT) END AS b", "CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS x"]
_HOLES_SQL = f"(SELECT {', '.join(_HOLES)} FROM part)"


@query("loaded_encoder_nulls_s05_f20", f"""
    WITH h AS {_HOLES_SQL}
    SELECT p_partkey, s, coalesce(o, (SELECT o FROM h WHERE o IS NOT NULL GROUP BY o ORDER BY count(*) DESC, o LIMIT 1)) AS o,
           coalesce(b, (SELECT b FROM h WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1)) AS b,
           {r('coalesce(x, (SELECT median(x) FROM h))', 4)} AS x FROM h""")
def loaded_encoder_nulls(t: Tables):
    df, prefix = t("part", *_HOLES), scratch_path(t.spark, "encoder")
    S.save_encoder(C.fit_unit_encoder(df, "p_partkey"), prefix)
    enc = S.load_encoder(t.spark, prefix)
    return rounded(C.unit_decode(C.unit_encode(df, enc, 42, "p_partkey"), enc), 4)


@query("decode_discrete_f20", "SELECT p_partkey, CAST(p_size AS BIGINT) AS x FROM part")
def decode_discrete(t: Tables):
    df = t("part", "p_partkey", "CAST(p_size AS DOUBLE) AS x")
    enc, prefix = C.fit_unit_encoder(df, "p_partkey"), scratch_path(t.spark, "encoder")
    enc.discrete.add("x")
    S.save_encoder(enc, prefix)
    return C.unit_decode(C.unit_encode(df, enc, 42, "p_partkey"), S.load_encoder(t.spark, prefix))


_RARE_ZERO = "CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 END"


@query("minority_boost_zeros_t08", f"""
    WITH c AS (SELECT count(*) AS n, count(*) FILTER ({_RARE_ZERO} = 0) AS z FROM orders)
    SELECT CAST(0 AS BIGINT) AS z, CAST(greatest(round_even(n * 0.1, 0), z) AS BIGINT) AS n FROM c
    UNION ALL SELECT 1, n - z FROM c""")
def minority_boost_zeros(t: Tables):
    df = t("orders", "o_orderkey", f"{_RARE_ZERO} AS z")
    return M.boost(df, ["z"], 0.1, 42, "o_orderkey").groupBy(F.col("z").cast("bigint").alias("z")).agg(F.count(F.lit(1)).alias("n"))


_HALF = "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END"


@query("value_shares_nulls_v08", f"""
    WITH v AS (SELECT coalesce({_HALF}, 'nan') AS value, c_nationkey < 12 AS a FROM customer)
    SELECT 'seg' AS "column", value, {r('count(*) FILTER (a) / CAST((SELECT count(*) FROM v WHERE a) AS DOUBLE)')} AS share_a,
           {r('count(*) FILTER (NOT a) / CAST((SELECT count(*) FROM v WHERE NOT a) AS DOUBLE)')} AS share_b FROM v GROUP BY value""")
def value_shares_nulls(t: Tables):
    df = t("customer", "c_nationkey < 12 AS a", f"{_HALF} AS seg")
    return rounded(P.value_shares(df.where("a"), df.where("NOT a"), ["seg"]))


_STEPS = "CASE WHEN l_linenumber < 3 THEN 2 WHEN l_linenumber < 5 THEN 10 ELSE 30 END AS k"


@query("one_hot_numeric_f02", f"""
    SELECT l_orderkey, l_linenumber, CAST(k = 10 AS DOUBLE) AS k_10, CAST(k = 30 AS DOUBLE) AS k_30
    FROM (SELECT l_orderkey, l_linenumber, {_STEPS} FROM lineitem)""")
def one_hot_numeric(t: Tables):
    df = t("lineitem", "CAST(l_orderkey AS STRING) AS l_orderkey", "CAST(l_linenumber AS STRING) AS l_linenumber", _STEPS)
    hot = L.one_hot(df, ["k"], drop_first=True)
    return hot.withColumns({c: F.col(c).cast(k) for c, k in (("l_orderkey", "bigint"), ("l_linenumber", "int"))})


@query("ordinal_large_f24", "SELECT c_custkey, dense_rank() OVER (ORDER BY 9007199254740992 + c_custkey) - 1 AS big FROM customer")
def ordinal_large(t: Tables):
    return L.label_encode(t("customer", "c_custkey", "9007199254740992 + c_custkey AS big"), ["big"], order="native")


@query("one_class_e06_e07", "SELECT l_quantity AS threshold, CAST(0 AS DOUBLE) AS tpr, CAST(0 AS DOUBLE) AS ap FROM (SELECT DISTINCT l_quantity FROM lineitem)")
def one_class(t: Tables):
    df = t("lineitem", "0 AS label", "l_quantity AS score")
    points = E.roc_points(df).where("threshold IS NOT NULL").select("threshold", "tpr")
    return points.withColumn("ap", F.lit(E.average_precision(df).scalar()))


_PAIRS = "CAST(count(*) FILTER (y) AS DOUBLE) * count(*) FILTER (NOT y)"


@query("split_auc_e01", f"""
    WITH s AS (SELECT l_linestatus AS split, l_returnflag = 'R' AS y, l_discount AS score FROM lineitem),
    k AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY score) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS rk FROM s)
    SELECT split, {r(f"CASE WHEN {_PAIRS} = 0 THEN 0 ELSE (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / nullif({_PAIRS}, 0) END")} AS value
    FROM k GROUP BY split""")
def split_auc(t: Tables):
    df = t("lineitem", "l_linestatus AS split", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "l_discount AS score")
    return rounded(E.split_metric(df, "roc_auc"))


@query("least_missing_o03", "SELECT c AS \"column\" FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS c, count(*) FILTER ({c} IS NULL) AS n FROM {ENCOUNTERS}"
    for i, c in enumerate(("race", "weight", "gender", "time_in_hospital"))) + ") WHERE n > 0 ORDER BY n, place LIMIT 1")
def least_missing(t: Tables):
    df = encounters(t, "race", "weight", "gender", "time_in_hospital")
    return t.spark.createDataFrame([(X.least_missing(df),)], "column string")


@query("text_fingerprint_s08", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_fingerprint(t: Tables):
    return S.row_sha256(t("documents", "doc_id", "text"), "text").select("doc_id", "sha256")


@query("row_cap_sorted_s10", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders ORDER BY o_orderkey LIMIT 500")
def row_cap_sorted(t: Tables):
    return positions(J.first_n(t("orders", "o_orderkey"), 500, "o_orderkey"))


# ---------------------------------------------------------------- jobs and operators proved on exact data

_EXACT = ("CAST(p_size AS DOUBLE) AS a", "p_retailprice / 1000 AS b", "CAST(p_partkey % 13 AS DOUBLE) AS c", "CAST(p_partkey % 29 AS DOUBLE) AS d")


@query("utility_over_replicas_v07", " UNION ALL ".join(
    f"SELECT '{s}' AS dataset, '{c}' AS \"column\", CAST(1 AS DOUBLE) AS train_test, CAST(1 AS DOUBLE) AS train_synthetic, CAST(1 AS DOUBLE) AS test_synthetic"
    for s in ("s0", "s1") for c in ("a", "b", "c", "d", "e")))
def utility_over_replicas(t: Tables):
    """The last column is the sum of the others, so every column follows from the rest in every replica."""
    from tabwright.operators import audit as A
    df = t("part", "p_partkey", *_EXACT).withColumn("e", F.expr("a + b + c + d"))
    train, test = (df.where(F.col("p_partkey") % 4 == i) for i in (0, 1))
    fakes = df.where("p_partkey % 4 > 1").withColumn("dataset", F.expr("concat('s', p_partkey % 2)"))
    return rounded(A.utility_over_replicas(train, test, fakes, ["a", "b", "c", "d", "e"]))


_WIDE = [f"CAST(p_partkey % {k} AS DOUBLE) AS m{k}" for k in (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53)]


@query("linear_utility_exact_v07", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(1 AS DOUBLE) AS r2_a" for c in [w.split(" AS ")[-1] for w in _WIDE] + ["total"]))
def linear_utility_exact(t: Tables):
    """Fourteen columns, one the sum of the rest, with nulls in some rows."""
    from tabwright.operators import audit as A
    names = [w.split(" AS ")[-1] for w in _WIDE]
    df = t("part", "p_partkey", *_WIDE).withColumn("total", F.expr(" + ".join(names)))
    df = df.withColumn("m7", F.when(F.col("p_partkey") % 10 != 0, F.col("m7")))
    train, test = (df.where(F.col("p_partkey") % 2 == i) for i in (0, 1))
    return rounded(A.utility_r2(train, test, None, [*names, "total"]).select("column", "r2_a"))


@query("impute_chain_exact_f14", """
    SELECT p_partkey, CAST(p_size % 10 AS DOUBLE) AS a, CAST(2 * (p_size % 10) + 3 AS DOUBLE) AS x, concat('k', p_size % 10) AS y FROM part""")
def impute_chain_exact(t: Tables):
    """x is linear in a, and rows with the same a share y, so both are recovered exactly."""
    df = t("part", "p_partkey", "CAST(p_size % 10 AS DOUBLE) AS a", "CASE WHEN p_partkey % 5 <> 0 THEN CAST(2 * (p_size % 10) + 3 AS DOUBLE) END AS x",
           "CASE WHEN p_partkey % 3 <> 0 THEN concat('k', p_size % 10) END AS y")
    return rounded(X.impute_chain(df, "p_partkey"), 4)


@query("ingest_json_fields_x07", "SELECT o_orderstatus AS class_label, count(*) AS total_attempts FROM orders GROUP BY 1")
def ingest_json_fields(t: Tables):
    from tabwright.operators import textrows as W
    counts = t("orders", "o_orderstatus").groupBy(F.col("o_orderstatus").alias("class_label")).agg(F.count(F.lit(1)).alias("total_attempts"))
    text = W.stats_json(counts)
    return text.select("class_label", F.from_json("stats", "class_label string, total_attempts bigint")["total_attempts"].alias("total_attempts"))


@query("encode_decode_job_f19_f20", f"""
    WITH h AS {_HOLES_SQL}
    SELECT p_partkey, coalesce(s, (SELECT s FROM h WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS s,
           {r('coalesce(x, (SELECT median(x) FROM h))', 4)} AS x FROM h""")
def encode_decode_job(t: Tables):
    """The whole job twice: the first call fits and saves the encoder, the second encodes with the saved one."""
    from tabwright.plans.readmission import decode_job, encode_job
    root = scratch_path(t.spark, "job")
    t("part", *_HOLES).select("p_partkey", "s", "x").write.parquet(f"{root}/in.parquet")
    for out in ("first", "second"):
        encode_job(t.spark, f"{root}/in.parquet", f"{root}/{out}", "p_partkey", f"{root}/encoder")
    return rounded(decode_job(t.spark, f"{root}/second", f"{root}/decoded", f"{root}/encoder"), 4)


@query("ensemble_job_j09", """
    SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) AS n_test, TRUE AS accuracy_above_bar, TRUE AS recall_above_bar FROM orders""")
def ensemble_job(t: Tables):
    """A net on one-hot columns and a forest on codes vote by OR on a label both can learn."""
    from tabwright.plans.readmission import ensemble
    df = t("orders", "o_orderkey", "o_totalprice AS price", "o_orderpriority AS priority", "o_orderstatus AS status",
           "CASE WHEN o_totalprice > 250000 OR o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y")
    vote = ensemble(df, "y", "o_orderkey")
    hit = (F.col("pred") == 1) & (F.col("label") == 1)
    return vote.agg(F.count(F.lit(1)).alias("n_test"), (F.avg((F.col("pred") == F.col("label")).cast("double")) >= 0.8).alias("accuracy_above_bar"),
                    (F.count_if(hit) / F.count_if(F.col("label") == 1) >= 0.8).alias("recall_above_bar"))
