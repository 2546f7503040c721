"""Queries: profiles, windows, encoders, imputers, splits, sampling, feature jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import categorical as L
from tabwright.operators import profile as P
from tabwright.operators import sample as M
from tabwright.operators import scale as X
from tabwright.operators import unitcode as C
from tabwright.operators.relational import decode_by_limits
from tabwright.plans import readmission as plans
from tabwright.plans.queries_tables import _ICD, _LIMITS_SQL
from tabwright.plans.registry import ENCOUNTERS, Tables, encounters, query, r, rounded, u
from tabwright.session import scratch_path
from tabwright.sources.tables import write_table

# ---------------------------------------------------------------- profiles


@query("value_counts_a01", f"""
    SELECT diag_1 AS value, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share
    FROM {ENCOUNTERS} WHERE diag_1 IS NOT NULL GROUP BY 1""")
def value_counts(t: Tables):
    return rounded(P.value_counts(encounters(t, "diag_1"), "diag_1", normalize=True))


_NULLS = ["race", "weight", "time_in_hospital", "payer_code", "diag_1", "A1Cresult", "metformin", "gender"]
_NULL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n FROM {ENCOUNTERS}" for c in _NULLS)


@query("missing_report_a02_o02_o03", f"""
    SELECT "column", n_missing, {r('n_missing * 100.0 / n')} AS pct_missing FROM ({_NULL_SQL}) WHERE n_missing > 0
    ORDER BY n_missing DESC, "column" LIMIT 5""")
def missing_report(t: Tables):
    return rounded(P.missing_report(encounters(t, *_NULLS), 5))


@query("table_summary_a03", f"""
    SELECT "column", CAST(pos AS INT) AS position, dtype, n AS n_rows, n_missing FROM (
        SELECT 1 AS pos, 'encounter_id' AS "column", 'bigint' AS dtype, count(*) AS n, count(*) - count(encounter_id) AS n_missing FROM {ENCOUNTERS}
        UNION ALL SELECT 2, 'race', 'string', count(*), count(*) - count(race) FROM {ENCOUNTERS}
        UNION ALL SELECT 3, 'time_in_hospital', 'double', count(*), count(*) - count(time_in_hospital) FROM {ENCOUNTERS})""")
def table_summary(t: Tables):
    return P.summarize(encounters(t, "encounter_id", "race", "time_in_hospital"))


@query("zero_variance_a04", """
    SELECT "column" FROM (
        SELECT 'one' AS "column", count(DISTINCT 1) + max(0) AS k FROM lineitem
        UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
        UNION ALL SELECT 'half', count(DISTINCT CASE WHEN l_tax > 0.04 THEN 'x' END)
               + max(CASE WHEN l_tax > 0.04 THEN 0 ELSE 1 END) FROM lineitem
        UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem) WHERE k <= 1""")
def zero_variance(t: Tables):
    return P.zero_variance(t("lineitem", "1 AS one", "l_discount", "CASE WHEN l_tax > 0.04 THEN 'x' END AS half",
                             "l_linestatus"))


_NZV = {"l_linestatus": "l_linestatus", "l_quantity": "CAST(l_quantity AS BIGINT)",
        "l_extendedprice": "l_extendedprice", "l_suppkey": "l_suppkey",
        "rare": "CASE WHEN l_orderkey % 100 = 0 THEN 'yes' ELSE 'no' END",
        "lone": "CASE WHEN l_linenumber > 3 THEN 'only' END"}
_NZV_SQL = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) FILTER (WHERE v IS NOT NULL) AS n_unique, coalesce(max(n) FILTER (WHERE v IS NOT NULL), 0) AS top_count,
           coalesce(list_sort(list(n) FILTER (WHERE v IS NOT NULL), 'DESC')[2], 0) AS second_count, sum(n) AS n_rows
    FROM (SELECT {e} AS v, count(*) AS n FROM lineitem GROUP BY 1)""" for c, e in _NZV.items())


@query("near_zero_variance_a05_w05", f"""
    SELECT "column", n_unique, {r('n_unique * 100.0 / n_rows')} AS unique_pct, top_count, second_count,
           CASE WHEN second_count > 0 THEN {r('top_count / second_count')} END AS freq_ratio,
           (second_count = 0 OR top_count / second_count >= 20) AND n_unique * 100.0 / n_rows <= 10 AS is_nzv
    FROM ({_NZV_SQL})""")
def near_zero_variance(t: Tables):
    return rounded(P.near_zero_variance(t("lineitem", *[f"{e} AS {c}" for c, e in _NZV.items()])))


@query("variance_threshold_a06_d04", f"""
    SELECT "column", {r('v', 4)} AS variance, v > 0.01 AS kept FROM (
        SELECT 'l_quantity' AS "column", var_pop(l_quantity) AS v FROM lineitem
        UNION ALL SELECT 'l_discount', var_pop(l_discount) FROM lineitem
        UNION ALL SELECT 'nothing', var_pop(0 * l_linenumber) FROM lineitem
        UNION ALL SELECT 'gaps', var_pop(coalesce(CASE WHEN l_linenumber > 3 THEN l_tax END, 0)) FROM lineitem)""")
def variance_threshold(t: Tables):
    df = t("lineitem", "l_quantity", "l_discount", "0 * l_linenumber AS nothing",
           "CASE WHEN l_linenumber > 3 THEN l_tax END AS gaps")
    return rounded(P.variance_screen(df, 0.01), 4)


def _contract_sql(col: str, expr: str, dtype: str, numeric: bool, table: str) -> str:
    lo, hi = (f"min({expr})::DOUBLE", f"max({expr})::DOUBLE") if numeric else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    whole = f"bool_and(abs({expr} - round_even({expr}, 0)) <= 1e-8 + 1e-5 * abs(round_even({expr}, 0)))" if numeric else "false"
    small = f"CASE WHEN count(DISTINCT {expr}) <= 25 THEN list_sort(list(DISTINCT {expr}::DOUBLE)) END" if numeric else "CAST(NULL AS DOUBLE[])"
    cats = "CAST(NULL AS VARCHAR[])" if numeric else f"list_sort(list(DISTINCT {expr}) FILTER (WHERE {expr} IS NOT NULL))"
    mode = (f"(SELECT CAST(m{'::DOUBLE' if numeric else ''} AS VARCHAR) FROM (SELECT {expr} AS m, count(*) AS n FROM {table} "
            f"WHERE {expr} IS NOT NULL GROUP BY 1 ORDER BY n DESC, m LIMIT 1))")
    return (f"SELECT '{col}' AS \"column\", '{dtype}' AS dtype, {str(numeric).lower()} AS is_numeric, {lo} AS min, {hi} AS max, "
            f"{whole} AS integer_coded, {small} AS support, {cats} AS categories, {mode} AS mode, count(DISTINCT {expr}) AS n_levels "
            f"FROM {table}")


@query("column_contract_a07", " UNION ALL ".join([
    _contract_sql("l_quantity", "l_quantity", "double", True, "lineitem"),
    _contract_sql("l_discount", "l_discount", "double", True, "lineitem"),
    _contract_sql("l_extendedprice", "l_extendedprice", "double", True, "lineitem"),
    _contract_sql("l_linenumber", "l_linenumber", "int", True, "lineitem"),
    _contract_sql("l_returnflag", "l_returnflag", "string", False, "lineitem"),
    _contract_sql("flag", "(CASE WHEN l_tax > 0.04 THEN l_linestatus END)", "string", False, "lineitem")]))
def column_contract(t: Tables):
    df = t("lineitem", "l_quantity", "l_discount", "l_extendedprice", "l_linenumber", "l_returnflag",
           "CASE WHEN l_tax > 0.04 THEN l_linestatus END AS flag")
    return P.profile_contract(df, "l_returnflag").table(t.spark)


@query("class_balance_a08_d08", """
    SELECT count(*) FILTER (WHERE quality = 0) AS n_class_0, count(*) FILTER (WHERE quality = 1) AS n_class_1 FROM labels""")
def class_balance(t: Tables):
    return P.class_counts(t("labels"), "quality")


@query("feature_comparison_a09", f"""
    WITH n AS (SELECT count(*) AS n FROM lineitem WHERE l_linestatus = 'F')
    SELECT * FROM (SELECT 'l_quantity' AS "column", {r("avg(l_quantity) FILTER (WHERE l_linestatus = 'O')")} AS synthetic_level,
           {r("stddev_pop(l_quantity) FILTER (WHERE l_linestatus = 'O')")} AS synthetic_spread,
           {r("avg(l_quantity) FILTER (WHERE l_linestatus = 'F')")} AS real_level,
           {r("stddev_pop(l_quantity) FILTER (WHERE l_linestatus = 'F')")} AS real_spread FROM lineitem
    UNION ALL SELECT 'is_r', CAST(count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS DOUBLE),
           {r("count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') / (SELECT n FROM n)")},
           CAST(count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS DOUBLE),
           {r("count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') / (SELECT n FROM n)")} FROM lineitem)""")
def feature_comparison(t: Tables):
    df = t("lineitem", "l_linestatus", "l_quantity", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_r")
    real, fake = (df.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("F", "O"))
    return rounded(P.feature_distribution(real, fake))


_ENTROPY_SQL = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", {r('-sum(p * ln(p))')} AS entropy FROM (
        SELECT count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY round_even({e}, 0))"""
    for c, e in (("l_quantity", "l_quantity"), ("tenth", "l_discount * 50"), ("price", "l_extendedprice / 1000")))


@query("rounded_entropy_a10", _ENTROPY_SQL)
def rounded_entropy(t: Tables):
    df = t("lineitem", "l_quantity", "l_discount * 50 AS tenth", "l_extendedprice / 1000 AS price")
    return rounded(P.rounded_entropy(df, ["l_quantity", "tenth", "price"]))


@query("density_curve_a11", f"""
    WITH s AS (SELECT l_linestatus AS g, count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h,
                      min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
         v AS (SELECT l_linestatus AS g, l_quantity AS x, count(*) AS w FROM lineitem GROUP BY 1, 2)
    SELECT s.g AS l_linestatus, CAST(i AS INT) AS i, {r('max(lo - (hi - lo) * 0.5::DOUBLE + i * ((hi - lo) * 2 / 63))')} AS x,
           {r('sum(w * exp(-0.5 * ((lo - (hi - lo) * 0.5::DOUBLE + i * ((hi - lo) * 2 / 63) - x) / h) ** 2)) / max(n * h * sqrt(2 * pi()))', 9)} AS density
    FROM v JOIN s ON v.g = s.g, range(64) k(i) GROUP BY s.g, i""")
def density_curve(t: Tables):
    curve = P.kde_curve(t("lineitem", "l_linestatus", "l_quantity"), "l_quantity", 64, by="l_linestatus")
    return rounded(rounded(curve, 6, ["x"]), 9, ["density"])


_BINNED = """(WITH s AS (SELECT {by} AS g, count(*) AS n, stddev_samp({x}) * pow(count(*), -0.2) AS h, min({x}) AS lo, max({x}) AS hi FROM {table} GROUP BY 1),
    m AS (SELECT *, (hi - lo) / least(1048576.0::DOUBLE, pow(2, ceil(log2(16 * (hi - lo) / h)))) AS d FROM s),
    p AS (SELECT g, ({x} - lo) / d AS p FROM {table} t JOIN m ON m.g = t.{by}),
    b AS (SELECT g, b, sum(w) AS w FROM (SELECT g, floor(p) AS b, 1 - (p - floor(p)) AS w FROM p UNION ALL SELECT g, floor(p) + 1, p - floor(p) FROM p) GROUP BY 1, 2)
    SELECT m.g, CAST(i AS INT) AS i, max(lo - (hi - lo) * 0.5::DOUBLE + i * ((hi - lo) * 2 / 63)) AS x,
           sum(w * exp(-0.5::DOUBLE * pow((lo - (hi - lo) * 0.5::DOUBLE + i * ((hi - lo) * 2 / 63) - (lo + b * d)) / h, 2))) / max(n * h * 2.5066282746310002::DOUBLE) AS density
    FROM b JOIN m ON m.g = b.g, range(64) r(i) GROUP BY m.g, i)"""


@query("density_binned_a11", f"""SELECT g AS l_linestatus, 'l_extendedprice' AS "column", i, {r('x')} AS x, {r('1000 * density', 9)} AS density
    FROM {_BINNED.format(by='l_linestatus', x='l_extendedprice', table='lineitem')}""")
def density_binned(t: Tables):
    curve = P.binned_curves(t("lineitem", "l_linestatus", "l_extendedprice"), ["l_extendedprice"], 64, by="l_linestatus")
    return rounded(rounded(curve.withColumn("density", F.col("density") * 1000), 6, ["x"]), 9, ["density"])


@query("compared_values_v08", f"""
    SELECT g AS side, 'o_totalprice' AS "column", i, {r('x')} AS x, {r('1000 * density', 9)} AS y, NULL AS value
    FROM {_BINNED.format(by='side', x='o_totalprice', table="(SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, o_totalprice FROM orders)")}
    UNION ALL SELECT side, 'digit', NULL, NULL, {r("count(*) / CAST(sum(count(*)) OVER (PARTITION BY side) AS DOUBLE)", 9)}, CAST(digit AS VARCHAR)
    FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, o_custkey % 10 AS digit FROM orders) GROUP BY side, digit""")
def compared_values(t: Tables):
    df = t("orders", "o_orderkey", "o_totalprice", "o_custkey % 10 AS digit")
    a, b = (df.where(f"o_orderkey % 2 = {i}").drop("o_orderkey") for i in (0, 1))
    curves, shares = P.compare_values(a, b, ["o_totalprice", "digit"])
    curves = curves.select("side", "column", "i", F.round("x", 6).alias("x"), F.round(F.col("density") * 1000, 9).alias("y"), F.lit(None).cast("string").alias("value"))
    sides = shares.unpivot(["column", "value"], ["share_a", "share_b"], "side", "y").select(
        F.right("side", F.lit(1)).alias("side"), "column", F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("x"), F.round("y", 9).alias("y"), "value")
    return curves.unionByName(sides)


@query("contract_check_a12", """
    WITH f AS (SELECT * FROM lineitem WHERE l_linestatus = 'F')
    SELECT * FROM (
    SELECT 'column_order' AS rule, '' AS "column", 0 AS n_violations
    UNION ALL SELECT 'row_count', '', abs((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM f))
    UNION ALL SELECT 'not_null', 'l_quantity', 0 UNION ALL SELECT 'numeric', 'l_quantity', 0
    UNION ALL SELECT 'min', 'l_quantity', count(*) FILTER (WHERE q < (SELECT min(l_quantity) FROM f)) FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_quantity / 2 + 0.25 ELSE l_quantity END AS q FROM lineitem)
    UNION ALL SELECT 'max', 'l_quantity', count(*) FILTER (WHERE q > (SELECT max(l_quantity) FROM f)) FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_quantity / 2 + 0.25 ELSE l_quantity END AS q FROM lineitem)
    UNION ALL SELECT 'integer_coded', 'l_quantity', count(*) FILTER (WHERE abs(q - round_even(q, 0)) > 1e-8 + 1e-5 * abs(round_even(q, 0))) FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_quantity / 2 + 0.25 ELSE l_quantity END AS q FROM lineitem)
    UNION ALL SELECT 'not_null', 'y', 0 UNION ALL SELECT 'binary_target', 'y', count(*) FILTER (WHERE l_returnflag = 'A') FROM lineitem
    UNION ALL SELECT 'numeric', 'y', 0 UNION ALL SELECT 'min', 'y', 0
    UNION ALL SELECT 'max', 'y', count(*) FILTER (WHERE l_returnflag = 'A') FROM lineitem
    UNION ALL SELECT 'integer_coded', 'y', 0
    UNION ALL SELECT 'not_null', 'f', count(*) FILTER (WHERE l_tax = 0) FROM lineitem)""")
def contract_check(t: Tables):
    real = t("lineitem", "l_quantity", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y",
             "l_linestatus AS f").where("f = 'F'")
    made = t("lineitem", "CASE WHEN l_linenumber = 1 THEN l_quantity / 2 + 0.25 ELSE l_quantity END AS l_quantity",
             "CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 2 ELSE 0 END AS y",
             "CASE WHEN l_tax > 0 THEN l_linestatus END AS f")
    return P.validate(made, P.profile_contract(real, "y"), real.count())


@query("roundtrip_a13_f19_f20", """
    SELECT * FROM (VALUES ('p_brand', 0), ('p_type', 0), ('p_size', 0), ('p_retailprice', 0), ('is_big', 0), ('code', 0)) v("column", n_different)""")
def roundtrip(t: Tables):
    df = t("part", "p_partkey", "p_brand", "p_type", "CAST(p_size AS BIGINT) AS p_size", "p_retailprice",
           "CAST(p_size > 25 AS BIGINT) AS is_big", "CASE WHEN p_size > 5 THEN p_name END AS code")
    enc = C.fit_unit_encoder(df, "p_partkey")
    back = C.unit_decode(C.unit_encode(df, enc, 42, "p_partkey"), enc)
    near = back.withColumn("p_retailprice", F.round("p_retailprice", 6))
    return P.table_roundtrip(df, near, "p_partkey")


@query("column_bounds_a14", """
    SELECT 'l_quantity' AS "column", min(l_quantity) AS min, max(l_quantity) AS max, max(l_quantity) - min(l_quantity) AS range FROM lineitem
    UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), max(l_tax) - min(l_tax) FROM lineitem
    UNION ALL SELECT 'five', 5, 5, 1""")
def column_bounds(t: Tables):
    return P.bounds(t("lineitem", "l_quantity", "l_tax", "5 AS five"))


# ---------------------------------------------------------------- running shares


@query("nominal_limits_w02", f"""
    SELECT "column", ord, category, {r('lower', 9)} AS lower, {r('upper', 9)} AS upper FROM (
        {_LIMITS_SQL.format(col='diag_1', expr="coalesce(diag_1, 'MISSING')", table=ENCOUNTERS)}
        UNION ALL {_LIMITS_SQL.format(col='readmitted', expr='readmitted', table=ENCOUNTERS)})""")
def nominal_limits(t: Tables):
    return rounded(C.nominal_limits(encounters(t, "diag_1", "readmitted"), ["diag_1", "readmitted"]).drop("step"), 9)


_ORD = "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_custkey % 50 * 2 END"


@query("ordinal_limits_w03", f"""
    WITH m AS (SELECT v FROM (SELECT {_ORD} AS v, count(*) AS n FROM orders GROUP BY 1) WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1),
         c AS (SELECT coalesce({_ORD}, (SELECT v FROM m)) AS v, count(*) AS n FROM orders GROUP BY 1),
         d AS (SELECT k AS v, coalesce(n, 0) + 1 AS n FROM range((SELECT min(v) FROM c), (SELECT max(v) + 1 FROM c)) g(k) LEFT JOIN c ON c.v = k)
    SELECT 'code' AS "column", row_number() OVER (ORDER BY v) - 1 AS ord, CAST(v AS VARCHAR) AS category,
           {r('(sum(n) OVER (ORDER BY v) - n) / sum(n) OVER ()', 9)} AS lower, {r('sum(n) OVER (ORDER BY v) / sum(n) OVER ()', 9)} AS upper FROM d""")
def ordinal_limits(t: Tables):
    return rounded(C.listed_limits(C.ordinal_limits(t("orders", f"{_ORD} AS code"), "code")), 9)


# ---------------------------------------------------------------- label and one-hot encoding


@query("label_encode_f01", f"""
    SELECT encounter_id, dense_rank() OVER (ORDER BY admission_type_id) - 1 AS admission_type_id,
           dense_rank() OVER (ORDER BY coalesce(diag_1, 'nan')) - 1 AS diag_1, readmitted FROM {ENCOUNTERS}""")
def label_encode(t: Tables):
    return L.label_encode(encounters(t, "encounter_id", "admission_type_id", "diag_1", "readmitted"),
                          target="readmitted")


_FLAG_LEVELS = ("A", "N", "R")


@query("one_hot_drop_first_f02", """
    SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N",
           CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R", CAST(coalesce(l_tax > 0.04 AND l_linestatus = 'O', false) AS DOUBLE) AS "s_O"
    FROM lineitem""")
def one_hot_drop_first(t: Tables):
    df = t("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
           "CASE WHEN l_tax > 0.04 THEN l_linestatus END AS s", "l_linestatus")
    return L.one_hot(df.drop("l_linestatus"), ["l_returnflag", "s"], drop_first=True).withColumns({
        "l_orderkey": F.col("l_orderkey").cast("bigint"), "l_linenumber": F.col("l_linenumber").cast("int")})


@query("one_hot_all_f03", f"""
    SELECT encounter_id, {', '.join(f"CAST(readmitted = '{v}' AS INT) AS " + chr(34) + f"readmitted_{v}" + chr(34) for v in ('<30', '>30', 'NO'))},
           CAST(gender = 'Female' AS INT) AS "gender_Female", CAST(gender = 'Male' AS INT) AS "gender_Male" FROM {ENCOUNTERS}""")
def one_hot_all(t: Tables):
    return L.one_hot(encounters(t, "encounter_id", "readmitted", "gender"), drop_first=False, cast="int")


@query("encode_categoricals_f04", f"""
    SELECT encounter_id, CASE WHEN gender = 'Male' THEN 1::DOUBLE ELSE 0 END AS "gender_Male",
           {', '.join(f"CAST(coalesce(race = 'R{i}', false) AS DOUBLE) AS " + chr(34) + f"race_R{i}" + chr(34) for i in range(1, 5))},
           CASE readmitted WHEN 'NO' THEN 0 WHEN '>30' THEN 1 ELSE 2 END AS readmitted FROM {ENCOUNTERS}""")
def encode_categoricals(t: Tables):
    df = encounters(t, "encounter_id", "gender", "race", "readmitted")
    out = L.encode_categoricals(df, "readmitted", days=True, hot=True)
    return out.withColumn("encounter_id", F.col("encounter_id").cast("bigint"))


@query("ordinal_all_f24", """
    SELECT dense_rank() OVER (ORDER BY p_partkey) - 1 AS p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand,
           dense_rank() OVER (ORDER BY p_size) - 1 AS p_size, dense_rank() OVER (ORDER BY p_retailprice) - 1 AS p_retailprice FROM part""")
def ordinal_all(t: Tables):
    return L.ordinal_encode_all(t("part", "p_partkey", "p_brand", "p_size", "p_retailprice"))


# ---------------------------------------------------------------- scaling


@query("standardize_f05", f"""
    SELECT o_orderkey, {r('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()')} AS o_totalprice, 0.0::DOUBLE AS flat
    FROM orders""")
def standardize(t: Tables):
    return rounded(X.standardize(t("orders", "o_orderkey", "o_totalprice", "7 AS flat"), ["o_totalprice", "flat"]))


@query("minmax_f06", f"""
    SELECT o_orderkey, {r('(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())')} AS o_totalprice,
           0.0::DOUBLE AS flat FROM orders""")
def minmax(t: Tables):
    return rounded(X.normalize(t("orders", "o_orderkey", "o_totalprice", "7 AS flat"), ["o_totalprice", "flat"]))


@query("inverse_minmax_f07", f"""
    SELECT event_id, round_even(x * 2, 0) / 2 AS age, CAST(round_even(y, 0) AS BIGINT) AS stay, {r('w')} AS price FROM (
        SELECT event_id, greatest(least(v, 1), 0) + 1 AS x, greatest(least(v, 1), 0) * 13 + 1 AS y, greatest(least(v, 1), 0) * 2 + 0.5::DOUBLE AS w
        FROM (SELECT event_id, {u(3, 'inv', 'event_id')} * 1.5::DOUBLE - 0.25::DOUBLE AS v FROM events))""")
def inverse_minmax(t: Tables):
    from tabwright.functions.rand import hash_uniform
    v = hash_uniform(3, "inv", "event_id") * 1.5 - 0.25
    df = t("events", "event_id").select("event_id", v.alias("age"), v.alias("stay"), v.alias("price"))
    return rounded(X.denormalize(df, {"age": (1.0, 2.0), "stay": (1.0, 14.0), "price": (0.5, 2.5)}))


@query("inverse_numeric_f08", f"""
    SELECT l_orderkey, l_linenumber, {r('l_discount * 900 + 100')} AS plain, CAST(round_even(l_discount * 905 + 100, 0) AS BIGINT) AS discrete FROM lineitem""")
def inverse_numeric(t: Tables):
    return rounded(t("lineitem", "l_orderkey", "l_linenumber", "l_discount").select(
        "l_orderkey", "l_linenumber", X.undo_numeric(F.col("l_discount"), 100.0, 1000.0).alias("plain"),
        X.undo_numeric(F.col("l_discount"), 100.0, 1005.0, discrete=True).alias("discrete")))


# ---------------------------------------------------------------- imputation

_MODE = "(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("impute_mean_f09", f"""
    SELECT encounter_id, coalesce(race, {_MODE.format(c='race', t=ENCOUNTERS)}) AS race,
           {r(f"coalesce(time_in_hospital, (SELECT avg(time_in_hospital) FROM {ENCOUNTERS}))")} AS time_in_hospital,
           {r(f"coalesce(num_lab_procedures, (SELECT avg(num_lab_procedures) FROM {ENCOUNTERS}))")} AS num_lab_procedures FROM {ENCOUNTERS}""")
def impute_mean(t: Tables):
    df = encounters(t, "encounter_id", "race", "time_in_hospital", "num_lab_procedures")
    return rounded(X.impute(df, "mean"))


@query("impute_median_f10", f"""
    SELECT encounter_id, coalesce(diag_1, {_MODE.format(c='diag_1', t=ENCOUNTERS)}) AS diag_1,
           coalesce(time_in_hospital, (SELECT median(time_in_hospital) FROM {ENCOUNTERS})) AS time_in_hospital,
           coalesce(num_lab_procedures, (SELECT median(num_lab_procedures) FROM {ENCOUNTERS})) AS num_lab_procedures FROM {ENCOUNTERS}""")
def impute_median(t: Tables):
    df = encounters(t, "encounter_id", "diag_1", "time_in_hospital", "num_lab_procedures")
    return X.impute(df, "median")


@query("median_value_f10", "SELECT 'l_extendedprice' AS \"column\", median(l_extendedprice) AS median FROM lineitem "
                           "UNION ALL SELECT 'l_discount', median(l_discount) FROM lineitem")
def median_value(t: Tables):
    got = P.medians(t("lineitem"), ["l_extendedprice", "l_discount"])
    return t.spark.createDataFrame(list(got.items()), "column string, median double")


_DIRTY = """(SELECT DISTINCT l_suppkey, l_returnflag, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax END AS tax,
    CASE WHEN l_suppkey % 3 = 0 THEN 'x' END AS mostly_gone, CASE WHEN l_suppkey % 5 = 0 THEN ' nan' WHEN l_suppkey % 5 = 1 THEN ' b ' ELSE 'a' END AS note FROM lineitem)"""


@query("clean_table_f11", f"""
    WITH d AS (SELECT l_suppkey, l_returnflag, tax, CASE WHEN trim(note) <> 'nan' THEN trim(note) END AS note FROM {_DIRTY})
    SELECT l_suppkey, l_returnflag, coalesce(tax, (SELECT median(tax) FROM d)) AS tax,
           coalesce(note, {_MODE.format(c='note', t='d')}) AS note FROM d""")
def clean_table(t: Tables):
    df = t("lineitem", "l_suppkey", "l_returnflag AS ` l_returnflag`",
           "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_tax END AS tax",
           "CASE WHEN l_suppkey % 3 = 0 THEN 'x' END AS mostly_gone",
           "CASE WHEN l_suppkey % 5 = 0 THEN ' nan' WHEN l_suppkey % 5 = 1 THEN ' b ' ELSE 'a' END AS `note `")
    return X.clean(df)


@query("impute_regression_f12", f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN {r('s.a + s.b * x', 4)} ELSE {r('y', 4)} END AS y FROM
    (SELECT o_orderkey, o_custkey * 1.0::DOUBLE AS x, o_totalprice + o_custkey * 100 AS y FROM orders),
    (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM
        (SELECT o_orderkey, o_custkey * 1.0::DOUBLE AS x, o_totalprice + o_custkey * 100 AS y FROM orders) WHERE o_orderkey % 4 <> 0) s""")
def impute_regression(t: Tables):
    df = t("orders", "o_orderkey", "CAST(o_custkey AS DOUBLE) AS x",
           "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice + o_custkey * 100 END AS y")
    return rounded(X.impute_regress(df, "y", "o_orderkey").select("o_orderkey", "y"), 4)


_KNN_SQL = f"""
    WITH p AS (SELECT p_partkey AS k, p_size / 10.0::DOUBLE AS a, p_retailprice / 100.0::DOUBLE AS b, p_type AS y, p_partkey % 6 = 0 AS gone FROM part),
         d AS (SELECT t.k AS t, s.k AS s, s.y, sqrt((t.a - s.a) ** 2 + (t.b - s.b) ** 2) AS dist FROM p t, p s WHERE t.gone AND NOT s.gone),
         n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY dist, s) <= 3),
         w AS (SELECT t, y, sum(CASE WHEN z THEN CAST(dist = 0 AS DOUBLE) ELSE 1 / dist END) AS w
               FROM (SELECT *, bool_or(dist = 0) OVER (PARTITION BY t) AS z FROM n) GROUP BY 1, 2),
         g AS (SELECT t, y FROM w QUALIFY row_number() OVER (PARTITION BY t ORDER BY w DESC, y) = 1)
    SELECT p.k AS p_partkey, CASE WHEN p.gone THEN g.y ELSE p.y END AS p_type FROM p LEFT JOIN g ON g.t = p.k"""


@query("impute_neighbours_f13", _KNN_SQL)
def impute_neighbours(t: Tables):
    df = t("part", "p_partkey", "p_size / 10D AS a", "p_retailprice / 100D AS b",
           "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_type END AS p_type")
    return X.impute_knn(df, "p_type", "p_partkey", 3, ["a", "b"]).select("p_partkey", "p_type")


@query("impute_neighbours_text_f13", f"""
    WITH p AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS a, p_brand AS b, p_name AS c, p_type AS y, p_partkey % 7 = 0 AS gone FROM part),
         d AS (SELECT t.k AS t, s.k AS s, s.y, sqrt((t.a - s.a) ** 2 + CASE WHEN t.b <> s.b THEN 2 ELSE 0 END + CASE WHEN t.c <> s.c THEN 2 ELSE 0 END) AS dist
               FROM p t, p s WHERE t.gone AND NOT s.gone),
         {_KNN_SQL[_KNN_SQL.index("n AS (SELECT * FROM d"):]}""")
def impute_neighbours_text(t: Tables):
    df = t("part", "p_partkey", "CAST(p_size AS DOUBLE) AS size", "p_brand", "p_name",
           "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS p_type")
    return X.impute_knn(df, "p_type", "p_partkey", 3).select("p_partkey", "p_type")


@query("impute_chain_f14")
def impute_chain(t: Tables):
    df = t("part", "p_partkey", "p_name", "CAST(p_size AS DOUBLE) AS size",
           "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS price",
           "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS kind")
    return X.impute_chain(df, "p_partkey", ["p_name"])


# ---------------------------------------------------------------- unit-interval encoding


def _probit_sql(p: str) -> str:
    from tabwright.functions import rand as H

    def horner(x, coefs):
        out = repr(coefs[0]) + "::DOUBLE"
        for c in coefs[1:]:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    mid, sq = f"({p} - 0.5::DOUBLE)", f"(({p} - 0.5::DOUBLE) * ({p} - 0.5::DOUBLE))"
    return (f"CASE WHEN {p} < {H.PROBIT_TAIL} THEN {horner(low, H.PROBIT_C)} / {horner(low, H.PROBIT_D + (1.0,))} "
            f"WHEN {p} > 1 - {H.PROBIT_TAIL} THEN -{horner(high, H.PROBIT_C)} / {horner(high, H.PROBIT_D + (1.0,))} "
            f"ELSE {horner(sq, H.PROBIT_A)} * {mid} / {horner(sq, H.PROBIT_B + (1.0,))} END")


def _interval_sql(lo: str, hi: str, p: str) -> str:
    return f"greatest({lo}, least({hi}, ({lo} + {hi}) / 2 + ({hi} - {lo}) / 6 * ({_probit_sql(p)})))"


_P = "(0.0013498980316300933::DOUBLE + {u} * (1 - 2 * 0.0013498980316300933::DOUBLE))"


@query("encode_nominal_f15", f"""
    WITH l AS ({_LIMITS_SQL.format(col='x', expr="coalesce(diag_1, 'MISSING')", table=ENCOUNTERS)}),
         e AS (SELECT encounter_id, coalesce(diag_1, 'MISSING') AS d, {_P.format(u=u(42, 'unit/diag_1', 'encounter_id'))} AS p FROM {ENCOUNTERS})
    SELECT encounter_id, {r(_interval_sql('lower', 'upper', 'p'))} AS diag_1 FROM e JOIN l ON l.category = e.d""")
def encode_nominal(t: Tables):
    df = encounters(t, "encounter_id", "diag_1")
    return rounded(C.unit_encode(df, C.fit_unit_encoder(df, "encounter_id"), 42, "encounter_id"))


@query("encode_ordinal_f16", f"""
    WITH m AS (SELECT v FROM (SELECT {_ORD} AS v, count(*) AS n FROM orders GROUP BY 1) WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1),
         c AS (SELECT coalesce({_ORD}, (SELECT v FROM m)) AS v, count(*) AS n FROM orders GROUP BY 1),
         d AS (SELECT k AS v, coalesce(n, 0) + 1 AS n FROM range((SELECT min(v) FROM c), (SELECT max(v) + 1 FROM c)) g(k) LEFT JOIN c ON c.v = k),
         l AS (SELECT v, (sum(n) OVER (ORDER BY v) - n) / CAST(sum(n) OVER () AS DOUBLE) AS lower, sum(n) OVER (ORDER BY v) / CAST(sum(n) OVER () AS DOUBLE) AS upper FROM d),
         e AS (SELECT o_orderkey, coalesce({_ORD}, (SELECT v FROM m)) AS v, {_P.format(u=u(42, 'unit/code', 'o_orderkey'))} AS p FROM orders)
    SELECT o_orderkey, {r(_interval_sql('lower', 'upper', 'p'))} AS code FROM e JOIN l ON l.v = e.v""")
def encode_ordinal(t: Tables):
    df = t("orders", "o_orderkey", f"{_ORD} AS code")
    return rounded(C.unit_encode(df, C.fit_unit_encoder(df, "o_orderkey"), 42, "o_orderkey"))


@query("encode_binary_beta_f17")
def encode_binary_beta(t: Tables):
    df = t("orders", "o_orderkey", "CAST(o_orderstatus = 'F' AS BIGINT) AS flag")
    return C.encode_binary_beta(df, "flag", 42, "o_orderkey")


@query("encode_numeric_f18", f"""
    SELECT encounter_id, {r(f"(coalesce(num_lab_procedures, (SELECT median(num_lab_procedures) FROM {ENCOUNTERS})) - (SELECT min(num_lab_procedures) FROM {ENCOUNTERS})) / (SELECT max(num_lab_procedures) - min(num_lab_procedures) FROM {ENCOUNTERS})")} AS num_lab_procedures FROM {ENCOUNTERS}""")
def encode_numeric(t: Tables):
    return rounded(C.encode_numeric(encounters(t, "encounter_id", "num_lab_procedures"), "num_lab_procedures"))


_LINE_KEY = "concat_ws('/', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING))"


@query("unit_encode_table_f19", f"""
    WITH f AS ({_LIMITS_SQL.format(col='x', expr='l_returnflag', table='lineitem')}),
         e AS (SELECT {_LINE_KEY} AS k, l_returnflag, l_quantity, l_extendedprice FROM lineitem),
         b AS (SELECT min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_extendedprice) AS pl, max(l_extendedprice) AS ph FROM lineitem)
    SELECT k, {r(_interval_sql('lower', 'upper', _P.format(u=u(42, 'unit/l_returnflag', 'k'))))} AS l_returnflag,
           {r('(l_quantity - ql) / (qh - ql)')} AS l_quantity, {r('(l_extendedprice - pl) / (ph - pl)')} AS l_extendedprice
    FROM e JOIN f ON f.category = e.l_returnflag, b""")
def unit_encode_table(t: Tables):
    df = t("lineitem", f"{_LINE_KEY} AS k", "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(C.unit_encode(df, C.fit_unit_encoder(df, "k"), 42, "k"))


@query("unit_decode_table_f20", f"""
    WITH l AS (SELECT category, lower, upper, max(upper) OVER () AS top FROM ({_LIMITS_SQL.format(col='x', expr='p_type', table='part')})),
         b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
         e AS (SELECT event_id, greatest(least({u(5, 'x', 'event_id')} * 1.2::DOUBLE - 0.1::DOUBLE, 1), 0) AS x FROM events)
    SELECT event_id, category AS p_type, {r('(hi - lo) * x + lo')} AS p_retailprice FROM e JOIN l
        ON (x > lower OR (x <= 0 AND lower = 0)) AND x <= CASE WHEN upper = top THEN 1 ELSE upper END, b""")
def unit_decode_table(t: Tables):
    from tabwright.functions.rand import hash_uniform
    enc = C.fit_unit_encoder(t("part", "p_partkey", "p_type", "p_retailprice"), "p_partkey")
    x = hash_uniform(5, "x", "event_id") * 1.2 - 0.1
    made = t("events", "event_id").select("event_id", x.alias("p_type"), x.alias("p_retailprice"))
    return rounded(C.unit_decode(made, enc))


@query("decode_many_levels_j07", f"""
    WITH l AS (SELECT category, lower, upper, max(upper) OVER () AS top FROM ({_LIMITS_SQL.format(col='x', expr="coalesce(diag_1, 'MISSING')", table=ENCOUNTERS)})),
         e AS (SELECT event_id, {u(6, 'x', 'event_id')} AS x FROM events)
    SELECT event_id, category FROM e JOIN l ON x > lower AND x <= CASE WHEN upper = top THEN 1 ELSE upper END""")
def decode_many_levels(t: Tables):
    from tabwright.functions.rand import hash_uniform
    limits = C.nominal_limits(encounters(t, "diag_1"), ["diag_1"])
    probe = t("events", "event_id").withColumn("x", hash_uniform(6, "x", "event_id"))
    return decode_by_limits(probe, limits, "x", "category", 4096).select("event_id", "category")


@query("decode_merged_j07", f"""
    WITH c AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c),
         l AS (SELECT v, (sum(n) OVER (ORDER BY v) - n) / total AS lower, sum(n) OVER (ORDER BY v) / total AS upper FROM c, t),
         e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE {u(8, 'x', 'event_id')} END::DOUBLE AS x FROM events)
    SELECT event_id, CAST(v AS VARCHAR) AS category FROM e JOIN l ON (x > lower OR x <= 0 AND lower = 0) AND x <= upper""")
def decode_merged(t: Tables):
    from tabwright.functions.order import running_sums
    from tabwright.functions.rand import hash_uniform
    orders = t("orders", "o_custkey")
    size = orders.count()
    run = running_sums(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), ["o_custkey"], {"upto": "n"})
    limits = run.select(((F.col("upto") - F.col("n")) / size).alias("lower"), (F.col("upto") / size).alias("upper"), F.col("o_custkey").cast("string").alias("category"))
    x = F.when(F.col("event_id") % 4 < 2, (F.col("event_id") % 4).cast("double")).otherwise(hash_uniform(8, "x", "event_id"))
    # half the rows stand at the ends, and the merge is taken whatever the size
    return decode_by_limits(t("events", "event_id").withColumn("x", x), limits, "x", "category", 0).select("event_id", "category")


_WIDE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 1000000000000 - o_custkey ELSE o_custkey * 1000 END"


@query("wide_ordinal_round_trip_f16_f20", f"SELECT o_orderkey, coalesce({_WIDE}, (SELECT v FROM (SELECT {_WIDE} AS v, count(*) AS n FROM orders GROUP BY 1) WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1)) AS code, TRUE AS inside FROM orders")
def wide_ordinal_round_trip(t: Tables):
    df = t("orders", "o_orderkey", f"CAST({_WIDE} AS BIGINT) AS code")
    enc = C.fit_unit_encoder(df, "o_orderkey")
    coded = C.unit_encode(df, enc, 42, "o_orderkey").withColumn("inside", F.col("code").between(0, 1))
    return C.unit_decode(coded, enc).select("o_orderkey", "code", "inside")


# ---------------------------------------------------------------- splits and sampling

_SPLIT_SQL = f"""
    WITH c AS (SELECT o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1),
         w AS (SELECT y, n, ceil(sum(n) OVER () * 0.3::DOUBLE) AS want, CAST(sum(n) OVER () AS DOUBLE) AS total FROM c),
         x AS (SELECT y, want, n * want / total AS e FROM w),
         q AS (SELECT y, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, y) <= want - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM x)
    SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u(42, 'split', 'o_orderkey')}, o_orderkey) <= quota AS INT) AS is_test
    FROM orders JOIN q ON q.y = o_orderstatus"""


@query("stratified_split_t01", _SPLIT_SQL)
def stratified_split(t: Tables):
    return M.stratified_split(t("orders", "o_orderkey", "o_orderstatus"), "o_orderstatus", 0.3, 42, "o_orderkey")


@query("plain_split_t02", f"""
    SELECT event_id, CAST(row_number() OVER (ORDER BY {u(42, 'plain', 'event_id')}, event_id) <= ceil(count(*) OVER () * 0.25::DOUBLE) AS INT) AS is_test FROM events""")
def plain_split(t: Tables):
    return M.plain_split(t("events", "event_id"), 0.25, 42, "event_id")


@query("bernoulli_split_t03", f"SELECT event_id, CAST({u(42, 'coin', 'event_id')} < 0.8::DOUBLE AS INT) AS is_train FROM events")
def bernoulli_split(t: Tables):
    return M.bernoulli_split(t("events", "event_id"), 0.8, 42, "event_id")


@query("half_split_t04", """
    SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) > count(*) OVER () // 2 AS INT) AS half FROM orders""")
def half_split(t: Tables):
    return M.half_split(t("orders", "o_orderkey"), "o_orderkey")


@query("disjoint_shards_t05", f"""
    SELECT o_orderkey, CAST((rk - 1) // s AS INT) AS shard FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {u(42, 'shard', 'o_orderkey')}, o_orderkey) AS rk,
           count(*) OVER () // 7 AS s FROM orders) WHERE rk <= s * 7""")
def disjoint_shards(t: Tables):
    return M.shards(t("orders", "o_orderkey"), 7, 42, "o_orderkey")


@query("stratified_folds_t06", f"""
    SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u(42, 'fold', 'o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders""")
def stratified_folds(t: Tables):
    return M.folds(t("orders", "o_orderkey", "o_orderstatus"), "o_orderstatus", 5, 42, "o_orderkey").drop("o_orderstatus")


def _draw_sql(table: str, key: str, salt: str, n: str, where: str = "true", pick: str | None = None) -> str:
    pick = pick or salt + "/pick"
    size = f"(SELECT count(*) FROM {table} WHERE {where})"
    return f"""SELECT d AS _draw, k FROM (
            SELECT d, CAST(floor({u(42, pick, 'd')} * m) AS BIGINT) + 1 AS want
            FROM (SELECT unnest(range(1, CAST({n} AS BIGINT) + 1)) AS d), {size} sz(m)) x
        JOIN (SELECT {key} AS k, row_number() OVER (ORDER BY {u(42, salt + '/rank', key)}, {key}) AS rk FROM {table} WHERE {where}) b
        ON b.rk = x.want"""


@query("resample_fill_t07", f"""
    SELECT doc_id, 0::BIGINT AS _draw FROM labels UNION ALL
    SELECT k, _draw FROM ({_draw_sql('labels', 'doc_id', 'fill', '(SELECT 5000 - count(*) FILTER (WHERE quality = 0) FROM labels)', 'quality = 0', 'fill/pick/0')})
    UNION ALL SELECT k, _draw FROM ({_draw_sql('labels', 'doc_id', 'fill', '(SELECT 6000 - count(*) FILTER (WHERE quality = 1) FROM labels)', 'quality = 1', 'fill/pick/1')})""")
def resample_fill(t: Tables):
    return M.fill_to(t("labels", "doc_id", "quality"), "quality", {0: 5000, 1: 6000}, 42, "doc_id").select("doc_id", "_draw")


_RARE = "CASE WHEN o_custkey % 40 = 0 THEN 1 ELSE 0 END"


@query("minority_boost_t08", f"""
    SELECT o_orderkey, 0::BIGINT AS _draw FROM orders UNION ALL SELECT k, _draw FROM (
        {_draw_sql(f'(SELECT o_orderkey, {_RARE} AS rare FROM orders)', 'o_orderkey', 'boost/rare', f'(SELECT round_even(count(*) * 0.1, 0) - sum({_RARE}) FROM orders)', 'rare = 1')})""")
def minority_boost(t: Tables):
    df = t("orders", "o_orderkey", f"{_RARE} AS rare", "o_custkey % 2 AS even")
    return M.boost(df, ["rare", "even"], 0.1, 42, "o_orderkey").select("o_orderkey", "_draw")


@query("bootstrap_t09", f"SELECT _draw, k AS event_id FROM ({_draw_sql('events', 'event_id', 'boot', '(SELECT 2 * count(*) FROM events)')})")
def bootstrap(t: Tables):
    events = t("events", "event_id")
    return M.bootstrap(events, 2 * events.count(), 42, "event_id")


# ---------------------------------------------------------------- feature jobs

_V2_SQL = f"""
    WITH b AS (SELECT * FROM {ENCOUNTERS} QUALIFY row_number() OVER (PARTITION BY patient_nbr ORDER BY time_in_hospital DESC NULLS LAST, encounter_id) = 1),
         c AS (SELECT encounter_id, gender, CAST(CASE WHEN age IN ('[60-70)', '[70-80)') THEN 1.5 WHEN age IN ('[80-90)', '[90-100)') THEN 2 ELSE 1 END AS DOUBLE) AS age,
               admission_type_id, time_in_hospital, num_lab_procedures, {_ICD.format(c='diag_1')} AS diag_1, {_ICD.format(c='diag_2')} AS diag_2,
               CASE WHEN A1Cresult IS NULL THEN 0 WHEN A1Cresult = 'Norm' THEN 1 WHEN A1Cresult = '>7' THEN 2 ELSE 3 END AS A1Cresult,
               CASE WHEN metformin = 'No' THEN 0 ELSE 1 END AS metformin, CASE WHEN insulin = 'No' THEN 0 ELSE 1 END AS insulin, readmitted FROM b)
    SELECT encounter_id, dense_rank() OVER (ORDER BY gender) - 1 AS gender, age, dense_rank() OVER (ORDER BY admission_type_id) - 1 AS admission_type_id,
           coalesce(time_in_hospital, (SELECT median(time_in_hospital) FROM c)) AS time_in_hospital,
           coalesce(num_lab_procedures, (SELECT median(num_lab_procedures) FROM c)) AS num_lab_procedures,
           dense_rank() OVER (ORDER BY diag_1) - 1 AS diag_1, dense_rank() OVER (ORDER BY diag_2) - 1 AS diag_2, A1Cresult AS "A1Cresult",
           metformin, insulin, CASE readmitted WHEN 'NO' THEN 0 ELSE 1 END AS readmitted FROM c"""


@query("readmission_features_v1_f21", f"""
    SELECT encounter_id, dense_rank() OVER (ORDER BY gender) - 1 AS gender, dense_rank() OVER (ORDER BY d) - 1 AS diag_1,
           CASE WHEN metformin = 'No' THEN 0 ELSE 1 END AS metformin, CASE readmitted WHEN 'NO' THEN 0 ELSE 1 END AS readmitted
    FROM (SELECT *, substr(lpad(substr(coalesce(diag_1, '8'), 1, 3), 3, '0'), 1, 2) AS d FROM {ENCOUNTERS})""")
def readmission_features_v1(t: Tables):
    df = encounters(t, "encounter_id", "gender", "diag_1", "metformin", "readmitted")
    return plans.engineer_v1(df.withColumn("diag_1", F.coalesce("diag_1", F.lit("8"))))


@query("readmission_features_v2_f22", _V2_SQL)
def readmission_features_v2(t: Tables):
    out = plans.engineer_v2(encounters(t))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("encounter_id",)})


@query("preprocess_job_v1_f23", f"""
    SELECT CAST(encounter_id AS DOUBLE) AS encounter_id, {r(f"coalesce(time_in_hospital, (SELECT avg(time_in_hospital) FROM {ENCOUNTERS}))")} AS time_in_hospital,
           CAST(CASE WHEN A1Cresult IS NULL THEN 0 WHEN A1Cresult = 'Norm' THEN 1 WHEN A1Cresult = '>7' THEN 2 ELSE 3 END AS DOUBLE) AS "A1Cresult" FROM {ENCOUNTERS}""")
def preprocess_job_v1(t: Tables):
    source = write_table(encounters(t, "encounter_id", "time_in_hospital", "weight", "A1Cresult"),
                         scratch_path(t.spark, "raw") + ".csv")
    out = plans.prepare_v1(t.spark, source, scratch_path(t.spark, "v1") + ".csv")
    return rounded(out.select(*[F.col(c).cast("double").alias(c) for c in out.columns]))


@query("preprocess_job_v2_f23", f"""
    WITH v AS ({_V2_SQL}), c AS (SELECT readmitted AS y, count(*) AS n FROM v GROUP BY 1),
         x AS (SELECT y, ceil(sum(n) OVER () * 0.2::DOUBLE) AS want, n * ceil(sum(n) OVER () * 0.2::DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS e FROM c),
         q AS (SELECT y, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, y) <= want - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM x)
    SELECT encounter_id, readmitted, diag_1 FROM v JOIN q ON q.y = v.readmitted
    QUALIFY row_number() OVER (PARTITION BY readmitted ORDER BY {u(42, 'split', "concat(encounter_id, '.0')")}, encounter_id) <= quota""")
def preprocess_job_v2(t: Tables):
    source = write_table(encounters(t), scratch_path(t.spark, "raw") + ".csv")
    _, test = plans.prepare_v2(t.spark, source, scratch_path(t.spark, "v2"))
    return test.select(F.col("encounter_id").cast("bigint").alias("encounter_id"), "readmitted", "diag_1")


