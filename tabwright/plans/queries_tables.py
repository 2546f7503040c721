"""Queries: sources, sinks, recodes, joins, set operations, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.order import key_rank
from tabwright.functions.text import value_text
from tabwright.operators import recode as R
from tabwright.operators import relational as J
from tabwright.operators import unitcode as C
from tabwright.operators.knn import knn, knn_approximate
from tabwright.plans.registry import ENCOUNTERS, SCORED, SCORES, Tables, encounters, query, r, rounded, u
from tabwright.session import materialize, scratch_path
from tabwright.sources import state as S
from tabwright.sources import tables as T

# ---------------------------------------------------------------- sources and sinks

_RAW = ["encounter_id", "race", "weight", "diag_1", "A1Cresult", "time_in_hospital"]


@query("csv_scan_s01", f"SELECT {', '.join(_RAW)} FROM {ENCOUNTERS}")
def csv_scan(t: Tables):
    # missing values are written as question marks, empty text and 'None' in turn
    raw = encounters(t, *_RAW)
    spelled = raw.withColumns({
        c: F.coalesce(F.col(c).cast("string"), F.element_at(
            F.array(F.lit("?"), F.lit("None"), F.lit("NULL")), (F.col("encounter_id") % 3 + 1).cast("int")))
        for c in _RAW[1:]})
    path = T.write_table(spelled, scratch_path(t.spark, "scan") + ".csv")
    return T.read_table(t.spark, [path + ".absent.csv", path], "encounter_id bigint, race string, weight string, "
                                 "diag_1 string, A1Cresult string, time_in_hospital double")


@query("column_group_s02", f"SELECT A1Cresult FROM {ENCOUNTERS}")
def column_group(t: Tables):
    return T.column_group(encounters(t), "tests", {"tests": ("A1Cresult",)})


@query("assign_types_s03", f"""
    SELECT CAST(encounter_id AS DOUBLE) encounter_id, CAST(patient_nbr AS DOUBLE) patient_nbr, race,
           admission_type_id, time_in_hospital FROM {ENCOUNTERS}""")
def assign_types(t: Tables):
    cols = ["encounter_id", "patient_nbr", "race", "admission_type_id", "time_in_hospital"]
    return T.assign_types(encounters(t, *cols))


@query("csv_sink_s04", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_sink(t: Tables):
    path = T.write_table(t("customer"), scratch_path(t.spark, "sink") + ".csv")
    return T.read_table(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                                       "c_mktsegment string")


_LIMITS_SQL = """
    SELECT '{col}' AS "column", row_number() OVER (ORDER BY n DESC, category) - 1 AS ord, category,
           (sum(n) OVER (ORDER BY n DESC, category) - n) / CAST(sum(n) OVER () AS DOUBLE) AS lower,
           sum(n) OVER (ORDER BY n DESC, category) / CAST(sum(n) OVER () AS DOUBLE) AS upper
    FROM (SELECT {expr} AS category, count(*) AS n FROM {table} GROUP BY 1)"""


@query("encoder_state_s05", f"""
    SELECT "column", ord, category, {r('lower')} AS lower, {r('upper')} AS upper FROM (
    {_LIMITS_SQL.format(col='p_brand', expr='p_brand', table='part')}
    UNION ALL {_LIMITS_SQL.format(col='p_type', expr='p_type', table='part')})""")
def encoder_state(t: Tables):
    part = t("part", "p_partkey", "p_brand", "p_type", "p_retailprice")
    prefix = scratch_path(t.spark, "encoder")
    S.save_encoder(C.fit_unit_encoder(part, "p_partkey"), prefix)
    loaded = S.load_encoder(t.spark, prefix)
    return rounded(loaded.limits.select("column", "ord", "category", "lower", "upper"))


@query("sectioned_lookup_s06", """
    SELECT CAST(0 AS BIGINT) AS section, 'r_regionkey' AS name, CAST(r_regionkey AS VARCHAR) AS code,
           r_name || ', region' AS description FROM region
    UNION ALL SELECT 1, 'n_nationkey', CAST(n_nationkey AS VARCHAR), n_name FROM nation""")
def sectioned_lookup(t: Tables):
    blocks = [t("region", "'r_regionkey,description' AS head", "CAST(r_regionkey AS BIGINT) AS k",
                "concat(r_regionkey, ',\"', r_name, ', region\"') AS line"),
              t("nation", "'n_nationkey,description' AS head", "CAST(n_nationkey AS BIGINT) AS k",
                "concat(n_nationkey, ',', n_name) AS line")]
    lines = None
    for i, b in enumerate(blocks):
        head = b.groupBy("head").agg(F.lit(-1).cast("bigint").alias("k")).select("k", F.col("head").alias("line"))
        part = b.select("k", "line").unionByName(head).withColumn("i", F.lit(i))
        if i:
            part = part.unionByName(head.select(F.lit(-2).cast("bigint").alias("k"), F.lit(",").alias("line"),
                                                F.lit(i).alias("i")))
        lines = part if lines is None else lines.unionByName(part)
    path = scratch_path(t.spark, "sections")
    lines.orderBy("i", "k").coalesce(1).select("line").write.text(path)
    return S.read_sections(t.spark, path).withColumn("section", F.col("section").cast("bigint"))


@query("run_manifest_s07", """
    WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS a, count(*) FILTER (WHERE toxic = 1) AS b
               FROM labels)
    SELECT * FROM (
        SELECT 'params' AS kind, 'seed' AS name, '42' AS value
        UNION ALL SELECT 'split', side || '.rows', CAST(n AS VARCHAR) FROM c, (VALUES ('all.source'), ('all.synthetic')) s(side)
        UNION ALL SELECT 'split', side || '.class_0', CAST(a AS VARCHAR) FROM c, (VALUES ('all.source'), ('all.synthetic')) s(side)
        UNION ALL SELECT 'split', side || '.class_1', CAST(b AS VARCHAR) FROM c, (VALUES ('all.source'), ('all.synthetic')) s(side))""")
def run_manifest(t: Tables):
    labels, table = t("labels"), scratch_path(t.spark, "runs")
    S.write_manifest(t.spark, table, "demo", {"seed": 42}, {"all": (labels, labels, None)}, "toxic")
    return t.spark.read.parquet(table).select(
        F.regexp_replace("kind", "^param$", "params").alias("kind"), "name", "value")


@query("content_fingerprint_s08")
def content_fingerprint(t: Tables):
    return S.file_sha256(t.spark, t.path("lineitem")).select("sha256")


@query("replica_scan_s09", f"""
    SELECT dataset, c_custkey, greatest(least({r('a * s', 9)}, 1), 0) AS a FROM
    (SELECT c_custkey, c_acctbal / 5000 AS a FROM customer),
    (VALUES ('run_synthetic_1', 1.0), ('run_synthetic_2', 0.5), ('run_synthetic_3', -1.0)) v(dataset, s)""")
def replica_scan(t: Tables):
    root = scratch_path(t.spark, "replicas")
    base = t("customer", "c_custkey", "c_acctbal / 5000 AS a")
    for i, s in ((1, 1.0), (2, 0.5), (3, -1.0)):
        T.write_table(base.select("c_custkey", (F.round(F.col("a") * s, 9) + 0.0).alias("a")),
                      f"{root}/run_synthetic_{i}.csv")
    T.write_table(base, f"{root}/run_other.csv")
    # clip applies to every numeric column, so the key is read as text
    out = T.read_replicas(t.spark, f"{root}/*.csv", "c_custkey string, a double")
    return out.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("first_rows_s10", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 500")
def first_rows(t: Tables):
    return J.first_n(t("events", "event_id", "event_type", "value"), 500, "event_id")


# ---------------------------------------------------------------- recodes


@query("drop_columns_p01", f"SELECT encounter_id, gender, readmitted FROM {ENCOUNTERS}")
def drop_columns(t: Tables):
    return R.drop_cols(encounters(t, "encounter_id", "gender", "race", "weight", "readmitted"),
                       ["race", "weight", "payer_code", "nothing"])


@query("present_filter_p02", f"SELECT encounter_id, weight FROM {ENCOUNTERS} WHERE weight IS NOT NULL")
def present_filter(t: Tables):
    return R.keep_present(encounters(t, "encounter_id", "weight"), "weight")


@query("features_target_p03", "SELECT l_quantity, l_discount, l_returnflag FROM lineitem")
def features_target(t: Tables):
    return R.features_target(t("lineitem", "l_quantity", "l_returnflag", "l_discount"), "l_returnflag")[1]


@query("age_levels_p04", f"""
    SELECT encounter_id, CAST(CASE WHEN age IN ('[60-70)', '[70-80)') THEN 1.5 WHEN age IN ('[80-90)', '[90-100)')
           THEN 2 ELSE 1 END AS DOUBLE) AS age FROM {ENCOUNTERS}""")
def age_levels(t: Tables):
    return R.recode(encounters(t, "encounter_id", "age"), "age", R.AGE_LEVELS)


@query("target_recode_p05", f"""
    SELECT encounter_id, CASE readmitted WHEN 'NO' THEN 0 WHEN '>30' THEN 1 WHEN '<30' THEN 1 END AS readmitted,
           CASE readmitted WHEN 'NO' THEN 0 WHEN '>30' THEN 1 WHEN '<30' THEN 2 END AS days FROM {ENCOUNTERS}""")
def target_recode(t: Tables):
    df = encounters(t, "encounter_id", "readmitted").withColumn("days", F.col("readmitted"))
    return R.encode_target(R.encode_target(df, "readmitted"), "days", R.READMITTED_DAYS)


@query("drug_flags_p06", f"""
    SELECT encounter_id, CASE WHEN metformin = 'No' THEN 0 ELSE 1 END AS metformin,
           CASE WHEN insulin = 'No' THEN 0 ELSE 1 END AS insulin FROM {ENCOUNTERS}""")
def drug_flags(t: Tables):
    return R.binary_flags(encounters(t, "encounter_id", "metformin", "insulin"))


_ICD = """CASE WHEN {c} IS NULL THEN 'Other' WHEN {c} LIKE '250%' THEN 'Diabetes'
    WHEN {c} LIKE 'E%' OR {c} LIKE 'V%' OR try_cast({c} AS DOUBLE) IS NULL THEN 'Other'
    WHEN try_cast({c} AS DOUBLE) BETWEEN 390 AND 459 OR try_cast({c} AS DOUBLE) = 785 THEN 'Circulatory'
    WHEN try_cast({c} AS DOUBLE) BETWEEN 460 AND 519 OR try_cast({c} AS DOUBLE) = 786 THEN 'Respiratory'
    WHEN try_cast({c} AS DOUBLE) BETWEEN 520 AND 579 OR try_cast({c} AS DOUBLE) = 787 THEN 'Digestive'
    WHEN try_cast({c} AS DOUBLE) BETWEEN 580 AND 629 OR try_cast({c} AS DOUBLE) = 788 THEN 'Genitourinary'
    WHEN try_cast({c} AS DOUBLE) BETWEEN 140 AND 239 THEN 'Neoplasms'
    WHEN try_cast({c} AS DOUBLE) BETWEEN 710 AND 739 THEN 'Musculoskeletal'
    WHEN try_cast({c} AS DOUBLE) BETWEEN 800 AND 999 THEN 'Injury' ELSE 'Other' END"""


@query("diagnosis_group_p07", f"SELECT encounter_id, {_ICD.format(c='diag_1')} AS diag_1 FROM {ENCOUNTERS}")
def diagnosis_group(t: Tables):
    return encounters(t, "encounter_id", "diag_1").withColumn("diag_1", R.icd9_group(F.col("diag_1")))


@query("diagnosis_prefix_p08", f"""
    SELECT encounter_id, substr(lpad(substr(diag_1, 1, 3), 3, '0'), 1, 2) AS diag_1 FROM {ENCOUNTERS}""")
def diagnosis_prefix(t: Tables):
    return encounters(t, "encounter_id", "diag_1").withColumn("diag_1", R.icd9_prefix(F.col("diag_1")))


@query("lab_levels_p09", f"""
    SELECT encounter_id, CASE WHEN A1Cresult IS NULL THEN 0 WHEN A1Cresult = 'Norm' THEN 1 WHEN A1Cresult = '>7' THEN 2
           WHEN A1Cresult = '>8' THEN 3 END AS "A1Cresult" FROM {ENCOUNTERS}""")
def lab_levels(t: Tables):
    return R.lab_ordinal(encounters(t, "encounter_id", "A1Cresult"), "A1Cresult")


@query("sentinel_repair_p10", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 90.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer""")
def sentinel_repair(t: Tables):
    return R.fix_negative(t("customer", "c_custkey", "c_acctbal"), "c_acctbal", 90.0)


@query("clip_p11", """
    SELECT l_orderkey, l_linenumber, greatest(least(l_quantity / 40, 1), 0) AS a,
           greatest(least(l_discount * 30 - 1, 1), 0) AS b FROM lineitem""")
def clip(t: Tables):
    return R.clip(t("lineitem", "l_orderkey", "l_linenumber", "l_quantity / 40 AS a", "l_discount * 30 - 1 AS b"),
                  0.0, 1.0, ["a", "b"])


@query("trim_text_p12", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS c_name, c_mktsegment FROM customer""")
def trim_text(t: Tables):
    df = t("customer", "c_custkey",
           "CASE WHEN c_custkey % 10 = 0 THEN ' None' WHEN c_custkey % 5 = 0 THEN 'nan ' ELSE concat('  ', c_name, ' ') "
           "END AS `c_name `", "c_mktsegment AS ` c_mktsegment`")
    return R.trim_strings(df)


@query("score_threshold_p13", f"""
    SELECT score, CASE WHEN score >= 0.3::DOUBLE THEN 1 ELSE 0 END AS pred, count(*) AS n FROM {SCORES} GROUP BY 1, 2""")
def score_threshold(t: Tables):
    df = t("lineitem", *SCORED)
    return df.select("score", R.binarize(F.col("score"), 0.3).alias("pred")).groupBy("score", "pred").agg(
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- deduplication, joins, concatenation

_BEST_SQL = f"""
    SELECT encounter_id, patient_nbr, time_in_hospital, gender FROM {ENCOUNTERS}
    QUALIFY row_number() OVER (PARTITION BY patient_nbr ORDER BY time_in_hospital DESC NULLS LAST, encounter_id) = 1"""


@query("best_row_per_key_j01_w01", _BEST_SQL)
def best_row_per_key(t: Tables):
    return J.keep_best(encounters(t, "encounter_id", "patient_nbr", "time_in_hospital", "gender"),
                       "patient_nbr", "time_in_hospital", "encounter_id")


@query("full_distinct_j02", """
    SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""")
def full_distinct(t: Tables):
    return J.full_distinct(t("lineitem", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("zip_columns_j03", "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders")
def zip_columns(t: Tables):
    return J.zip_columns(t("orders", "o_orderkey", "o_totalprice"),
                         t("orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")


@query("tagged_union_j04_u01", """
    SELECT c_custkey AS id, c_acctbal AS balance, 1 AS is_real FROM customer
    UNION ALL SELECT s_suppkey, s_acctbal, 0 FROM supplier""")
def tagged_union(t: Tables):
    both = J.union_tagged({"real": t("customer", "c_custkey AS id", "c_acctbal AS balance"),
                           "fake": t("supplier", "s_acctbal AS balance", "s_suppkey AS id")})
    return both.select("id", "balance", (F.col("dataset") == "real").cast("int").alias("is_real"))


@query("aligned_counts_j05", """
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) a
    FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def aligned_counts(t: Tables):
    return J.align_counts(t("customer", "c_nationkey AS k", "c_acctbal").where("c_acctbal > 0").select("k"),
                          t("supplier", "s_nationkey AS k"), "k")


@query("nearest_vectors_j06", f"""
    SELECT t_id, s_id, {r('dist')} AS dist, rank FROM (
        SELECT a.vec_id AS t_id, b.vec_id AS s_id, d AS dist,
               row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank
        FROM embeddings a, embeddings b, LATERAL (SELECT list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d)
        WHERE a.vec_id <> b.vec_id)
    WHERE rank <= 3""")
def nearest_vectors(t: Tables):
    vec = t("embeddings", "vec_id AS id", "embedding AS vec")
    return rounded(knn(vec, vec, 3, exclude_self=True).withColumn("rank", F.col("rank").cast("bigint")))


_PART_VEC = "struct_pack(x := p_size / 10.0::DOUBLE, y := p_retailprice / 100.0::DOUBLE)"


@query("nearest_points_pruned_j06", f"""
    SELECT t_id, s_id, {r('d')} AS dist FROM (
        SELECT a.p_partkey AS t_id, b.p_partkey AS s_id,
               sqrt(((a.p_size - b.p_size) / 10.0::DOUBLE) ** 2 + ((a.p_retailprice - b.p_retailprice) / 100.0::DOUBLE) ** 2) AS d
        FROM part a, part b WHERE a.p_partkey <> b.p_partkey)
    QUALIFY row_number() OVER (PARTITION BY t_id ORDER BY round(d, 9), s_id) = 1""")
def nearest_points_pruned(t: Tables):
    vec = t("part", "p_partkey AS id", "array(p_size / 10D, p_retailprice / 100D) AS vec")
    near = knn(vec, vec, 2, exclude_self=True, pivots=24, chunk=256)
    # equal distances differ in the last bit between engines, so ties are settled on nine digits
    tied = F.struct(F.round("dist", 9), "s_id")
    return rounded(near.groupBy("t_id").agg(F.min_by("s_id", tied).alias("s_id"), F.min("dist").alias("dist")))


@query("approximate_neighbours_j06", """
    SELECT count(*) AS n_queries, 5 * count(*) AS n_pairs, TRUE AS ranked, TRUE AS recall_reached FROM embeddings WHERE vec_id % 50 = 0""")
def approximate_neighbours(t: Tables):
    vec = t("embeddings", "vec_id AS id", "embedding AS vec")
    asked = vec.where("id % 50 = 0")
    near = knn_approximate(asked, vec, 5, exclude_self=True).withColumnRenamed("dist", "near_dist")
    true = knn(asked, vec, 5, exclude_self=True).select("t_id", "s_id", "dist")
    both = near.join(true, ["t_id", "s_id"], "left")
    met = F.count_if(F.abs(F.col("near_dist") - F.col("dist")) <= 1e-9)
    per = both.groupBy("t_id").agg(F.count(F.lit(1)).alias("n"), met.alias("met"), F.max("rank").alias("last"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_pairs"), F.bool_and(F.col("last") == 5).alias("ranked"),
                   (F.sum("met") >= 0.9 * F.sum("n")).alias("recall_reached"))


_STATUS_LIMITS = _LIMITS_SQL.format(col="event_type", expr="event_type", table="events")


@query("interval_decode_j07", f"""
    WITH l AS (SELECT category, lower, upper, max(upper) OVER () AS top FROM ({_STATUS_LIMITS}))
    SELECT event_id, category FROM (SELECT event_id, {u(42, 'probe', 'event_id')} AS x FROM events) e
    JOIN l ON e.x > l.lower AND e.x <= (CASE WHEN upper = top THEN greatest(upper, 1.0) ELSE upper END)""")
def interval_decode(t: Tables):
    from tabwright.functions.rand import hash_uniform
    limits = C.nominal_limits(t("events", "event_type"), ["event_type"])
    probe = t("events", "event_id").withColumn("x", hash_uniform(42, "probe", "event_id"))
    return J.decode_by_limits(probe, limits, "x", "category").select("event_id", "category")


@query("nearest_support_j08", """
    SELECT o_orderkey, CAST(list_min(list_transform([1000.0, 50000.0, 150000.0, 300000.0, 500000.0],
        lambda v: {'d': abs(o_totalprice - v), 'v': v})).v AS DOUBLE) AS snapped FROM orders""")
def nearest_support(t: Tables):
    return t("orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", J.snap(F.col("o_totalprice"), [500000.0, 1000.0, 50000.0, 150000.0, 300000.0]).alias("snapped"))


@query("or_vote_j09", """
    SELECT round(avg(CASE WHEN v = y THEN 1.0 ELSE 0 END), 6) AS accuracy,
           round(sum(CASE WHEN v = 1 AND y = 1 THEN 1.0 ELSE 0 END) / sum(y), 6) AS recall
    FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
                 greatest(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) AS v
          FROM orders)""")
def or_vote(t: Tables):
    label = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label"
    a = t("orders", "o_orderkey", label, "CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS pred")
    b = t("orders", "o_orderkey", label, "CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS pred")
    v = J.or_vote([a, b], "o_orderkey")
    hit = (F.col("pred") == 1) & (F.col("label") == 1)
    return rounded(v.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
                         (F.count_if(hit) / F.count_if(F.col("label") == 1)).alias("recall")))


# ---------------------------------------------------------------- sorts, limits, set operations


def positions(df: DataFrame) -> DataFrame:
    """The place of every row in the order in which ``df`` hands its rows out."""
    return key_rank(materialize(df.withColumn("_m", F.monotonically_increasing_id())), ["_m"], "pos").drop("_m")


@query("mixed_sort_o01", f"""
    SELECT encounter_id, patient_nbr, time_in_hospital, row_number() OVER (ORDER BY patient_nbr, time_in_hospital DESC NULLS LAST,
           encounter_id DESC) AS pos FROM {ENCOUNTERS}""")
def mixed_sort(t: Tables):
    df = J.multi_sort(encounters(t, "encounter_id", "patient_nbr", "time_in_hospital"),
                      ["patient_nbr"], ["time_in_hospital", "encounter_id"])
    return positions(df)


@query("seeded_shuffle_o04", f"""
    SELECT event_id, row_number() OVER (ORDER BY {u(7, 'shuffle', 'event_id')}, event_id) AS pos FROM events""")
def seeded_shuffle(t: Tables):
    return positions(J.shuffle_rows(t("events", "event_id"), 7, "event_id"))


@query("row_sample_o05", f"""
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY {u(11, 'sample', 'o_orderkey')}, o_orderkey LIMIT 1000""")
def row_sample(t: Tables):
    return J.sample_n(t("orders", "o_orderkey", "o_totalprice"), 1000, 11, "o_orderkey")


@query("value_set_union_u02", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def value_set_union(t: Tables):
    return J.value_set_union(t("customer", "c_nationkey AS k"), t("supplier", "s_nationkey AS k"), "k")


@query("domain_test_u03", """
    SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1""")
def domain_test(t: Tables):
    return J.outside_domain(t("orders", "o_orderstatus"), "o_orderstatus", ["O", "F"])


@query("unseen_repair_u04", """
    SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE 'F' END AS status,
           greatest(least(o_custkey % 100, 80), 20) AS code FROM orders""")
def unseen_repair(t: Tables):
    df = t("orders", "o_orderkey", "o_orderstatus", "o_custkey % 100 AS code")
    return df.select("o_orderkey", J.repair_unseen(F.col("o_orderstatus"), ["O", "F"], "F").alias("status"),
                     J.repair_ends(F.col("code"), 20, 80).alias("code"))


@query("schema_difference_u05", """
    SELECT column_name AS "column", n FROM (SELECT unnest(['l_linestatus', 'l_returnflag', 'l_shipdate']) AS column_name),
           (SELECT count(*) AS n FROM lineitem)""")
def schema_difference(t: Tables):
    df = t("lineitem")
    from tabwright.operators.profile import numeric_cols
    rest = J.schema_difference(df, numeric_cols(df))
    counts = df.agg(*[F.count(F.lit(1)).alias(c) for c in rest])
    return counts.unpivot([], rest, "column", "n")


@query("value_text_q20", """
    SELECT l_orderkey, l_linenumber, printf('%.15g', l_extendedprice) AS a, printf('%.15g', l_discount) AS b,
           printf('%.15g', l_quantity) AS c, printf('%.15g', l_extendedprice / 3) AS d FROM lineitem""")
def value_texts(t: Tables):
    df = t("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    return df.select(
        "l_orderkey", "l_linenumber", value_text(F.col("l_extendedprice"), "double").alias("a"),
        value_text(F.col("l_discount"), "double").alias("b"), value_text(F.col("l_quantity"), "double").alias("c"),
        value_text(F.col("l_extendedprice") / 3, "double").alias("d"))
