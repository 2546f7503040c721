"""Gap-compressed whole-number intervals and interval search."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabwright.functions.order import ceiling_lookup
from tabwright.operators import unitcode
from tabwright.operators.relational import decode_by_limits
from tabwright.sources.state import load_encoder, save_encoder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dense(values, rows):
    """Intervals of every whole number of the range, add-one smoothed."""
    lo, hi = min(values), max(values)
    mode = min(v for v, n in Counter(values).items() if n == max(Counter(values).values()))
    total, at, out = rows + hi - lo + 1, 0, {}
    for v in range(lo, hi + 1):
        n = values.count(v) + 1 + (rows - len(values) if v == mode else 0)
        out[v] = (at / total, (at + n) / total)
        at += n
    return out


VALUES = [3, 3, 7, 8, 8, 8, 20, -4, None, None]


def test_limits_equal_dense_ones(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id long, code long")
    limits = unitcode.ordinal_limits(df, "code")
    assert limits.count() == 5
    got = {int(r["category"]): (r["lower"], r["upper"]) for r in unitcode.listed_limits(limits).collect()}
    want = dense([v for v in VALUES if v is not None], len(VALUES))
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-12) for v in want)


@pytest.mark.parametrize("inline", [64, 0])
@pytest.mark.parametrize("levels", [200_000, 0])
def test_every_level_of_the_range_survives(spark, monkeypatch, inline, levels):
    for name, value in (("INLINE_LEVELS", inline), ("BROADCAST_LEVELS", levels)):
        monkeypatch.setattr(unitcode, name, value)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id long, code long")
    enc = unitcode.fit_unit_encoder(df, "id")
    new = spark.range(-10, 30).select("id", F.col("id").alias("code"))
    coded = unitcode.unit_encode(new, enc, 5, "id")
    want = dense([v for v in VALUES if v is not None], len(VALUES))
    for r in coded.collect():
        lo, hi = want[max(-4, min(20, r["id"]))]
        assert lo - 1e-12 <= r["code"] <= hi + 1e-12
    assert {r["id"]: r["code"] for r in unitcode.unit_decode(coded, enc).collect()} == {i: max(-4, min(20, i)) for i in range(-10, 30)}


def test_huge_range_keeps_three_rows(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (1, 10**12), (2, None), (3, 10**12)], "id long, code long")
    enc = unitcode.fit_unit_encoder(df, "id")
    assert enc.limits.count() == 2 and "sequence" not in plan(unitcode.ordinal_limits(df, "code"))
    probe = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 999, 5 * 10**11, 10**12 - 1, 10**12, None, 0, 10**13])], "id long, code long")
    for e in (enc, None):
        if e is None:
            save_encoder(enc, str(tmp_path / "state"))
            e = load_encoder(spark, str(tmp_path / "state"))
        back = {r["id"]: r["code"] for r in unitcode.unit_decode(unitcode.unit_encode(probe, e, 5, "id"), e).collect()}
        assert all(abs(back[i] - v) <= 1 for i, v in ((0, 1), (1, 2), (2, 999), (4, 10**12 - 1), (5, 10**12), (6, 10**12), (7, 1), (8, 10**12)))
        assert abs(back[3] - 5 * 10**11) <= 100  # a level is 1e-12 wide: 64-bit floats hold it to about a hundred here


def test_state_files_keep_gaps(spark, tmp_path):
    df = spark.createDataFrame([(i, v, "ab"[i % 2]) for i, v in enumerate(VALUES)], "id long, code long, t string")
    enc = unitcode.fit_unit_encoder(df, "id")
    save_encoder(enc, str(tmp_path / "state"))
    back = load_encoder(spark, str(tmp_path / "state"))
    rows = [sorted(map(tuple, e.limits.select(*unitcode.LIMIT_COLUMNS).collect())) for e in (enc, back)]
    assert len(rows[0]) == len(rows[1]) == 7
    for a, b in zip(*rows):
        assert a[:2] == b[:2] and a[4] == b[4] and b[2:4] == pytest.approx(a[2:4], abs=1e-12) and b[5] == a[5]


LIMITS = [(0.0, 0.25, "a"), (0.25, 0.25, "none"), (0.25, 0.6, "b"), (0.6, 0.9999999, "c")]
PROBES = [-1.0, 0.0, 0.1, 0.25, 0.26, 0.6, 0.61, 0.99, 1.0, 1.5, None]


@pytest.mark.parametrize("levels", [10, 0])
def test_interval_search_both_ways(spark, levels):
    limits = spark.createDataFrame(LIMITS, "lower double, upper double, category string")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(PROBES)], "_x long, x double")
    got = decode_by_limits(df, limits, "x", "d", levels)
    assert got.columns == ["_x", "x", "d"]
    assert [r["d"] for r in got.orderBy("_x").collect()] == ["a", "a", "a", "a", "b", "b", "c", "c", "c", None, None]
    assert decode_by_limits(df, limits.limit(0), "x", "d", levels).where("d IS NOT NULL").count() == 0


def test_hot_ends_are_dealt_out(spark):
    limits = spark.range(1000).selectExpr("id / 1000D AS lower", "(id + 1) / 1000D AS upper", "CAST(id AS STRING) AS category")
    half = spark.range(0, 20_000, 1, 4).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 0D WHEN id % 4 = 1 THEN 1D ELSE (id % 997 + 0.5D) / 1000 END AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = decode_by_limits(half, limits, "x", "d", 0)
        assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / len(sizes)
        want = {0: "0", 1: "999"}
        assert all(r["d"] == want.get(r["id"] % 4, str(r["id"] % 997)) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("rows", [100, 0])
def test_ceiling_lookup(spark, rows):
    table = spark.createDataFrame([(10, "ten", 1), (30, "thirty", None)], "b long, name string, n long")
    df = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 30), (5, 31), (6, None), (7, 5)], "id long, v long")
    got = {r["id"]: r["at"] and (r["at"]["name"], r["at"]["n"]) for r in ceiling_lookup(df, "v", table, "b", ["name", "n"], "at", rows).collect()}
    assert got == {1: ("ten", 1), 2: ("ten", 1), 3: ("thirty", None), 4: ("thirty", None), 5: None, 6: None, 7: ("ten", 1)}
