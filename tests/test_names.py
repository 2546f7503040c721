"""Columns with dots, spaces, backquotes and the operators' own names go through every profile operator."""

import pytest

from tabwright.operators import audit, categorical, profile, relational, scale, unitcode

NAMES = {"n": "a.b", "t": "max glu.serum", "m": "c`d", "c": "column", "v": "value", "r": "n_rows", "k": "_rows"}


def plain(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else "xyz"[i % 3], i % 2, 1.0, float(i % 3), None if i % 4 else 2.0, i % 3) for i in range(60)]
    return spark.createDataFrame(rows, "id long, n double, t string, m long, c double, v double, r double, k long")


def named(df):
    return df.withColumnsRenamed(NAMES)


def rows_of(df, back=None):
    back = {v: k for k, v in (back or {}).items()}
    return sorted(tuple(back.get(x, x) if isinstance(x, str) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("name, operator", [
    ("A02", lambda d: profile.missing_report(d)),
    ("A03", lambda d: profile.summarize(d)),
    ("A04", lambda d: profile.zero_variance(d)),
    ("A05", lambda d: profile.near_zero_variance(d)),
    ("A06", lambda d: profile.variance_screen(d)),
    ("A06", lambda d: profile.numeric_zero_variance(d)),
    ("A09", lambda d: profile.feature_distribution(d, d.where("id < 30"))),
    ("A10", lambda d: profile.rounded_entropy(d, profile.numeric_cols(d))),
    ("A13", lambda d: profile.table_roundtrip(d, d, "id")),
    ("A14", lambda d: profile.bounds(d)),
    ("V08", lambda d: profile.value_shares(d, d.where("id < 30"), d.columns)),
    ("V06", lambda d: audit.wasserstein_1(d, d.where("id < 30"), profile.numeric_cols(d))),
    ("W02", lambda d: unitcode.nominal_limits(d, d.columns)),
    ("W03", lambda d: unitcode.ordinal_limits(d, [d.columns[3], d.columns[7]])),
    ("D04", lambda d: profile.variance_screen(d, 0.5)),
])
def test_reports_are_the_same_under_other_names(spark, name, operator):
    df = plain(spark)
    want, got = rows_of(operator(df)), rows_of(operator(named(df)), NAMES)
    assert [[repr(round(x, 9) if isinstance(x, float) else x) for x in r] for r in got] == [[repr(round(x, 9) if isinstance(x, float) else x) for x in r] for r in want]


def test_tables_keep_their_columns(spark):
    df = named(plain(spark))
    for out in (scale.impute(df), scale.standardize(df, ["a.b"]), scale.normalize(df, ["a.b", "column"]), categorical.label_encode(df, ["max glu.serum"]),
                relational.full_distinct(df)):
        assert out.columns == df.columns and out.count() == 60
    contract = profile.profile_contract(df, "c`d")
    assert contract.names == df.columns
    assert not [r for r in profile.validate(df.select(*map(profile.q, df.columns)), contract).collect() if r["n_violations"] and r["rule"] not in ("not_null", "numeric")]
    enc = unitcode.fit_unit_encoder(df, "id")
    back = unitcode.unit_decode(unitcode.unit_encode(df, enc, 1, "id"), enc)
    assert back.columns == df.columns
    assert {r["column"]: r["n_different"] for r in profile.table_roundtrip(df.select("id", profile.q("c`d")), back.select("id", profile.q("c`d")), "id").collect()} == {"c`d": 0}
