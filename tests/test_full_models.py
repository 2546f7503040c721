"""The comparison on synthetic rows fits every model at its full size."""

from tabwright.plans import queries_models as plans
from tabwright.plans.registry import QUERIES


def test_train_on_synthetic_fits_full_ensembles(spark, monkeypatch, tmp_path):
    orders = spark.range(400).selectExpr("id AS o_orderkey", "id * 7919 % 500 AS o_custkey", "1000D * (id * 31 % 400) AS o_totalprice",
                                         "timestamp_seconds(86400 * (id * 17 % 300)) AS o_orderdate", "concat(1 + id % 5, '-X') AS o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    sizes = []
    monkeypatch.setattr(plans.M, "train_eval", lambda name, train, test, n, seed=42, scale=1.0: sizes.append((name, scale)) or (0.5, 0.5))
    QUERIES["train_on_synthetic_m09"](spark, str(tmp_path)).collect()
    assert {name for name, _ in sizes} == set(plans.M.ZOO) and {scale for _, scale in sizes} == {1.0}
