"""Registry of checkable queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Table access for one session and data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str, *exprs: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.selectExpr(*exprs) if exprs else df

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its SQL counterpart."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zero."""
    cols = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in cols})


def r(expr: str, digits: int = 6) -> str:
    """The SQL counterpart of ``rounded`` for one expression."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0)"


def u(seed: int, salt: str, key: str) -> str:
    """The SQL counterpart of ``hash_uniform``."""
    text = f"concat_ws(':', '{seed}', '{salt}', CAST({key} AS VARCHAR))"
    return f"((CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496)"


def z(seed: int, salt: str, key: str) -> str:
    """The SQL counterpart of ``hash_normal``."""
    return (f"(sqrt(-2 * ln({u(seed, salt + '/r', key)})) "
            f"* cos(CAST(6.283185307179586 AS DOUBLE) * {u(seed, salt + '/a', key)}))")


# ---------------------------------------------------------------- stand-in tables (text valid in both engines)

DIAGNOSIS = (
    "CASE WHEN {k} % 29 = 0 THEN NULL WHEN {k} % 13 = 0 THEN concat('V', CAST(o_custkey % 90 AS STRING)) "
    "WHEN {k} % 11 = 0 THEN concat('250.', CAST(o_custkey % 100 AS STRING)) "
    "WHEN {k} % 7 = 0 THEN concat('E', CAST(o_custkey % 1000 AS STRING)) WHEN {k} % 17 = 0 THEN '1d' "
    "ELSE concat(CAST({k} % 1000 AS STRING), CASE WHEN {k} % 5 = 0 THEN '.81' ELSE '' END) END")

# one encounter per order; a patient is a customer
ENCOUNTER = [
    "o_orderkey AS encounter_id",
    "o_custkey AS patient_nbr",
    "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE concat('R', CAST(o_custkey % 5 AS STRING)) END AS race",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender",
    "concat('[', CAST(o_custkey % 10 * 10 AS STRING), '-', CAST(o_custkey % 10 * 10 + 10 AS STRING), ')') AS age",
    "CASE WHEN o_orderkey % 5 = 0 THEN '[50-75)' END AS weight",
    "CAST(o_custkey % 13 + 1 AS STRING) AS admission_type_id",
    "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 14 + 1 AS DOUBLE) END "
    "AS time_in_hospital",
    "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 120 AS DOUBLE) END "
    "AS num_lab_procedures",
    "CASE WHEN o_custkey % 3 = 0 THEN 'MC' END AS payer_code",
    "o_orderpriority AS medical_specialty",
    DIAGNOSIS.format(k="o_orderkey") + " AS diag_1",
    DIAGNOSIS.format(k="(o_orderkey + 3)") + " AS diag_2",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Norm' WHEN o_orderpriority = '2-HIGH' THEN '>7' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN '>8' END AS A1Cresult",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'No' WHEN o_orderkey % 4 = 1 THEN 'Steady' WHEN o_orderkey % 4 = 2 THEN 'Up' "
    "END AS metformin",
    "CASE WHEN o_custkey % 3 = 0 THEN 'No' ELSE 'Down' END AS insulin",
    "CASE WHEN o_orderstatus = 'O' THEN 'NO' WHEN o_orderstatus = 'F' THEN '>30' ELSE '<30' END AS readmitted",
]
ENCOUNTERS = f"(SELECT {', '.join(ENCOUNTER)} FROM orders)"

# scored rows with many ties
SCORED = ["CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label", "l_discount * 10 AS score",
          "CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split"]
SCORES = f"(SELECT {', '.join(SCORED)} FROM lineitem)"


def encounters(t: Tables, *names: str) -> DataFrame:
    df = t("orders", *ENCOUNTER)
    return df.select(*names) if names else df


