"""Exact ranks, running sums, cut-offs and order statistics without one-task sorts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.rand import hash_uniform
from tabwright.session import stored

HASH_BUCKETS = 1 << 16


def sql_literal(value) -> str:
    """SQL text of a plain value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def _own(df: DataFrame) -> list[Column]:
    """All columns by exact name, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def running_sums(df: DataFrame, keys: list[str], sums: dict[str, str],
                 by: list[str] | None = None) -> DataFrame:
    """Add inclusive running sums in key order, nulls first.

    ``df`` has one row per ``by + keys``. ``sums`` maps output to input column.
    Rows are range-partitioned by ``by + keys`` once; each task sorts its slice,
    and only the totals of a slice and group meet to become offsets. There are
    as many slices as shuffle partitions, so they follow the size of the data.
    """
    by = by or []
    ranged = df.repartitionByRange(*[F.col(c) for c in (*by, *keys)])
    tagged = stored(ranged.select("*", F.spark_partition_id().alias("_b"), F.struct(F.lit(0), *[F.col(c) for c in by]).alias("_g")))
    inside = Window.partitionBy("_g", "_b").orderBy(*[F.col(k) for k in keys]).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = tagged.groupBy("_g", "_b").agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    heads = heads.select("_g", "_b", *[
        F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_o_{out}") for out in sums])
    local = tagged.select("*", *[F.sum(src).over(inside).alias(f"_l_{out}") for out, src in sums.items()])
    return local.join(heads, ["_g", "_b"]).select(
        *_own(df), *[(F.col(f"_l_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums])


def key_rank(df: DataFrame, keys: list[str], out: str = "rank",
             by: list[str] | None = None) -> DataFrame:
    """1-based position in key order; ``df`` has one row per ``by + keys``."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), keys, {out: "_one"}, by).drop("_one")


def ceiling_lookup(df: DataFrame, col: str, table: DataFrame, bound: str, payload: list[str], out: str,
                   broadcast_rows: int = 200_000, spread: Column | None = None) -> DataFrame:
    """Add ``out``, a struct of the ``payload`` of the row of ``table`` with the smallest ``bound`` at or above ``col``.

    Null where there is none or ``col`` is null; bounds are unique and the first
    of the ``payload`` columns is never null. Up to
    ``broadcast_rows`` bounds go to the tasks as one sorted array for a binary
    search and no row moves. More are merged with the distinct values in one
    range-partitioned pass and joined back by value. Rows where ``spread`` is
    true get null and are dealt out evenly there, whatever their value.
    """
    spark = df.sparkSession
    kept = table.select(F.col(bound).alias("_bound"), *payload)
    few = kept.limit(broadcast_rows + 1).toPandas() if broadcast_rows else None
    if few is not None and len(few) <= broadcast_rows:
        kind = T.StructType([kept.schema[c] for c in payload])
        few = few.sort_values("_bound", ignore_index=True)
        rows = few[payload].astype({c: "Int64" for c in payload if few[c].dtype == "int64"})
        shared = spark.sparkContext.broadcast((few["_bound"].to_numpy(), rows))

        @F.pandas_udf(kind)
        def search(x: pd.Series) -> pd.DataFrame:
            bounds, rows = shared.value
            at = np.searchsorted(bounds, x.to_numpy(), side="left")
            return rows.reindex(np.where(x.isna(), len(bounds), at)).reset_index(drop=True)

        there = F.col(out)[payload[0]].isNotNull()
        return df.withColumn(out, search(F.col(f"`{col}`"))).withColumn(out, F.when(there if spread is None else there & ~spread, F.col(out)))
    key = F.col(f"`{col}`")
    asked = df.select(key.alias("_x")).where(F.col("_x").isNotNull() if spread is None else F.col("_x").isNotNull() & ~spread).distinct()
    listed = kept.select(F.col("_bound").alias("_x"), F.struct(*payload).alias("_row"))
    nothing = F.lit(None).cast(listed.schema["_row"].dataType)
    both = listed.unionByName(asked.select("_x", nothing.alias("_row"))).repartitionByRange("_x")
    both = stored(both.select("*", F.spark_partition_id().alias("_b")))
    heads = both.where("_row IS NOT NULL").groupBy("_b").agg(F.min_by("_row", "_x").alias("_head"))
    slices = both.select("_b").distinct().join(heads, "_b", "left")
    later = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)  # one row a slice
    slices = slices.select("_b", F.first("_head", ignorenulls=True).over(later).alias("_next"))
    inside = Window.partitionBy("_b").orderBy(F.desc("_x"), F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_own", F.last("_row", ignorenulls=True).over(inside)).where("_row IS NULL")
    filled = filled.join(F.broadcast(slices), "_b").select("_x", F.coalesce("_own", "_next").alias(out))
    if spread is None:
        return df.join(filled, key == F.col("_x"), "left").drop("_x")
    salt = F.struct(F.when(spread, F.monotonically_increasing_id()).alias("s"), F.when(~spread, key).alias("x"))
    named = filled.withColumn("_k", F.struct(F.lit(None).cast("bigint").alias("s"), F.col("_x").alias("x"))).drop("_x")
    return df.withColumn("_k", salt).join(named, "_k", "left").drop("_k")


def _group(by: list[str]) -> Column:
    return F.struct(F.lit(0), *[F.col(c) for c in by])


def _hash_bucket() -> Column:
    # declared non-null, else joins on it add a filter that repeats the hash
    return F.coalesce(F.floor(F.col("_u") * HASH_BUCKETS), F.lit(0).cast("bigint"))


def hash_rank(df: DataFrame, seed: int, salt: str, key: str, by: list[str] | None = None,
              out: str = "rank") -> DataFrame:
    """1-based position per group in hash order (unique ``key`` breaks ties).

    Ranks are local to a hash bucket plus the counts of earlier buckets, so a
    group holding most rows is still spread over many tasks.
    """
    by = by or []
    tagged = (
        df.withColumn("_u", hash_uniform(seed, salt, key)).withColumn("_g", _group(by))
        .withColumn("_b", _hash_bucket())
    )
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = tagged.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.select("_g", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_g", "_b").orderBy("_u", key)
    local = tagged.withColumn("_rn", F.row_number().over(inside))
    return local.join(heads, ["_g", "_b"]).select(
        *_own(df), (F.col("_rn") + F.col("_off")).cast("bigint").alias(out))


def hash_flag(df: DataFrame, quotas: list[tuple], seed: int, salt: str, key: str,
              by: list[str] | None = None, out: str = "picked") -> DataFrame:
    """1 for the first quota rows of each group in hash order, else 0.

    ``quotas`` holds (group values..., quota) and is bounded by the caller, so
    the exact cut-offs are broadcast and the rows themselves are not shuffled.
    """
    by = by or []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by]
                       + ["_quota bigint"])
    ordered = [f.name for f in df.schema if f.name in by]
    rows = [tuple(dict(zip(by, q[:-1]))[c] for c in ordered) + (int(q[-1]),) for q in quotas]
    want = df.sparkSession.createDataFrame(rows, schema).select(_group(by).alias("_g"), "_quota")
    keyed = df.select(_group(by).alias("_g"), F.col(key).alias("_k"),
                      hash_uniform(seed, salt, key).alias("_u"))
    keyed = keyed.withColumn("_b", _hash_bucket())
    upto = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    heads = keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.withColumn("_run", F.sum("_n").over(upto))
    edge = heads.join(F.broadcast(want), "_g").where(
        (F.col("_run") - F.col("_n") < F.col("_quota")) & (F.col("_quota") <= F.col("_run"))
    ).select("_g", "_b", (F.col("_quota") - F.col("_run") + F.col("_n")).alias("_need"))
    inside = Window.partitionBy("_g", "_b").orderBy("_u", "_k")
    cuts = (
        keyed.join(F.broadcast(edge), ["_g", "_b"])
        .withColumn("_rn", F.row_number().over(inside)).where(F.col("_rn") == F.col("_need"))
        .select("_g", F.struct("_u", "_k").alias("_cut"))
    )
    here = F.struct(F.col("_u"), F.col(key).alias("_k"))
    return (
        df.withColumn("_g", _group(by)).withColumn("_u", hash_uniform(seed, salt, key))
        .join(F.broadcast(cuts), "_g", "left")
        .select(*_own(df), F.coalesce((here <= F.col("_cut")).cast("int"), F.lit(0)).alias(out))
    )


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Interpolated median of each numeric column (null for an all-null column).

    One sketch pass brackets the middle ranks, one pass counts what lies below
    each bracket, and only bracketed values are grouped and ranked exactly.
    """
    if not cols:
        return {}
    margin, accuracy = 2e-4, 20000
    values = {c: F.col(f"`{c}`").cast("double") for c in cols}
    ends = F.array(F.lit(0.5 - margin), F.lit(0.5 + margin))
    facts = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(values.values())],
                   *[F.percentile_approx(x, ends, F.lit(accuracy)).alias(f"q{i}") for i, x in enumerate(values.values())]
                   ).first()
    live = [i for i in range(len(cols)) if facts[f"n{i}"]]
    exprs = list(values.values())
    if not live:
        return dict.fromkeys(cols)
    below = df.agg(*[F.count_if(exprs[i] < F.lit(facts[f"q{i}"][0])).alias(f"b{i}") for i in live]).first()
    parts = [F.when(exprs[i].between(F.lit(facts[f"q{i}"][0]), F.lit(facts[f"q{i}"][1])),
                    F.struct(F.lit(i).alias("probe"), exprs[i].alias("v"))) for i in live]
    inside = (df.select(F.explode(F.array_compact(F.array(*parts))).alias("p"))
              .groupBy("p.probe", "p.v").agg(F.count(F.lit(1)).alias("n")))
    run = running_sums(inside, ["v"], {"upto": "n"}, by=["probe"])

    def per_probe(numbers: dict[int, int]) -> Column:
        cases = [F.when(F.col("probe") == i, F.lit(int(n)).cast("bigint")) for i, n in numbers.items()]
        return F.coalesce(*cases)

    base = per_probe({i: below[f"b{i}"] for i in live})
    hits = []
    for rank in ({i: (facts[f"n{i}"] - 1) // 2 for i in live}, {i: facts[f"n{i}"] // 2 for i in live}):
        want = per_probe(rank)
        hits.append((base + F.col("upto") - F.col("n") <= want) & (want < base + F.col("upto")))
    got = run.groupBy("probe").agg(F.max(F.when(hits[0], F.col("v"))).alias("lo"),
                                   F.max(F.when(hits[1], F.col("v"))).alias("hi")).collect()
    found = {cols[r["probe"]]: r for r in got}
    out: dict[str, float | None] = dict.fromkeys(cols)
    for i in live:
        r = found.get(cols[i])
        if r is None or r["lo"] is None or r["hi"] is None:
            raise RuntimeError(f"median of {cols[i]} fell outside its bracket")
        out[cols[i]] = (r["lo"] + r["hi"]) / 2
    return out
