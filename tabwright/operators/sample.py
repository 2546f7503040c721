"""Reproducible splits, shards, folds and resampling, all on keyed hashes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.order import hash_flag, hash_rank, key_rank
from tabwright.functions.rand import hash_index, hash_uniform
from tabwright.operators.recode import q
from tabwright.operators.relational import shuffle_rows
from tabwright.session import bounded_rows

MAX_CLASSES = 10_000


def _largest_remainder(counts: list[tuple], test: float) -> list[tuple]:
    """Test quota per class: proportional floors, leftovers to the largest remainders."""
    total = sum(n for _, n in counts)
    want = math.ceil(total * test)
    exact = [(label, n * want / total) for label, n in counts]
    quotas = {label: math.floor(x) for label, x in exact}
    spare = want - sum(quotas.values())
    by_rest = sorted(range(len(exact)), key=lambda i: (-(exact[i][1] - math.floor(exact[i][1])), i))
    for i in by_rest[:spare]:
        quotas[exact[i][0]] += 1
    return list(quotas.items())


def stratified_split(df: DataFrame, y: str, test: float, seed: int, key: str,
                     out: str = "is_test") -> DataFrame:
    """1 for test rows; class shares exact by largest remainder, test size ceil(n * test).

    Class quotas become hash cut-offs, so no class is ever sorted in one task
    and the rows are not shuffled. Very many classes fall back to bucketed ranks.
    """
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    rows = bounded_rows(counts, MAX_CLASSES)
    if rows is not None:
        ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0]))
        return hash_flag(df, _largest_remainder(ordered, test), seed, "split", key, [y], out)
    total = df.count()
    want = math.ceil(total * test)
    shares = counts.withColumn("_x", F.col("n") * want / total).withColumn("_base", F.floor("_x"))
    spare = want - shares.agg(F.sum("_base")).first()[0]
    ranked = key_rank(shares.withColumn("_rest", F.col("_base") - F.col("_x")), ["_rest", y], "_at")
    quota = ranked.select(F.col(y).alias("_y"), (F.col("_base") + (F.col("_at") <= spare).cast("int")).alias("_q"))
    placed = hash_rank(df, seed, "split", key, [y], "_rank")
    return placed.join(quota, q(y).eqNullSafe(F.col("_y"))).select(
        *df.columns, (F.col("_rank") <= F.col("_q")).cast("int").alias(out))


def plain_split(df: DataFrame, test: float, seed: int, key: str, out: str = "is_test") -> DataFrame:
    """Exact-size split without strata: ceil(n * test) test rows."""
    return hash_flag(df, [(math.ceil(df.count() * test),)], seed, "plain", key, out=out)


def bernoulli_split(df: DataFrame, train: float, seed: int, key: str, out: str = "is_train") -> DataFrame:
    """Independent coin per row."""
    return df.withColumn(out, (hash_uniform(seed, "coin", key) < F.lit(train)).cast("int"))


def half_split(df: DataFrame, key: str, out: str = "half") -> DataFrame:
    """First floor(n/2) rows in key order are half 0, the rest half 1."""
    half = df.count() // 2
    return key_rank(df, [key], "_rank").select(
        *df.columns, (F.col("_rank") > F.lit(half)).cast("int").alias(out))


def shards(df: DataFrame, k: int, seed: int, key: str, out: str = "shard") -> DataFrame:
    """Permute, cut into k equal disjoint shards, drop the remainder."""
    size = df.count() // k
    ranked = hash_rank(df, seed, "shard", key, out="_rank").where(F.col("_rank") <= F.lit(size * k))
    return ranked.select(*df.columns, F.floor((F.col("_rank") - 1) / F.lit(size)).cast("int").alias(out))


def folds(df: DataFrame, y: str, k: int, seed: int, key: str, out: str = "fold") -> DataFrame:
    """Stratified fold id 0..k-1: hash rank within the class modulo k."""
    ranked = hash_rank(df, seed, "fold", key, [y], "_rank")
    return ranked.select(*df.columns, ((F.col("_rank") - 1) % F.lit(k)).cast("int").alias(out))


def draws(df: DataFrame, needed: dict, seed: int, salt: str, key: str, by: str | None = None) -> DataFrame:
    """Rows drawn with replacement: ``needed[group]`` draws from each group.

    Draw j takes the row at hash index j of its group's ranks, an equality
    join whose keys are spread evenly. Adds the draw number ``_draw``.
    """
    spark = df.sparkSession
    ranked = hash_rank(df, seed, salt + "/rank", key, [by] if by else [], "_rank")
    if by is None:
        ranked, group = ranked.withColumn("_all", F.lit(0)), "_all"
        sizes, plan = {0: df.count()}, {0: needed[None]}
    else:
        group = by
        sizes = {r[0]: r[1] for r in df.groupBy(by).agg(F.count(F.lit(1))).where(q(by).isin(*needed)).collect()}
        plan = {g: n for g, n in needed.items() if n > 0 and g in sizes}
    picks = None
    for g, n in plan.items():
        index = hash_index(F.lit(sizes[g]), seed, f"{salt}/pick/{g}" if by else f"{salt}/pick", "_draw")
        part = spark.range(1, n + 1).select(F.col("id").alias("_draw")).select(
            "_draw", F.lit(g).alias("_group"), index.alias("_rank"))
        picks = part if picks is None else picks.unionByName(part)
    if picks is None:
        return df.withColumn("_draw", F.lit(0).cast("bigint")).limit(0)
    picks = picks.withColumnRenamed("_group", group)
    return picks.join(ranked, [group, "_rank"]).select(*df.columns, "_draw")


def bootstrap(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows with replacement, numbered by ``_draw``."""
    return draws(df, {None: n}, seed, "boot", key)


def fill_to(df: DataFrame, y: str, target: dict, seed: int, key: str) -> DataFrame:
    """Top up each class to its target count by drawing with replacement; ``_draw`` is 0 for originals."""
    have = {r[0]: r[1] for r in df.groupBy(y).agg(F.count(F.lit(1))).where(q(y).isin(*target)).collect()}
    short = {g: n - have.get(g, 0) for g, n in target.items()}
    extra = draws(df, {g: n for g, n in short.items() if n > 0}, seed, "fill", key, y)
    return df.withColumn("_draw", F.lit(0).cast("bigint")).unionByName(extra)


def boost(df: DataFrame, cols: list[str], cutoff: float, seed: int, key: str) -> DataFrame:
    """For 0/1 columns whose majority share exceeds 1 - cutoff, draw the minority up to round(n * cutoff).

    Which columns to boost and the goal come from the table as it was; the
    minority is whichever value is rarer, counted and drawn from the table as
    it has grown by then. Returns the rows in a seeded shuffle with a ``_draw``
    number (0 for originals).
    """
    total = df.count()
    goal = int(round(total * cutoff))
    ones = df.agg(*[F.count_if(q(c) == 1).alias(c) for c in cols]).first().asDict()
    zeros = df.agg(*[F.count_if(q(c) == 0).alias(c) for c in cols]).first().asDict()
    out = df.withColumn("_draw", F.lit(0).cast("bigint")).withColumn("_key", F.col(key).cast("string"))
    for c in cols:
        rare = 1 if ones[c] <= zeros[c] else 0
        if not total or max(ones[c], zeros[c]) / total <= 1 - cutoff or not min(ones[c], zeros[c]):
            continue
        minority = out.where(q(c) == rare)
        up = goal - minority.count()
        if up > 0:
            extra = draws(minority.withColumnRenamed("_draw", "_old"), {None: up}, seed, f"boost/{c}", "_key").drop("_old")
            named = F.concat_ws("/", "_key", F.lit(c), F.col("_draw").cast("string"))
            out = out.unionByName(extra.withColumn("_key", named).select(*out.columns))
    return shuffle_rows(out, seed, "_key").drop("_key")
