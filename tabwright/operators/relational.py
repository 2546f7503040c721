"""Deduplication, joins, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.order import ceiling_lookup, hash_flag, key_rank, sql_literal
from tabwright.functions.rand import hash_uniform

TAKE_ROWS = 100_000
INLINE_LEVELS = 256
BROADCAST_LEVELS = 200_000


def keep_best(df: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """One row per key: largest ``by`` (nulls last), ties to the smallest ``tie``.

    A struct maximum combines map-side, so a hot key costs one row per task.
    ``tie`` must be numeric and unique within the key.
    """
    rank = F.struct(F.col(by).isNotNull().alias("p"), F.col(by).alias("v"), (-F.col(tie)).alias("t"))
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in others]), rank).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col(f"_best.`{c}`") for c in df.columns])


def full_distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def zip_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables side by side, matched one to one on a key."""
    return left.join(right, key, "inner")


def union_tagged(tables: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Stack tables by column name, with the table's name in ``tag``."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def align_counts(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Counts of every value seen in either table; an absent side is 0.

    One union and one grouping replace the outer join of two groupings.
    """
    both = a.select(col, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(col, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(col).agg(
        F.sum("_a").cast("bigint").alias("n_a"), F.sum("_b").cast("bigint").alias("n_b"))


def decode_case(col: str, uppers: list[tuple[float, object]]) -> Column:
    """First category whose upper bound is at or above the value; the last bound is taken as 1."""
    name = "`" + col.replace("`", "``") + "`"
    ordered = sorted(uppers, key=lambda u: u[0])
    ordered[-1] = (max(1.0, ordered[-1][0]), ordered[-1][1])

    def branch(lo: int, hi: int) -> str:
        if lo == hi:
            return sql_literal(ordered[lo][1])
        mid = (lo + hi) // 2
        return f"if({name} <= {sql_literal(ordered[mid][0])}, {branch(lo, mid)}, {branch(mid + 1, hi)})"

    return F.expr(f"if({name} <= {sql_literal(ordered[-1][0])}, {branch(0, len(ordered) - 1)}, null)")


def decode_by_limits(df: DataFrame, limits: DataFrame, col: str, out: str, broadcast_levels: int = BROADCAST_LEVELS) -> DataFrame:
    """Interval lookup against ``limits(lower, upper, category)`` with lower < x <= upper.

    A binary search over the sorted upper bounds, or beyond
    ``broadcast_levels`` intervals a range-partitioned merge; no grid, no
    product. Zero-width intervals never match. Values at or below the lowest
    bound belong to the first interval, those above the last lower bound and up
    to 1 to the last. With a column ``step`` the levels between two intervals
    are whole numbers that wide, counted down from the next category.
    """
    wide = limits.where("upper > lower")
    step = "step" if "step" in limits.columns else "CAST(NULL AS DOUBLE) AS step"
    wide = wide.selectExpr("lower", "upper", "category", step)
    ends = wide.agg(F.min_by(F.struct(*wide.columns), "upper").alias("first"), F.max_by(F.struct(*wide.columns), "upper").alias("last")).first()
    if ends["last"] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    x, (first, last) = F.col(f"`{col}`"), ends
    top = max(1.0, last["upper"])
    resolved = (x <= first["upper"]) | (x > last["lower"]) | x.isNull()
    at = ceiling_lookup(df, col, wide, "upper", ["lower", "category", "step"], "_at", broadcast_levels, F.coalesce(resolved, F.lit(True)))
    here = F.col("_at")
    between = (here["category"].try_cast("bigint") - 1 - F.floor((here["lower"] - x) / here["step"])).cast("string")
    found = (F.when(x.isNull() | (x > top), F.lit(None)).when(x <= first["upper"], F.lit(first["category"]))
             .when(x > last["lower"], F.lit(last["category"]))
             .when(here["step"].isNotNull() & (x <= here["lower"]), between).otherwise(here["category"]))
    return at.withColumn(out, found.cast("string")).drop("_at")


def snap(x: Column, allowed: list[float]) -> Column:
    """Closest allowed value, ties to the lower one (a bounded decision tree)."""
    values = sorted(set(float(v) for v in allowed))

    def branch(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(values[lo])
        mid = (lo + hi) // 2
        nearer = (x - F.lit(values[mid])) <= (F.lit(values[mid + 1]) - x)
        return F.when(nearer, branch(lo, mid)).otherwise(branch(mid + 1, hi))

    return F.when(x.isNotNull(), branch(0, len(values) - 1))


def or_vote(preds: list[DataFrame], key: str) -> DataFrame:
    """Join prediction tables ``(key, label, pred)`` and predict 1 if any model does."""
    out = preds[0].withColumnRenamed("pred", "_p0")
    for i, p in enumerate(preds[1:], start=1):
        out = out.join(p.select(key, F.col("pred").alias(f"_p{i}")), key)
    votes = [F.col(f"_p{i}") for i in range(len(preds))]
    vote = F.greatest(*votes) if len(votes) > 1 else votes[0]
    return out.select(key, "label", vote.alias("pred"))


def value_set_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).unionByName(b.select(col)).distinct()


def outside_domain(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """Values not in the allowed set, with their counts (empty when the test passes)."""
    return (df.where(F.col(col).isNotNull() & ~F.col(col).isin(*allowed))
            .groupBy(col).agg(F.count(F.lit(1)).alias("n")))


def repair_unseen(col: Column, domain: list, fallback) -> Column:
    """Non-null values outside a bounded domain become ``fallback``."""
    return F.when(col.isNull() | col.isin(*domain), col).otherwise(F.lit(fallback))


def repair_ends(col: Column, low, high) -> Column:
    """Ordinal repair: above the fitted range to its top, else (below) to its bottom."""
    return F.when(col > F.lit(high), F.lit(high)).when(col < F.lit(low), F.lit(low)).otherwise(col)


def schema_difference(df: DataFrame, cols) -> list[str]:
    return sorted(set(df.columns) - set(cols))


def multi_sort(df: DataFrame, asc: list[str], desc: list[str]) -> DataFrame:
    """Ascending keys first, then descending keys with nulls last."""
    return df.orderBy(*[F.col(c).asc() for c in asc], *[F.col(c).desc_nulls_last() for c in desc])


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """First n rows by a unique key, in its order. Small n is a top-n; large n a distributed rank cut, then a sort."""
    if n <= 0:
        raise ValueError("n must be a positive integer")
    if n <= TAKE_ROWS:
        return df.orderBy(order).limit(n)
    return key_rank(df, [order], "_rank").where(F.col("_rank") <= n).drop("_rank").orderBy(order)


def shuffle_rows(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Seeded permutation: a global sort on the keyed uniform."""
    return df.withColumn("_u", hash_uniform(seed, "shuffle", key)).orderBy("_u", key).drop("_u")


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows drawn without replacement: the n smallest keyed uniforms, in their order."""
    drawn = df.withColumn("_u", hash_uniform(seed, "sample", key))
    if n <= TAKE_ROWS:
        return drawn.orderBy("_u", key).limit(n).drop("_u")
    return (hash_flag(drawn, [(min(n, df.count()),)], seed, "sample", key, out="_in")
            .where("_in = 1").orderBy("_u", key).drop("_in", "_u"))
