"""Reversible encoding of every column into [0, 1].

Nominal and ordinal levels own intervals as wide as their share; a value is a
draw inside its interval. Numbers are min-max scaled. Fitted state is a long
table of intervals plus a small dict of bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.order import ceiling_lookup, running_sums, sql_literal
from tabwright.functions.rand import hash_uniform, interval_normal, interval_probability
from tabwright.operators import profile as P
from tabwright.operators.recode import clip, q
from tabwright.operators.relational import decode_by_limits, decode_case
from tabwright.session import materialize

MISSING = "MISSING"
INLINE_LEVELS = 64
BROADCAST_LEVELS = 200_000
BETA_CELLS = 512
LIMIT_COLUMNS = ["column", "ord", "lower", "upper", "category", "step"]


@dataclass
class Levels:
    """One column's intervals in short: how many, the ends of an ordinal range, the first interval, the width of an unseen level."""

    n: int
    low: int | None
    high: int | None
    first: tuple[float, float]
    step: float | None = None


@dataclass
class UnitEncoder:
    """Kinds and types per column, intervals, bounds and fills.

    ``limits`` lists every seen level; whole numbers between two seen ones have
    intervals of width ``step`` and aren't listed. ``small`` holds the intervals
    (category, lower, upper) of columns with few listed levels, ``facts`` one summary per column; both are filled by ``settle``.
    """

    cols: list[str]
    kinds: dict[str, str]
    dtypes: dict[str, str]
    limits: DataFrame | None
    small: dict[str, list[tuple]] = field(default_factory=dict)
    min_max: dict[str, tuple[float, float]] = field(default_factory=dict)
    fills: dict[str, object] = field(default_factory=dict)
    beta: bool = False
    discrete: set[str] = field(default_factory=set)
    facts: dict[str, Levels] = field(default_factory=dict)

    def settle(self) -> UnitEncoder:
        """Summaries of all columns in one job, short interval lists in another; later use starts no job."""
        if self.limits is None:
            return self
        whole = F.col("category").try_cast("bigint")
        for r in self.limits.groupBy("column").agg(
                F.count(F.lit(1)).alias("n"), F.min(whole).alias("low"), F.max(whole).alias("high"),
                F.min_by(F.struct("lower", "upper"), "ord").alias("first"),
                F.max_by("category", F.struct(F.col("upper") - F.col("lower"), -F.col("ord"))).alias("widest"),
                F.max("step").alias("step")).collect():
            self.facts[r["column"]] = Levels(r["n"], r["low"], r["high"], tuple(r["first"]), r["step"])
            if self.kinds.get(r["column"]) in ("ordinal", "binary"):
                self.fills.setdefault(r["column"], r["widest"])
        few = [c for c, f in self.facts.items() if f.n <= 4 * INLINE_LEVELS]
        rows = self.limits.where(F.col("column").isin(*few)).collect() if few else []
        for r in sorted(rows, key=lambda r: (r["column"], r["ord"])):
            self.small.setdefault(r["column"], []).append((r["category"], r["lower"], r["upper"]))
        return self


def nominal_limits(df: DataFrame, cols: list[str]) -> DataFrame:
    """Intervals by share, largest first, name breaks ties; null is the level MISSING.

    Integer counts are summed first and divided last.
    """
    ready = df.select(*[F.coalesce(q(c).cast("string"), F.lit(MISSING)).alias(c) for c in cols])
    counts = P.level_counts(ready, cols).withColumn("_neg", -F.col("n")).withColumn("_one", F.lit(1))
    run = running_sums(counts, ["_neg", "value"], {"upto": "n", "ord": "_one"}, by=["column"])
    size = df.agg(F.count(F.lit(1)).alias("size")).scalar()
    return run.select(
        "column", (F.col("ord") - 1).cast("bigint").alias("ord"),
        ((F.col("upto") - F.col("n")) / size).alias("lower"), (F.col("upto") / size).alias("upper"),
        F.col("value").alias("category"), F.lit(None).cast("double").alias("step"))


def ordinal_limits(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """Intervals over each column's whole-number range, add-one smoothed, in value order; nulls count as the mode.

    Only seen values are listed. The levels between two of them are unseen, so
    each is ``step`` wide and its interval follows from the next listed one:
    the table grows with the distinct values, not with the range. All columns
    share one grouping. A column without values has the single level 0.
    """
    cols = [cols] if isinstance(cols, str) else cols
    counts = materialize(P.level_counts(df.select(*[q(c).cast("bigint").alias(c) for c in cols]), cols, "bigint"))
    rows = df.count()
    facts = {r["column"]: r for r in counts.groupBy("column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("seen"),
        F.max(F.struct(F.col("n"), (-F.col("value")).alias("v")))["v"].alias("v")).collect()}
    ends = [(c, r["lo"], r["hi"], -r["v"], rows - r["seen"]) if (r := facts.get(c)) else (c, 0, 0, 0, rows) for c in cols]
    ranges = df.sparkSession.createDataFrame(ends, "column string, lo bigint, hi bigint, mode bigint, missing bigint")
    empty = ranges.where(~F.col("column").isin(*facts)) if facts else ranges
    counts = counts.select("column", "value", "n").unionByName(empty.select("column", F.lit(0).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("n")))
    extra = F.when(F.col("value") == F.col("mode"), F.col("missing")).otherwise(0)
    seen = counts.join(F.broadcast(ranges), "column").select(
        "column", "value", (F.col("n") + extra).alias("n"), "lo", (F.lit(float(rows)) + F.col("hi") - F.col("lo") + 1).alias("total"))
    run = running_sums(seen, ["value"], {"upto": "n"}, by=["column"])
    # smoothing adds one per level, seen or not, so all levels up to a value add its place in the range
    place = F.col("value") - F.col("lo")
    upto = F.col("upto") + place + 1
    return run.select(
        "column", place.alias("ord"), ((upto - F.col("n") - 1) / F.col("total")).alias("lower"), (upto / F.col("total")).alias("upper"),
        F.col("value").cast("string").alias("category"), (F.lit(1.0) / F.col("total")).alias("step"))


def listed_limits(limits: DataFrame) -> DataFrame:
    """All levels of ordinal limits, unseen ones too, for display: as many rows as the range is long."""
    value = F.col("category").cast("bigint")
    before = F.lag(value, 1).over(Window.partitionBy("column").orderBy(value))
    gaps = limits.withColumn("_gap", F.coalesce(value - before - 1, F.lit(0)))
    each = gaps.withColumn("_back", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_gap"))))
    shown, low = F.col("_back") > 0, F.col("lower") - F.col("_back") * F.col("step")
    return each.select(
        "column", (F.col("ord") - F.col("_back")).alias("ord"), F.when(shown, low).otherwise(F.col("lower")).alias("lower"),
        F.when(shown, low + F.col("step")).otherwise(F.col("upper")).alias("upper"), (value - F.col("_back")).cast("string").alias("category"))


def binary_share(df: DataFrame, col: str) -> float:
    """Share of zeros after filling nulls with the mode."""
    mode = P.smallest_modes(df.select(q(col).cast("bigint").alias(col)), [col], "bigint")[col]
    filled = F.coalesce(q(col).cast("bigint"), F.lit(mode))
    return df.agg(F.avg((filled == 0).cast("double"))).first()[0]


def beta_quantiles(zeros: float, upper_half: bool, cells: int = BETA_CELLS) -> list[float]:
    """Tabulated inverse of Beta(100 p, 100 (1 - p)) cut to [0, p] or [p, 1]."""
    a, b = zeros * 100, (1 - zeros) * 100
    lo, hi = (zeros, 1.0) if upper_half else (0.0, zeros)
    x = np.linspace(lo, hi, 20001)
    mid = (x[1:] + x[:-1]) / 2
    log_pdf = (a - 1) * np.log(mid) + (b - 1) * np.log1p(-mid)
    mass = np.concatenate([[0.0], np.cumsum(np.exp(log_pdf - log_pdf.max()))])
    return np.interp(np.linspace(0, 1, cells + 1), mass / mass[-1], x).tolist()


def _from_table(table: list[float], u: Column) -> Column:
    """Linear interpolation in an evenly spaced quantile table."""
    cells = len(table) - 1
    at = u * cells
    i = F.floor(at).cast("int")
    values = F.array(*[F.lit(v) for v in table])
    left, right = F.element_at(values, i + 1), F.element_at(values, F.least(i + 2, F.lit(cells + 1)))
    return left + (right - left) * (at - i)


def encode_binary_beta(df: DataFrame, col: str, seed: int, key: str, zeros: float | None = None) -> DataFrame:
    """0/1 column to truncated beta draws below or above the share of zeros."""
    zeros = binary_share(df, col) if zeros is None else zeros
    if zeros in (0.0, 1.0):
        return df.withColumn(col, F.lit(1.0 - zeros))
    u = hash_uniform(seed, f"beta/{col}", key)
    mode = 0 if zeros >= 0.5 else 1
    value = F.coalesce(q(col).cast("bigint"), F.lit(mode))
    drawn = F.when(value == 0, _from_table(beta_quantiles(zeros, False), u)).otherwise(
        _from_table(beta_quantiles(zeros, True), u))
    return df.withColumn(col, drawn)


def encode_numeric(df: DataFrame, col: str, bounds: tuple[float, float] | None = None,
                   fill: float | None = None) -> DataFrame:
    """Null to the median, then min-max; a constant column becomes 0."""
    lo, hi = bounds or P.bounds_map(df, [col])[col]
    fill = P.medians(df, [col])[col] if fill is None else fill
    return df.withColumn(col, (F.coalesce(q(col).cast("double"), F.lit(fill)) - F.lit(lo)) / F.lit((hi - lo) or 1.0))


def column_kinds(df: DataFrame, binary_cols: list[str]) -> dict[str, str]:
    kinds = {}
    for f in df.schema:
        t = f.dataType.simpleString()
        if t == "string":
            kinds[f.name] = "nominal"
        elif t == "boolean" or f.name in binary_cols:
            kinds[f.name] = "binary"
        elif t in ("bigint", "int", "smallint", "tinyint"):
            kinds[f.name] = "ordinal"
        else:
            kinds[f.name] = "numeric"
    return kinds


def fit_unit_encoder(df: DataFrame, key: str, beta: bool = False) -> UnitEncoder:
    """Choose an encoding per column by type and fit them; ``key`` identifies rows and is not encoded."""
    body = df.drop(key)
    ints = [f.name for f in body.schema if f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")]
    only01 = P.wide_agg(body, {c: F.bool_and(q(c).isin(0, 1)) for c in ints}) if ints else {}
    kinds = column_kinds(body, [c for c in ints if only01[c] is not False])
    dtypes = {f.name: f.dataType.simpleString() for f in body.schema}
    enc = UnitEncoder(body.columns, kinds, dtypes, None, beta=beta)
    nominal = [c for c, k in kinds.items() if k == "nominal" or (k == "binary" and not beta)]
    parts = []
    if nominal:
        modes = P.smallest_modes(body, [c for c in nominal if kinds[c] == "binary"], "string")
        ready = body.select(*[
            F.coalesce(q(c).cast("string"), F.lit(modes[c])).alias(c) if c in modes else q(c) for c in nominal])
        parts.append(nominal_limits(ready, nominal))
        enc.fills |= modes
    whole = [c for c, k in kinds.items() if k == "ordinal"]
    if whole:
        parts.append(ordinal_limits(body, whole))
        enc.fills |= {c: v or 0 for c, v in P.smallest_modes(body, whole, "bigint").items()}
    for c in [c for c, k in kinds.items() if k == "binary" and beta]:
        zeros = binary_share(body, c)
        rows = [(c, 0, 0.0, zeros, "0", None)] * (zeros > 0) + [(c, 1, zeros, 1.0, "1", None)] * (zeros < 1)
        parts.append(df.sparkSession.createDataFrame(
            rows, "column string, ord bigint, lower double, upper double, category string, step double"))
        enc.fills[c] = zeros
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    enc.min_max = P.bounds_map(body, numbers) if numbers else {}
    enc.fills |= P.medians(body, numbers)
    if parts:
        enc.limits = materialize(reduce(DataFrame.unionByName, parts))
    return enc.settle()


def _cell(enc: UnitEncoder, col: str) -> Column:
    """The level of a value: text, with nulls to their fill, or a whole number within the fitted range."""
    kind = enc.kinds[col]
    if kind == "nominal":
        return F.coalesce(q(col).cast("string"), F.lit(MISSING))
    if kind == "binary":
        return F.coalesce(q(col).cast("string"), F.lit(enc.fills.get(col)))
    ends = enc.facts[col]
    whole = F.coalesce(q(col).cast("bigint"), F.lit(enc.fills[col]).cast("bigint"))
    return F.greatest(F.least(whole, F.lit(ends.high)), F.lit(ends.low))


def _whole_case(col: str, rows: list[tuple]) -> Column:
    """The listed interval (lower, upper, value) of the first listed whole number at or above ``col``."""
    listed = sorted((int(v), lo, hi) for v, lo, hi in rows)

    def branch(a: int, b: int) -> str:
        if a == b:
            v, lo, hi = listed[a]
            return f"named_struct('lower', {sql_literal(lo)}, 'upper', {sql_literal(hi)}, 'value', {sql_literal(v)})"
        mid = (a + b) // 2
        return f"if(`{col}` <= {sql_literal(listed[mid][0])}, {branch(a, mid)}, {branch(mid + 1, b)})"

    return F.expr(branch(0, len(listed) - 1))


def unit_encode(df: DataFrame, enc: UnitEncoder, seed: int, key: str) -> DataFrame:
    """Encode every column of ``enc``; unseen levels go to the most common or nearest one.

    Interval ends are inlined for few levels, joined or searched for many; a
    column decides for itself, and only beyond BROADCAST_LEVELS levels are rows
    shuffled. Unseen whole numbers within the fitted range have intervals of
    their own. The
    draws of all columns then share one projection. No job runs while planning.
    """
    names = df.columns
    drawn = [c for c in enc.cols if enc.kinds[c] in ("nominal", "ordinal") or (enc.kinds[c] == "binary" and not enc.beta)]
    inline = [c for c in drawn if enc.facts[c].n <= INLINE_LEVELS]
    at = {c: i for i, c in enumerate(drawn)}
    df = df.withColumns({f"_c{at[c]}": _cell(enc, c) for c in drawn})
    ends = {}
    for c in [c for c in drawn if enc.kinds[c] == "ordinal"]:
        i = at[c]
        if c in inline:
            df = df.withColumn("_at", _whole_case(f"_c{i}", enc.small[c]))
        else:
            mine = enc.limits.where(F.col("column") == c).select("lower", "upper", F.col("category").cast("bigint").alias("value"))
            df = ceiling_lookup(df, f"_c{i}", mine.withColumn("bound", F.col("value")), "bound", ["lower", "upper", "value"], "_at", BROADCAST_LEVELS)
        back, step = F.col("_at.value") - F.col(f"_c{i}"), F.lit(enc.facts[c].step)
        low = F.col("_at.lower") - back * step
        df = df.withColumns({f"_lo{i}": F.when(back == 0, F.col("_at.lower")).otherwise(low),
                             f"_hi{i}": F.when(back == 0, F.col("_at.upper")).otherwise(low + step)}).drop("_at")
    texts = [c for c in drawn if enc.kinds[c] != "ordinal"]
    for c in [c for c in texts if c in inline]:
        rows, i = enc.small[c], at[c]
        for j, name in ((1, "_lo"), (2, "_hi")):
            cases = " ".join(f"when {sql_literal(r[0])} then {sql_literal(r[j])}" for r in rows)
            ends[f"{name}{i}"] = F.expr(f"case `_c{i}` {cases} else {sql_literal(rows[0][j])} end")
    df = df.withColumns(ends | {
        f"_p{at[c]}": interval_probability(hash_uniform(seed, f"unit/{c}", key)) for c in drawn})
    for c in [c for c in texts if c not in inline]:
        i = at[c]
        mine = enc.limits.where(F.col("column") == c)
        first = enc.facts[c].first
        lookup = mine.select(F.col("category").alias(f"_c{i}"), F.col("lower").alias("_l"), F.col("upper").alias("_h"))
        if enc.facts[c].n <= BROADCAST_LEVELS:
            lookup = F.broadcast(lookup)
        df = (df.join(lookup, f"_c{i}", "left")
              .withColumns({f"_lo{i}": F.coalesce("_l", F.lit(first[0])), f"_hi{i}": F.coalesce("_h", F.lit(first[1]))})
              .drop("_l", "_h"))
    df = df.select(*[
        interval_normal(F.col(f"_lo{at[n]}"), F.col(f"_hi{at[n]}"), F.col(f"_p{at[n]}")).alias(n) if n in at else q(n)
        for n in names])
    for c in enc.cols:
        if enc.kinds[c] == "numeric":
            fill = enc.fills.get(c)
            df = encode_numeric(df, c, enc.min_max[c], sum(enc.min_max[c]) / 2 if fill is None else fill)
        elif enc.kinds[c] == "binary" and enc.beta:
            df = encode_binary_beta(df, c, seed, key, float(enc.fills[c]))
    return df


def unit_decode(df: DataFrame, enc: UnitEncoder) -> DataFrame:
    """Clip to [0, 1] and invert every column, restoring its type."""
    df = clip(df, 0.0, 1.0, [c for c in enc.cols if c in df.columns])
    for c in enc.cols:
        dtype = enc.dtypes.get(c, "string")
        if enc.kinds[c] == "numeric":
            lo, hi = enc.min_max[c]
            value = F.lit(hi - lo) * q(c) + F.lit(lo)
            df = df.withColumn(c, F.rint(value).cast("bigint") if c in enc.discrete else value)
            continue
        if c in enc.small and enc.facts[c].step is None:
            cat = decode_case(c, [(hi, v) for v, _, hi in enc.small[c]])
        else:
            names = df.columns
            mine = enc.limits.where(F.col("column") == c)
            df = decode_by_limits(df, mine, c, "_cat", BROADCAST_LEVELS)
            cat = F.col("_cat")
            df = df.select(*[cat.alias(c) if n == c else q(n) for n in names])
            cat = q(c)
        if dtype == "boolean":
            df = df.withColumn(c, cat.isin("true", "1"))
        elif dtype == "string":
            df = df.withColumn(c, F.when(cat != F.lit(MISSING), cat))
        else:
            df = df.withColumn(c, cat.cast(dtype))
    return df
