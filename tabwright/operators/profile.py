"""Profiles: counts, missingness, variance screens, contracts and table comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.order import exact_medians
from tabwright.functions.text import number_or_null
from tabwright.session import bounded_rows, stored

AGG_CHUNK = 150
SUPPORT_LEVELS = 25
INLINE_LEVELS = 1000
CURVE_BINS = 1 << 20


def q(name: str) -> Column:
    """Column by exact name, also when it holds dots or backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def wide_agg(df: DataFrame, aggs: dict[str, Column]) -> dict:
    """One aggregate row over many columns, in chunks small enough for code generation."""
    names, out = list(aggs), {}
    for i in range(0, len(names), AGG_CHUNK):
        chunk = names[i:i + AGG_CHUNK]
        row = df.agg(*[aggs[n].alias(f"a{j}") for j, n in enumerate(chunk)]).first()
        out.update(zip(chunk, row))
    return out


def column_facts(df: DataFrame, cells: dict[str, Column], value: str, whole: dict[str, Column] | None = None) -> DataFrame:
    """(``whole`` names, column, ``value``): one aggregate of every column as one row each, whatever the columns are called."""
    whole = whole or {}
    at = [f"_cell{i}" for i in range(len(cells))]
    one = df.agg(*[x.alias(n) for n, x in whole.items()], *[x.alias(n) for n, x in zip(at, cells.values())])
    place = F.substring("column", len("_cell") + 1, 10).cast("int")
    return one.unpivot(list(whole), at, "column", value).withColumn("column", F.get(F.array(*map(F.lit, cells)), place))


def stack_values(df: DataFrame, cols: list[str], dtype: str, keep: list[str] | None = None) -> DataFrame:
    """Long form (column, value); nulls are kept."""
    cast = df.select(*[q(k) for k in keep or []], *[q(c).cast(dtype).alias(c) for c in cols])
    return cast.unpivot([q(k) for k in keep or []], [q(c) for c in cols], "column", "value")


def level_counts(df: DataFrame, cols: list[str], dtype: str = "string",
                 keep: list[str] | None = None) -> DataFrame:
    """(column, value, n) for every non-null level; counts combine before the shuffle."""
    return (stack_values(df, cols, dtype, keep).where(F.col("value").isNotNull())
            .groupBy(*(keep or []), "column", "value").agg(F.count(F.lit(1)).alias("n")))


def smallest_modes(df: DataFrame, cols: list[str], dtype: str) -> dict:
    """Most frequent value of each column, ties to the smallest."""
    if not cols:
        return {}
    counts = stored(level_counts(df, cols, dtype))
    best = counts.groupBy("column").agg(F.max("n").alias("n"))
    rows = counts.join(F.broadcast(best), ["column", "n"]).groupBy("column").agg(F.min("value").alias("v"))
    found = {r["column"]: r["v"] for r in rows.collect()}
    return {c: found.get(c) for c in cols}


def value_counts(df: DataFrame, col: str, normalize: bool = False, keep_null: bool = False) -> DataFrame:
    rows = df if keep_null else df.where(q(col).isNotNull())
    counts = rows.groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def missing_report(df: DataFrame, top: int | None = 10) -> DataFrame:
    """Null count and percentage of each column with nulls, largest first."""
    nulls = {c: F.count_if(q(c).isNull()) for c in df.columns}
    long = column_facts(df, nulls, "n_missing", {"_rows": F.count(F.lit(1))}).where("n_missing > 0")
    out = long.select("column", "n_missing", (F.col("n_missing") * 100.0 / F.col("_rows")).alias("pct_missing"))
    out = out.orderBy(F.desc("n_missing"), "column")
    return out.limit(top) if top else out


def summarize(df: DataFrame) -> DataFrame:
    """One row per column: position, type, row count and null count."""
    nulls = {c: F.count_if(q(c).isNull()) for c in df.columns}
    long = column_facts(df, nulls, "n_missing", {"n_rows": F.count(F.lit(1))})
    names = F.array(*[F.lit(c) for c in df.columns])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema])
    pos = F.array_position(names, F.col("column")).cast("int")
    return long.select("column", pos.alias("position"), F.element_at(types, pos).alias("dtype"),
                       "n_rows", "n_missing")


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_unique, has_null): distinct levels counted from pre-aggregated values."""
    long = stack_values(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy("column").agg(
        F.count("value").alias("n_unique"), F.max(F.col("value").isNull().cast("int")).alias("has_null"))


def zero_variance(df: DataFrame) -> DataFrame:
    """Columns with at most one level, null counting as a level.

    min = max decides it in one pass with no distinct count.
    """
    same = {c: F.coalesce((F.min(q(c)) == F.max(q(c))) & (F.count_if(q(c).isNull()) == 0), F.count(q(c)) == 0) for c in df.columns}
    return column_facts(df, same, "is_constant").where("is_constant").select("column")


def near_zero_variance(df: DataFrame, freq_ratio: float = 20.0, unique_pct: float = 10.0) -> DataFrame:
    """Distinct count, top two level counts and their ratio; ratio null stands for 'no second level'."""
    counts = stored(level_counts(df, list(df.columns)))
    per = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("top_count"),
        F.max_by("value", F.struct("n", "value")).alias("_top"))
    second = (counts.join(F.broadcast(per.select("column", "_top")), "column")
              .where(F.col("value") != F.col("_top")).groupBy("column").agg(F.max("n").alias("second_count")))
    size = df.agg(F.count(F.lit(1)).alias("size")).scalar()
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    out = (names.join(F.broadcast(per), "column", "left").join(F.broadcast(second), "column", "left")
           .na.fill(0, ["n_unique", "top_count", "second_count"]))
    ratio = F.when(F.col("second_count") > 0, F.col("top_count") / F.col("second_count"))
    pct = F.col("n_unique") * 100.0 / size
    return out.select(
        "column", "n_unique", pct.alias("unique_pct"), "top_count", "second_count",
        ratio.alias("freq_ratio"),
        ((ratio.isNull() | (ratio >= freq_ratio)) & (pct <= unique_pct)).alias("is_nzv"))


def variance_screen(df: DataFrame, threshold: float = 0.0, fill: float | None = 0.0) -> DataFrame:
    """Population variance per numeric column and whether it exceeds the threshold."""
    cols = numeric_cols(df)

    def cell(c: str) -> Column:
        x = q(c).cast("double")
        return x if fill is None else F.coalesce(x, F.lit(float(fill)))

    return column_facts(df, {c: F.var_pop(cell(c)) for c in cols}, "variance").withColumn("kept", F.col("variance") > F.lit(threshold))


def numeric_zero_variance(df: DataFrame) -> DataFrame:
    return variance_screen(df).where("not kept").select("column")


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows whose rounded target is 0 and 1."""
    label = F.rint(q(target).cast("double"))
    return df.agg(F.count_if(label == 0).alias("n_class_0"), F.count_if(label == 1).alias("n_class_1"))


def bounds(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """min, max and range per numeric column; a zero range is reported as 1."""
    cols = cols or numeric_cols(df)
    long = column_facts(df, {c: F.struct(F.min(q(c)).cast("double").alias("lo"), F.max(q(c)).cast("double").alias("hi")) for c in cols}, "b")
    span = F.col("b.hi") - F.col("b.lo")
    return long.select("column", F.col("b.lo").alias("min"), F.col("b.hi").alias("max"),
                       F.when(span == 0, 1.0).otherwise(span).alias("range"))


def bounds_map(df: DataFrame, cols: list[str] | None = None) -> dict[str, tuple[float, float]]:
    return {r["column"]: (r["min"], r["max"]) for r in bounds(df, cols).collect()}


def feature_distribution(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Mean and population deviation per column, or count and share of ones for two-level columns.

    Both shares divide by the number of real rows.
    """
    cols = numeric_cols(real)

    def side(df: DataFrame, tag: str) -> DataFrame:
        cells = {c: F.struct(F.avg(q(c)).alias("mean"), F.stddev_pop(q(c).cast("double")).alias("sd"), F.count_if(q(c) == 1).alias("ones")) for c in cols}
        return column_facts(df, cells, tag, {f"{tag}_rows": F.count(F.lit(1))})

    levels = distinct_counts(real, cols).select("column", (F.col("n_unique") + F.col("has_null") > 2).alias("wide"))
    both = (side(real, "r").join(side(synthetic, "s"), "column").join(F.broadcast(levels), "column"))

    def pair(tag: str) -> list[Column]:
        return [
            F.when(F.col("wide"), F.col(f"{tag}.mean")).otherwise(F.col(f"{tag}.ones").cast("double")),
            F.when(F.col("wide"), F.col(f"{tag}.sd")).otherwise(F.col(f"{tag}.ones") / F.col("r_rows")),
        ]

    s0, s1 = pair("s")
    r0, r1 = pair("r")
    return both.select("column", s0.alias("synthetic_level"), s1.alias("synthetic_spread"),
                       r0.alias("real_level"), r1.alias("real_spread"))


def rounded_entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """Natural-log entropy of each column after rounding half to even."""
    rounded = df.select(*[F.rint(q(c).cast("double")).alias(c) for c in cols])
    counts = level_counts(rounded, cols, "double")
    n = F.col("n").cast("double")
    return counts.groupBy("column").agg(
        (F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias("entropy"))


def kde_curve(df: DataFrame, col: str, points: int = 64, by: str | None = None) -> DataFrame:
    """Gaussian density on an even grid half a range beyond the data, Scott bandwidth.

    Exact: distinct values are weighted first and each spreads over the grid, so
    the work grows with them; ``binned_curves`` has a bound.
    """
    keep = [by] if by else []
    rows = df.where(q(col).isNotNull()).select(*keep, q(col).cast("double").alias("x"))
    stats = rows.groupBy(*keep).agg(
        F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    h = F.when(F.col("sd") > 0, F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))  # a constant column has no curve: null
    span = F.col("hi") - F.col("lo")
    start = F.col("lo") - span * 0.5
    step = span * 2.0 / (points - 1)
    stats = stats.select(*keep, F.col("n").alias("_n"), h.alias("_h"), start.alias("_start"), step.alias("_step"))
    weighted = rows.groupBy(*keep, "x").agg(F.count(F.lit(1)).alias("w"))
    if keep:
        few = bounded_rows(stats, INLINE_LEVELS)
        known = F.broadcast(df.sparkSession.createDataFrame(few, stats.schema)) if few is not None else stats
        joined = weighted.join(known, keep)
    else:
        joined = weighted.withColumns({c: F.lit(v) for c, v in stats.first().asDict().items()})
    grid = joined.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.col("_start") + F.col("i") * F.col("_step")
    z = (at - F.col("x")) / F.col("_h")
    return (grid.groupBy(*keep, "i")
            .agg(F.first(at).alias("x"),
                 (F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.first(F.col("_n") * F.col("_h") * 2.5066282746310002))
                 .alias("density")))


def binned_curves(df: DataFrame, cols: list[str], points: int = 64, by: str | None = None) -> DataFrame:
    """(by, column, i, x, density): Gaussian densities of all columns from linearly binned values, Scott bandwidth.

    The grid is that of ``kde_curve``. One pass splits each value between the two
    nearest of at least 16 bins a bandwidth (2^20 bins at most), so what follows
    depends on the bins and not on how many values differ. With bins of width d
    the curve is within d^2 / (8 h^3 sqrt(2 pi)) of the exact one, below 0.0005
    of a single kernel's peak unless 2^20 bins are too few. Constant columns
    have null densities; columns without values have no rows.
    """
    keep = [by] if by else []
    rows = stack_values(df, cols, "double", keep).where(F.col("value").isNotNull())
    groups = [*keep, "column"]
    stats = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("value").alias("_sd"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    h = F.when(F.col("_sd") > 0, F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    span = F.col("_hi") - F.col("_lo")
    bins = F.least(F.lit(float(CURVE_BINS)), F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.lit(16.0) * span / h)), F.lit(0))))
    stats = stats.select(*groups, "_n", "_lo", h.alias("_h"), (span / F.coalesce(bins, F.lit(1.0))).alias("_d"),
                         (F.col("_lo") - span * 0.5).alias("_start"), (span * 2.0 / (points - 1)).alias("_step"))
    stats = stored(stats)
    few = bounded_rows(stats, INLINE_LEVELS)
    known = F.broadcast(df.sparkSession.createDataFrame(few, stats.schema)) if few is not None else stats
    place = F.when(F.col("_d") > 0, (F.col("value") - F.col("_lo")) / F.col("_d")).otherwise(0.0)
    left = rows.join(known, groups).withColumn("_p", place).withColumn("_b", F.floor("_p"))
    share = F.col("_p") - F.col("_b")
    binned = left.groupBy(*groups, "_b").agg(F.sum(1 - share).alias("_w0"), F.sum(share).alias("_w1"))
    both = F.array(F.struct(F.col("_b"), F.col("_w0").alias("w")), F.struct((F.col("_b") + 1).alias("_b"), F.col("_w1").alias("w")))
    spots = binned.select(*groups, F.explode(both).alias("s")).where("s.w > 0").select(*groups, "s.*")
    grid = spots.join(known, groups).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.col("_start") + F.col("i") * F.col("_step")
    z = (at - (F.col("_lo") + F.col("_b") * F.col("_d"))) / F.col("_h")
    return grid.groupBy(*groups, "i").agg(
        F.first(at).alias("x"),
        (F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.first(F.col("_n") * F.col("_h") * 2.5066282746310002)).alias("density"))


def many_valued(df: DataFrame, cols: list[str], limit: int = 10) -> list[str]:
    """The columns with more than ``limit`` distinct numbers; sketches settle most, exact counts the doubtful ones."""
    rough = wide_agg(df, {c: F.approx_count_distinct(q(c).cast("double"), 0.02) for c in cols})
    doubt = [c for c in cols if limit / 2 < rough[c] <= 3 * limit]
    exact = {r["column"]: r["n"] for r in level_counts(df, doubt, "double").groupBy("column").agg(
        F.count(F.lit(1)).alias("n")).collect()} if doubt else {}
    return [c for c in cols if exact.get(c, rough[c]) > limit]


def compare_values(a: DataFrame, b: DataFrame, cols: list[str], points: int = 64, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Two tables side by side: (curves, shares).

    Numeric columns with more than ``limit`` distinct values in ``a`` get a
    density curve of each table, (side, column, i, x, density) with side ``a`` or
    ``b``; all others get ``value_shares``.
    """
    curved = many_valued(a, [c for c in cols if c in numeric_cols(a)], limit)
    both = a.select(F.lit("a").alias("side"), *map(q, curved)).unionByName(b.select(F.lit("b").alias("side"), *map(q, curved)))
    curves = binned_curves(both, curved, points, by="side") if curved else a.sparkSession.createDataFrame(
        [], "side string, column string, i int, x double, density double")
    return curves, value_shares(a, b, [c for c in cols if c not in curved])


def value_shares(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """Shares of every text level of every column in two tables, side by side; null is the level ``nan``, absent is 0."""
    tagged = stack_values(a, cols, "string").withColumn("_a", F.lit(1)).unionByName(
        stack_values(b, cols, "string").withColumn("_a", F.lit(0)))
    counts = tagged.groupBy("column", F.coalesce("value", F.lit("nan")).alias("value")).agg(
        F.sum("_a").alias("n_a"), F.sum(1 - F.col("_a")).alias("n_b"))
    totals = counts.groupBy("column").agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value",
        F.when(F.col("t_a") > 0, F.col("n_a") / F.col("t_a")).otherwise(0.0).alias("share_a"),
        F.when(F.col("t_b") > 0, F.col("n_b") / F.col("t_b")).otherwise(0.0).alias("share_b"))


# ---------------------------------------------------------------- contracts


@dataclass
class ColumnContract:
    """What one column of the source table allows."""

    name: str
    dtype: str
    is_numeric: bool
    min: float | None = None
    max: float | None = None
    integer_coded: bool = False
    support: list[float] | None = None
    categories: list[str] | None = None
    mode: object = None
    n_levels: int = 0


@dataclass
class Contract:
    """Column contracts in table order. Levels too many to inline stay in ``levels``."""

    target: str
    columns: list[ColumnContract] = field(default_factory=list)
    levels: DataFrame | None = None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def table(self, spark) -> DataFrame:
        """The contract as a frame with one row per column, every category included."""
        rows = [(c.name, c.dtype, c.is_numeric, c.min, c.max, c.integer_coded, c.support, c.categories,
                 None if c.mode is None else str(c.mode), c.n_levels)
                for c in self.columns]
        table = spark.createDataFrame(
            rows, "column string, dtype string, is_numeric boolean, min double, max double, "
                  "integer_coded boolean, support array<double>, categories array<string>, "
                  "mode string, n_levels bigint")
        long = [c.name for c in self.columns if not c.is_numeric and c.categories is None]
        if not long:
            return table
        listed = self.levels.where(F.col("column").isin(*long)).groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("listed"))
        order = {c: i for i, c in enumerate(self.names)}
        full = table.join(listed, "column", "left").withColumn("categories", F.coalesce("categories", "listed")).drop("listed")
        return full.orderBy(F.array_position(F.array(*map(F.lit, order)), F.col("column"))).select(table.columns)


def is_whole(x: Column) -> Column:
    """x equals its rounding within 1e-8 + 1e-5 times the rounding's size."""
    return F.abs(x - F.rint(x)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(x))


def profile_contract(df: DataFrame, target: str) -> Contract:
    """Type, bounds, integer coding, small supports, sorted categories and smallest mode per column.

    One wide aggregate for bounds, one grouping per type family for levels.
    Only a column's own level summary reaches the driver; long category lists
    stay distributed in ``levels``.
    """
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema}
    nums = numeric_cols(df)
    texts = [c for c in df.columns if c not in nums]
    aggs = {}
    for c in nums:
        x = q(c).cast("double")
        aggs[(c, "min")], aggs[(c, "max")] = F.min(x), F.max(x)
        aggs[(c, "whole")] = F.bool_and(is_whole(x))
    facts = wide_agg(df, aggs) if aggs else {}
    summary: dict[str, tuple] = {}
    inline: dict[str, list] = {}
    levels = None
    for cols, dtype, keep_upto in ((nums, "double", SUPPORT_LEVELS), (texts, "string", INLINE_LEVELS)):
        if not cols:
            continue
        counts = stored(level_counts(df, cols, dtype))  # read by the summaries here and by every later user of the levels
        best = F.struct(F.col("n"))
        per = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.max(best)["n"].alias("top"))
        modes = (counts.join(F.broadcast(per), "column")
                 .groupBy("column").agg(
                     F.first("k").alias("k"),
                     F.min(F.when(F.col("n") == F.col("top"), F.col("value"))).alias("mode")))
        for r in modes.collect():
            summary[r["column"]] = (r["k"], r["mode"])
        small = [c for c in cols if c in summary and summary[c][0] <= keep_upto]
        if small:
            got = counts.where(F.col("column").isin(*small)).select("column", "value").collect()
            for r in got:
                inline.setdefault(r["column"], []).append(r["value"])
        if dtype == "string":
            levels = counts
    out = Contract(target=target, levels=levels)
    for c in df.columns:
        k, mode = summary.get(c, (0, None))
        values = sorted(inline[c]) if c in inline else None
        if c in nums:
            out.columns.append(ColumnContract(
                c, dtypes[c], True, facts[(c, "min")], facts[(c, "max")],
                bool(facts[(c, "whole")]), values, None, mode, k))
        else:
            out.columns.append(ColumnContract(
                c, dtypes[c], False, categories=values if values is not None else ([] if k == 0 else None),
                mode=mode, n_levels=k))
    return out


def validate(df: DataFrame, contract: Contract, expected_rows: int | None = None,
             raise_on_error: bool = False) -> DataFrame:
    """(rule, column, n_violations) for every contract rule, from one aggregate over the table."""
    spark = df.sparkSession
    rules: dict[tuple[str, str], Column] = {}
    present = set(df.columns)
    for c in contract.columns:
        if c.name not in present:
            continue
        col = q(c.name)
        rules[("not_null", c.name)] = F.count_if(col.isNull())
        if c.name == contract.target:
            label = number_or_null(col.cast("string"))
            rules[("binary_target", c.name)] = F.count_if(~label.cast("bigint").isin(0, 1))
        if c.is_numeric:
            x = number_or_null(col.cast("string"))
            rules[("numeric", c.name)] = F.count_if(x.isNull())
            if c.min is not None:
                rules[("min", c.name)] = F.count_if(x < F.lit(c.min))
                rules[("max", c.name)] = F.count_if(x > F.lit(c.max))
            if c.integer_coded:
                rules[("integer_coded", c.name)] = F.count_if(~is_whole(x))
    rules[("row_count", "")] = F.count(F.lit(1))
    got = wide_agg(df, rules)
    rows_seen = got.pop(("row_count", ""))
    out = [("column_order", "", 0 if list(df.columns) == contract.names else 1)]
    if expected_rows is not None:
        out.append(("row_count", "", abs(rows_seen - expected_rows)))
    out += [(rule, col, int(n)) for (rule, col), n in got.items()]
    bad = [r for r in out if r[2]]
    if raise_on_error and bad:
        raise ValueError(f"contract violations: {bad}")
    return spark.createDataFrame(out, "rule string, column string, n_violations bigint")


def medians(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, float | None]:
    """Interpolated medians, exact or from a sketch."""
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(q(c).cast("double"), 0.5).alias(f"m{i}") for i, c in enumerate(cols)])
        return dict(zip(cols, row.first()))
    return exact_medians(df.select(*[q(c).alias(c) for c in cols]), cols)


def table_roundtrip(original: DataFrame, restored: DataFrame, key: str) -> DataFrame:
    """Cells that differ after an encode/decode round trip, per column (nulls equal)."""
    cols = [c for c in original.columns if c != key]
    a, b = (df.select(q(key).alias("_key"), *[q(c).alias(f"_{tag}{i}") for i, c in enumerate(cols)]) for df, tag in ((original, "a"), (restored, "b")))
    differ = {c: F.count_if(~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))) for i, c in enumerate(cols)}
    return column_facts(a.join(b, "_key"), differ, "n_different")


def bounded_levels(df: DataFrame, cols: list[str], limit: int) -> dict[str, list] | None:
    """Levels of each column as text if all of them together fit ``limit`` rows, else None; numbers sort as numbers."""
    rows = bounded_rows(level_counts(df, cols).select("column", "value"), limit)
    if rows is None:
        return None
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append(r["value"])
    numbers = numeric_cols(df)
    return {c: sorted(v, key=float) if c in numbers else sorted(v) for c, v in out.items()}
