"""Scalers and imputers: fit to a small dict, apply as expressions."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators import profile as P
from tabwright.operators.categorical import apply_labels, fit_labels, one_hot_vector
from tabwright.operators.recode import q
from tabwright.session import materialize, stored

# ---------------------------------------------------------------- scaling


def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column."""
    aggs = {}
    for c in cols:
        aggs[(c, 0)], aggs[(c, 1)] = F.avg(q(c)), F.stddev_pop(q(c).cast("double"))
    got = P.wide_agg(df, aggs)
    return {c: (got[(c, 0)], got[(c, 1)]) for c in cols}


def standardize(df: DataFrame, cols: list[str], fitted: dict | None = None) -> DataFrame:
    """(x - mean) / population deviation; constant columns become 0. Refits when no fit is given."""
    fitted = fitted or fit_standard(df, cols)
    return df.withColumns({
        c: (q(c) - F.lit(m)) / F.lit(s) if s else q(c) * F.lit(0.0) for c, (m, s) in fitted.items()})


def normalize(df: DataFrame, cols: list[str], fitted: dict | None = None) -> DataFrame:
    """(x - min) / (max - min); constant columns become 0."""
    fitted = fitted or P.bounds_map(df, cols)
    return df.withColumns({
        c: (q(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0) for c, (lo, hi) in fitted.items()})


def denormalize(df: DataFrame, fitted: dict[str, tuple[float, float]], half_steps=("age",)) -> DataFrame:
    """Clip to [0, 1], undo min-max, half steps for ``half_steps``, whole numbers between whole bounds."""
    out = {}
    for c, (lo, hi) in fitted.items():
        x = F.greatest(F.least(q(c), F.lit(1.0)), F.lit(0.0)) * F.lit(hi - lo) + F.lit(lo)
        if lo != hi and c in half_steps:
            x = F.rint(x * 2) / 2
        elif lo != hi and float(lo).is_integer() and float(hi).is_integer():
            x = F.greatest(F.least(F.rint(x), F.lit(hi)), F.lit(lo)).cast("bigint")
        out[c] = x
    return df.withColumns(out)


def undo_numeric(x, lo: float, hi: float, discrete: bool = False):
    """Inverse min-max of one value, optionally rounded to whole numbers."""
    value = F.lit(hi - lo) * x + F.lit(lo)
    return F.rint(value).cast("bigint") if discrete else value


# ---------------------------------------------------------------- imputation


def fit_fill(df: DataFrame, num: str = "mean", cat: str = "mode", approx: bool = False,
             cols: list[str] | None = None) -> dict:
    """Fill values: text mode (smallest on ties) or 'missing'; numeric mean, median or zero."""
    cols = cols or df.columns
    texts = [c for c in P.text_cols(df) if c in cols]
    nums = [c for c in P.numeric_cols(df) if c in cols]
    if cat == "mode":
        fills = {c: "missing" if m is None else m for c, m in P.smallest_modes(df, texts, "string").items()}
    else:
        fills = dict.fromkeys(texts, "missing")
    if num == "mean":
        fills |= P.wide_agg(df, {c: F.avg(q(c)) for c in nums}) if nums else {}
    elif num == "median":
        fills |= P.medians(df, nums, approx)
    else:
        fills |= dict.fromkeys(nums, 0.0)
    return {c: v for c, v in fills.items() if v is not None}


def apply_fill(df: DataFrame, fills: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(q(c), F.lit(v)) for c, v in fills.items() if c in df.columns})


def impute(df: DataFrame, num: str = "mean", fills: dict | None = None, approx: bool = False) -> DataFrame:
    return apply_fill(df, fills if fills is not None else fit_fill(df, num, approx=approx))


def clean(df: DataFrame, drop_thresh: float = 0.5, num: str = "median", cat: str = "mode") -> DataFrame:
    """Strip names, drop duplicate rows and mostly-missing columns, trim text, fill what is left."""
    df = stored(df.toDF(*[c.strip() for c in df.columns]).dropDuplicates())  # read by every fit below
    share = P.wide_agg(df, {c: F.avg(q(c).isNull().cast("double")) for c in df.columns})
    df = df.drop(*[c for c, s in share.items() if s is not None and s > drop_thresh])
    texts = P.text_cols(df)
    df = df.withColumns({c: F.when(~F.trim(q(c)).isin("None", "nan"), F.trim(q(c))) for c in texts})
    return apply_fill(df, fit_fill(df, num, cat))


def _complete_predictors(df: DataFrame, col: str, key: str) -> list[str]:
    """Columns without a null in the rows to impute."""
    others = [c for c in df.columns if c not in (col, key)]
    got = P.wide_agg(df.where(q(col).isNull()), {c: F.count_if(q(c).isNull()) for c in others})
    return [c for c in others if not got[c]]


def _usable(df: DataFrame, col: str, key: str) -> tuple[DataFrame, list[str], list[str]]:
    """Rows complete in the usable predictors, and the numeric and text ones among them."""
    use = _complete_predictors(df, col, key)
    keep = F.lit(True)
    for c in use:
        keep = keep & q(c).isNotNull()
    numeric, text = P.numeric_cols(df), P.text_cols(df)
    return df.where(keep), [c for c in use if c in numeric], [c for c in use if c in text]


def _mixed_design(df: DataFrame, col: str, key: str) -> tuple[DataFrame, int]:
    """(key, _y, vec) for distances and how many places of ``vec``, the last ones, are level codes.

    Numbers are as they are and a text is one code, however many levels there
    are; the search counts a differing code as two unlike one-hot places.
    """
    rows, nums, texts = _usable(df, col, key)
    names = [f"_t{i}" for i in range(len(texts))]
    coded = rows.select(key, q(col).alias("_y"), *[q(c).cast("double").alias(f"_n{i}") for i, c in enumerate(nums)],
                        *[q(c).alias(n) for n, c in zip(names, texts)])
    if texts:
        coded = apply_labels(coded, fit_labels(coded, names))
    places = [F.col(f"_n{i}") for i in range(len(nums))] + [q(n).cast("double") for n in names]
    return coded.select(key, "_y", F.array(*places).cast("array<double>").alias("vec")), len(names)


def impute_regress(df: DataFrame, col: str, key: str) -> DataFrame:
    """Fill a numeric column from a linear regression on the columns complete where it is missing.

    Text predictors enter as sparse one-hot vectors, whatever their number of levels.
    """
    rows, nums, texts = _usable(df, col, key)
    rows = rows.select(key, q(col).cast("double").alias("_y"), *[q(c).cast("double").alias(f"_n{i}") for i, c in enumerate(nums)],
                       *[q(c).alias(f"_t{i}") for i, c in enumerate(texts)])
    inputs = [f"_n{i}" for i in range(len(nums))]
    if texts:
        names = [f"_t{i}" for i in range(len(texts))]
        rows = one_hot_vector(rows, names, drop_first=False)
        inputs += [f"{n}_vec" for n in names]
    ready = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows).select(key, "_y", "features")
    model = LinearRegression(labelCol="_y").fit(ready.where("_y is not null"))
    guess = model.transform(ready.where("_y is null")).select(key, F.col("prediction").alias("_g"))
    return df.join(guess, key, "left").select(
        *[F.coalesce(q(c), F.col("_g")).alias(c) if c == col else q(c) for c in df.columns])


def impute_knn(df: DataFrame, col: str, key: str, k: int = 3, features: list[str] | None = None) -> DataFrame:
    """Fill a text column by a distance-weighted vote of the k nearest complete rows.

    Distances are over ``features``, all numbers, or over all columns that are
    complete where ``col`` is missing, numbers and texts.
    """
    from tabwright.operators.knn import knn

    codes = 0
    if features:
        design = df.select(key, q(col).alias("_y"), F.array(*[q(c).cast("double") for c in features]).alias("vec"))
    else:
        design, codes = _mixed_design(df, col, key)
    vec = design.select(F.col(key).alias("id"), "_y", "vec")
    known = vec.where("_y is not null")
    near = knn(vec.where("_y is null").select("id", "vec"), known.select("id", "vec"), k, codes=codes)
    votes = near.join(known.select(F.col("id").alias("s_id"), "_y"), "s_id")
    exact = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("t_id"))
    weight = F.when(exact == 1, (F.col("dist") == 0).cast("double")).otherwise(
        F.lit(1.0) / F.when(F.col("dist") > 0, F.col("dist")))
    tally = votes.withColumn("_w", weight).groupBy("t_id", "_y").agg(F.sum("_w").alias("_w"))
    top = Window.partitionBy("t_id").orderBy(F.desc("_w"), F.col("_y"))
    guess = (tally.withColumn("_r", F.row_number().over(top)).where("_r = 1")
             .select(F.col("t_id").alias(key), F.col("_y").alias("_g")))
    return df.join(guess, key, "left").select(
        *[F.coalesce(q(c), F.col("_g")).alias(c) if c == col else q(c) for c in df.columns])


def least_missing(df: DataFrame, cols: list[str] | None = None) -> str | None:
    """The column with the fewest nulls among those that have any, the first of several; None if none has."""
    cols = cols or df.columns
    nulls = P.wide_agg(df, {c: F.count_if(q(c).isNull()) for c in cols})
    return min((c for c in cols if nulls[c]), key=lambda c: nulls[c], default=None)


def impute_chain(df: DataFrame, key: str, ignored: list[str] | None = None) -> DataFrame:
    """Impute column after column, fewest nulls first, until none is missing.

    ``ignored`` columns take no part and are joined back at the end.
    """
    ignored = [c for c in ignored or [] if c in df.columns and c != key]
    core = df.drop(*ignored)
    while col := least_missing(core, [c for c in core.columns if c != key]):
        numeric = isinstance(core.schema[col].dataType, T.NumericType)
        core = materialize(impute_regress(core, col, key) if numeric else impute_knn(core, col, key))
    return core.join(df.select(key, *map(q, ignored)), key) if ignored else core
