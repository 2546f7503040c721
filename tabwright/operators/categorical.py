"""Label and one-hot encoders."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.order import key_rank
from tabwright.operators import profile as P
from tabwright.operators.recode import READMITTED_BINARY, READMITTED_DAYS, encode_target, q
from tabwright.session import stored

INLINE_LEVELS = 48
BROADCAST_ROWS = 100_000


@dataclass
class LabelFit:
    """Level codes (column, value, number, code), how many each column has, and ``small``: those of columns with few."""

    families: dict[str, str]
    sizes: dict[str, int]
    small: dict[str, dict]
    table: DataFrame


def _family(df: DataFrame, col: str, order: str) -> str:
    if order != "native" or col not in P.numeric_cols(df):
        return "string"
    return "bigint" if df.schema[col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "double"


def _cell(col: str, family: str, order: str) -> Column:
    text = q(col).cast(family)
    return F.coalesce(text, F.lit("nan")) if family == "string" and order == "string" else text


def fit_labels(df: DataFrame, cols: list[str], order: str = "string") -> LabelFit:
    """Rank of each sorted distinct level, from 0. ``order`` sorts as text or by native type."""
    if order not in ("string", "native"):
        raise ValueError("order must be 'string' or 'native'")
    if not cols:
        return LabelFit({}, {}, {}, df.sparkSession.createDataFrame([], "column string, value string, number double, code bigint"))
    families = {c: _family(df, c, order) for c in cols}
    tables = []
    for family in ("string", "double", "bigint"):
        chosen = [c for c in cols if families[c] == family]
        if chosen:
            ready = df.select(*[_cell(c, family, order).alias(c) for c in chosen])
            ranked = key_rank(P.level_counts(ready, chosen, family).drop("n"), ["value"], "code", ["column"])
            tables.append(ranked.select("column", F.col("value").cast("string").alias("value"),
                                        F.col("value").cast("double").alias("number") if family == "double"
                                        else F.lit(None).cast("double").alias("number"),
                                        (F.col("code") - 1).alias("code")))
    table = reduce(DataFrame.unionByName, tables)
    table = stored(table)
    sizes = dict.fromkeys(cols, 0) | {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small: dict[str, dict] = {c: {} for c in cols if sizes[c] <= INLINE_LEVELS}
    for r in table.where(F.col("column").isin(*small)).collect() if small else []:
        family = families[r["column"]]
        small[r["column"]][r["number"] if family == "double" else int(r["value"]) if family == "bigint" else r["value"]] = r["code"]
    return LabelFit(families, sizes, small, table)


def apply_labels(df: DataFrame, fit: LabelFit, order: str = "string") -> DataFrame:
    """Replace each column by its codes: each column is inlined, joined to a broadcast or, beyond BROADCAST_ROWS levels, joined by shuffle."""
    names = df.columns
    for c, family in fit.families.items():
        cell = _cell(c, family, order)
        if c in fit.small:
            cases = [F.when(cell == F.lit(v), F.lit(k).cast("bigint")) for v, k in fit.small[c].items()]
            df = df.withColumn(c, F.coalesce(*cases) if cases else F.lit(None).cast("bigint"))
            continue
        value = F.col("number") if family == "double" else F.col("value").cast(family)
        lookup = fit.table.where(F.col("column") == c).select(value.alias("_v"), F.col("code").alias("_k"))
        if fit.sizes[c] <= BROADCAST_ROWS:
            lookup = F.broadcast(lookup)
        df = (df.withColumn("_v", cell).join(lookup, "_v", "left")
              .select(*[F.col("_k").alias(n) if n == c else q(n) for n in names]))
    return df


def label_encode(df: DataFrame, cols: list[str] | None = None, target: str | None = None,
                 order: str = "string") -> DataFrame:
    """Codes 0..k-1 by sorted level; without ``cols`` every text column but the target."""
    cols = [c for c in (cols or P.text_cols(df)) if c in df.columns and c != target]
    return apply_labels(df, fit_labels(df, cols, order), order) if cols else df


def ordinal_encode_all(df: DataFrame, order: str = "native") -> DataFrame:
    """Every column to the rank of its sorted distinct values."""
    return label_encode(df, list(df.columns), None, order)


def _free_name(name: str, taken: set) -> str:
    """``name``, or with the first number behind it that makes it new; it is then taken."""
    found, n = name, 1
    while found in taken:
        n += 1
        found = f"{name}__{n}"
    taken.add(found)
    return found


def one_hot(df: DataFrame, cols: list[str] | None = None, target: str | None = None,
            drop_first: bool = True, cast: str = "double", max_columns: int = 5000) -> DataFrame:
    """Named 0/1 columns per sorted level; null is all zeros; the target stays, last.

    A name that is already there gets ``__2``, ``__3``, ... behind it.

    A table can only hold so many columns: beyond ``max_columns`` levels this
    raises, and ``one_hot_vector`` gives the same features as sparse vectors.
    """
    cols = [c for c in (cols or P.text_cols(df)) if c != target]
    levels = P.bounded_levels(df, cols, max_columns)
    if levels is None:
        raise ValueError(f"more than {max_columns} levels; use one_hot_vector")
    kept = [c for c in df.columns if c not in cols and c != target]
    taken = {*kept, target}
    out = [q(c).cast(cast).alias(c) if cast == "double" and c in P.numeric_cols(df) else q(c) for c in kept]
    for c in cols:
        for v in levels[c][1:] if drop_first else levels[c]:
            out.append(F.coalesce((q(c).cast("string") == F.lit(v)).cast(cast), F.lit(0).cast(cast))
                       .alias(_free_name(f"{c}_{v}", taken)))
    if target:
        out.append(q(target))
    return df.select(*out)


def one_hot_vector(df: DataFrame, cols: list[str], drop_first: bool = True) -> DataFrame:
    """Sparse one-hot vectors ``<col>_vec`` for any number of levels."""
    codes = label_encode(df, cols)
    codes = codes.withColumns({
        f"{c}_idx": q(c).cast("double") for c in cols})
    if not drop_first:
        enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols],
                            dropLast=False)
        return enc.fit(codes).transform(codes)
    # the encoder drops the last category, so reverse the codes to drop the first
    top = P.wide_agg(codes, {c: F.max(q(c)) for c in cols})
    codes = codes.withColumns({f"{c}_idx": (F.lit(top[c]) - q(c)).cast("double") for c in cols})
    enc = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols])
    return enc.fit(codes).transform(codes)


def encode_categoricals(df: DataFrame, target: str, days: bool = False, hot: bool | str = False,
                        cols: list[str] | None = None, order: str = "string") -> DataFrame:
    """Recode the target to two or three classes, then label- or one-hot-encode the rest.

    ``hot="vector"`` gives one sparse vector ``<column>_vec`` a column in place
    of named columns, for any number of levels.
    """
    df = encode_target(df, target, READMITTED_DAYS if days else READMITTED_BINARY)
    if hot == "vector":
        chosen = [c for c in (cols or P.text_cols(df)) if c != target]
        kept = [c for c in df.columns if c not in chosen and c != target]
        return one_hot_vector(df, chosen).select(*map(q, kept), *[q(f"{c}_vec") for c in chosen], q(target))
    if hot:
        return one_hot(df, cols, target)
    return label_encode(df, cols, target, order)
