"""Row-wise recodes and predicates: expressions only, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.text import NUMBER_PATTERN

# The 23 medication columns of the clinical table.
DRUG_COLUMNS = (
    "metformin", "repaglinide", "nateglinide", "chlorpropamide", "glimepiride", "acetohexamide",
    "glipizide", "glyburide", "tolbutamide", "pioglitazone", "rosiglitazone", "acarbose", "miglitol",
    "troglitazone", "tolazamide", "examide", "citoglipton", "insulin", "glyburide-metformin",
    "glipizide-metformin", "glimepiride-pioglitazone", "metformin-rosiglitazone",
    "metformin-pioglitazone",
)
# Age buckets to three levels.
AGE_LEVELS = {
    "[0-10)": 1.0, "[10-20)": 1.0, "[20-30)": 1.0, "[30-40)": 1.0, "[40-50)": 1.0, "[50-60)": 1.0,
    "[60-70)": 1.5, "[70-80)": 1.5, "[80-90)": 2.0, "[90-100)": 2.0,
}
# Readmission classes, as two or three classes.
READMITTED_BINARY = {"NO": 0, ">30": 1, "<30": 1}
READMITTED_DAYS = {"NO": 0, ">30": 1, "<30": 2}
# Laboratory result levels.
LAB_LEVELS = {"Norm": 1, ">7": 2, ">8": 3}
# Diagnosis groups as (name, low, high, extra single code), in test order.
DIAGNOSIS_GROUPS = (
    ("Circulatory", 390, 459, 785),
    ("Respiratory", 460, 519, 786),
    ("Digestive", 520, 579, 787),
    ("Genitourinary", 580, 629, 788),
    ("Neoplasms", 140, 239, None),
    ("Musculoskeletal", 710, 739, None),
    ("Injury", 800, 999, None),
)


def q(name: str) -> Column:
    """Column by exact name, also when it holds dashes, dots or backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def drop_cols(df: DataFrame, cols) -> DataFrame:
    """Drop columns, ignoring names that are not there."""
    return df.drop(*cols)


def keep_present(df: DataFrame, col: str) -> DataFrame:
    return df.where(q(col).isNotNull())


def features_target(df: DataFrame, target: str) -> tuple[list[str], DataFrame]:
    """Feature names and a frame with the target last; the target must exist."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    features = [c for c in df.columns if c != target]
    return features, df.select(*map(q, features), q(target))


def map_values(col: Column, mapping: dict) -> Column:
    """Literal lookup; values outside the mapping become null."""
    cases = [F.when(col == F.lit(k), F.lit(v)) for k, v in mapping.items()]
    return F.coalesce(*cases)


def recode(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    return df.withColumn(col, map_values(q(col), mapping)) if col in df.columns else df


def encode_target(df: DataFrame, col: str, mapping: dict | None = None) -> DataFrame:
    return recode(df, col, mapping or READMITTED_BINARY)


def binary_flags(df: DataFrame, cols=DRUG_COLUMNS, off: str = "No") -> DataFrame:
    """0 where the value equals ``off``, else 1; null counts as 1."""
    return df.withColumns({
        c: F.when(q(c).eqNullSafe(F.lit(off)), 0).otherwise(1) for c in cols if c in df.columns})


def icd9_group(code: Column) -> Column:
    """Nine diagnosis groups from an ICD-9 code."""
    text = F.trim(code)
    value = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    out = F.when(text.isNull(), "Other").when(text.startswith("250"), "Diabetes")
    out = out.when(text.startswith("E") | text.startswith("V") | value.isNull(), "Other")
    for name, low, high, single in DIAGNOSIS_GROUPS:
        inside = value.between(low, high)
        out = out.when(inside if single is None else inside | (value == single), name)
    return out.otherwise("Other")


def icd9_prefix(code: Column) -> Column:
    """First three characters, zero-padded to three, cut to two."""
    return F.substring(F.lpad(F.substring(code, 1, 3), 3, "0"), 1, 2)


def lab_ordinal(df: DataFrame, col: str) -> DataFrame:
    """Missing result to 0, known levels to 1..3, anything else null."""
    if col not in df.columns:
        return df
    return df.withColumn(col, F.when(q(col).isNull(), 0).otherwise(map_values(q(col), LAB_LEVELS)))


def fix_negative(df: DataFrame, col: str, value: float = 90) -> DataFrame:
    return df.withColumn(col, F.when(q(col) < 0, F.lit(value)).otherwise(q(col)))


def clip(df: DataFrame, lo: float = 0.0, hi: float = 1.0, cols: list[str] | None = None) -> DataFrame:
    """Bound numeric columns; nulls stay null."""
    cols = cols or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.withColumns({
        c: F.when(q(c).isNotNull(), F.greatest(F.least(q(c), F.lit(hi)), F.lit(lo))) for c in cols})


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim header names and text cells; the texts 'None' and 'nan' become null."""
    df = df.toDF(*[c.strip() for c in df.columns])
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({
        c: F.when(~F.trim(q(c)).isin("None", "nan"), F.trim(q(c))) for c in texts})


def binarize(score: Column, threshold: float = 0.5) -> Column:
    return (score >= F.lit(threshold)).cast("int")


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
