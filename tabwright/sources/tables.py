"""CSV and parquet scans and sinks, column groups and type assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.text import NA_TOKENS, null_tokens
from tabwright.operators.recode import DRUG_COLUMNS, q

# Column groups of the clinical table.
COLUMN_GROUPS = {
    "basic": ("race", "gender", "age", "weight", "admission_type_id", "discharge_disposition_id",
              "admission_source_id", "time_in_hospital", "payer_code", "medical_specialty",
              "num_lab_procedures", "num_procedures", "num_medications", "number_outpatient",
              "number_emergency", "number_inpatient", "diag_1", "diag_2", "diag_3", "number_diagnoses"),
    "tests": ("max_glu_serum", "A1Cresult"),
    "drugs": DRUG_COLUMNS,
    "other": ("change", "diabetesMed"),
    "targets": ("readmitted",),
}
# The numeric columns of the clinical table.
NUMERIC_COLUMNS = ("encounter_id", "patient_nbr", "time_in_hospital", "num_lab_procedures", "num_procedures",
                   "num_medications", "number_outpatient", "number_emergency", "number_inpatient",
                   "number_diagnoses")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_path(spark: SparkSession, candidates: list[str]) -> str:
    """The first candidate that exists; the error lists every path tried."""
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError("data file not found, tried:\n- " + "\n- ".join(candidates))


def read_table(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None,
               na_tokens=NA_TOKENS, presets: dict[str, list[str]] | None = None,
               multi_line: bool = False) -> DataFrame:
    """Header CSV (or parquet) with missing-value spellings as null, then typed.

    ``path`` is a file or folder, a list of candidates, or a preset's name. Text
    is read as text, blanked, and cast to ``schema``; without one all is text.
    """
    if isinstance(path, str) and presets and path in presets:
        path = presets[path]
    found = first_path(spark, [path] if isinstance(path, str) else list(path))
    stem = found.rstrip("/").lower()
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if stem.endswith(".parquet"):
        raw = spark.read.parquet(found)
        kinds = {f.name: f.dataType for f in (schema or raw.schema)}
        return raw.select(*[_without_missing(raw, c, na_tokens).cast(t).alias(c) for c, t in kinds.items()])
    if "." in stem.rsplit("/", 1)[-1] and not stem.endswith(".csv"):
        raise ValueError(f"unknown table format: {found}")
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option(
        "multiLine", multi_line)
    if schema is None:
        raw = reader.csv(found)
        return raw.select(*[null_tokens(q(c), na_tokens).alias(c) for c in raw.columns])
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = reader.schema(text).csv(found)
    cells = {f.name: null_tokens(q(f.name), na_tokens).cast(f.dataType) for f in schema}
    return raw.select(*[_not_nan(cells[f.name], f.dataType).alias(f.name) for f in schema])


def _not_nan(cell: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(cell), cell) if isinstance(dtype, (T.DoubleType, T.FloatType)) else cell


def _without_missing(df: DataFrame, col: str, na_tokens) -> Column:
    """Missing-value spellings of text and NaN of numbers as null."""
    dtype = df.schema[col].dataType
    return null_tokens(q(col), na_tokens) if isinstance(dtype, T.StringType) else _not_nan(q(col), dtype)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Header CSV without an index, or parquet. Returns the path."""
    if fmt == "csv":
        df.write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    elif fmt == "parquet":
        df.write.mode("errorifexists").parquet(path)
    else:
        raise ValueError(f"unknown table format: {fmt}")
    return path


def column_group(df: DataFrame, kind: str | None = None, groups: dict | None = None) -> DataFrame:
    """One named group of columns, or all of them; an unknown name is an error."""
    groups = groups or COLUMN_GROUPS
    if kind in (None, "all"):
        return df
    if kind not in groups:
        raise ValueError(f"unknown column group: {kind}")
    return df.select(*map(q, groups[kind]))


def assign_types(df: DataFrame, numeric_cols=NUMERIC_COLUMNS) -> DataFrame:
    """Named columns (where present) to double, everything else to text."""
    return df.select(*[
        q(c).cast("double").alias(c) if c in numeric_cols else q(c).cast("string").alias(c) for c in df.columns])


def read_replicas(spark: SparkSession, pattern: str, schema: str, marker: str = "synthetic") -> DataFrame:
    """All CSV replicas matching a pattern as one table clipped to [0, 1], tagged by ``dataset``.

    The tag is the path component ending in .csv (a file, or a folder of parts).
    """
    schema_t = T.StructType.fromDDL(schema)
    # _metadata is only there before a projection
    raw = spark.read.option("header", True).schema(schema_t).csv(pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv", 1)
    tagged = raw.select(name.alias("dataset"), *[
        F.when(q(f.name).isNotNull(), F.greatest(F.least(q(f.name), F.lit(1.0)), F.lit(0.0))).alias(f.name)
        if isinstance(f.dataType, T.NumericType) else q(f.name) for f in schema_t])
    return tagged.where(F.col("dataset").contains(marker))
