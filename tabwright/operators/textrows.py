"""Rows to text, text back to contract-checked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.text import ROW_TEXT_NA, number_or_null, value_text
from tabwright.operators.profile import ColumnContract, Contract
from tabwright.operators.recode import q
from tabwright.operators.relational import snap

# The layout of a row text and the residue markers stripped from values.
CLASS_PREFIX = "Class_"
SEPARATOR = " | "
END_MARKERS = r"<EOR>|</s>"
PAIR_PATTERN = r"([A-Za-z0-9_\-]+)\s*=\s*([^|\n\r]+)"
INLINE_CATEGORIES = 200


def rows_to_text(df: DataFrame, target: str, out: str = "text", cols: list[str] | None = None) -> DataFrame:
    """``Class_<label> | a=... | b=...`` with 15 significant digits and NA for null."""
    cols = cols or df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    label = q(target).cast("double").cast("bigint").cast("string")
    pairs = [F.concat(F.lit(f"{c}="), value_text(q(c), types[c])) for c in cols]
    head = F.concat(F.lit(CLASS_PREFIX), label)
    return df.withColumn(out, F.concat_ws(SEPARATOR, head, *pairs))


def text_to_map(df: DataFrame, col: str, out: str = "pairs") -> DataFrame:
    """Add a map of key to raw value; the first occurrence of a key wins; null when nothing parses.

    Keys and values are extracted once into columns of their own, so the
    first-occurrence filter compares positions instead of matching again.
    """
    clean = F.trim(q(col))
    at = F.instr(clean, CLASS_PREFIX)
    body = F.when(at > 0, F.substring(clean, at, F.length(clean))).otherwise(clean)
    found = df.withColumn("_body", body).withColumns({
        "_keys": F.regexp_extract_all("_body", F.lit(PAIR_PATTERN), 1),
        "_values": F.regexp_extract_all("_body", F.lit(PAIR_PATTERN), 2)})
    entries = F.transform(
        F.array_distinct("_keys"),
        lambda k: F.struct(k.alias("k"), F.trim(F.get("_values", F.array_position("_keys", k).cast("int") - 1)).alias("v")))
    kept = F.filter(entries, lambda e: ~e["k"].startswith(CLASS_PREFIX))
    parsed = found.withColumn("_map", F.map_from_entries(kept))
    # a one-element explode is a boundary that filters on the map are not pushed
    # through, so they never repeat the parse
    whole = F.explode(F.array(F.when(F.size("_map") > 0, F.col("_map"))))
    return parsed.select(*[q(c) for c in df.columns if c != out], whole.alias(out))


def raw_text(value: Column) -> Column:
    """A raw value without end markers; missing spellings become null."""
    text = F.trim(F.regexp_replace(F.trim(value), END_MARKERS, ""))
    return F.when(~text.isin(*ROW_TEXT_NA), text)


def _whole(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def coerce_number(x: Column, c: ColumnContract) -> Column:
    """Clip to the bounds, snap to a small support, round integer-coded values."""
    if c.min is not None and c.max is not None:
        x = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(c.max)), F.lit(c.min)))
    if c.support:
        x = snap(x, c.support)
    if c.integer_coded:
        x = _whole(x)
        if c.min is not None and c.max is not None:
            x = F.when(x.isNotNull(), F.greatest(F.least(x, _whole(F.lit(c.max))), _whole(F.lit(c.min))))
    return x


def _known(text: Column, c: ColumnContract) -> Column | None:
    """Membership test in an inlined category list (None when the list is too long to inline)."""
    if c.categories is not None and len(c.categories) <= INLINE_CATEGORIES:
        return text.isin(*c.categories) if c.categories else F.lit(True)
    return None


def default_value(c: ColumnContract):
    """Mode, else first support value, else midpoint, else 0; text: mode, else first category, else ''."""
    if not c.is_numeric:
        return str(c.mode) if c.mode is not None else (c.categories[0] if c.categories else "")
    if c.mode is not None:
        value = float(c.mode)
    elif c.support:
        value = c.support[0]
    elif c.min is not None and c.max is not None:
        value = (c.min + c.max) / 2
    else:
        value = 0.0
    return int(round(value)) if c.integer_coded else float(value)


def defaults(contract: Contract, spark) -> DataFrame:
    """(column, value) of every default, as text of the typed value."""
    return spark.createDataFrame(
        [(c.name, str(default_value(c))) for c in contract.columns], "column string, value string")


def _check_long_categories(df: DataFrame, raw: dict[str, Column], contract: Contract) -> tuple[DataFrame, dict]:
    """Resolve columns whose category list is too long to inline by a join with the level table."""
    known = {}
    for i, c in enumerate(contract.columns):
        if c.is_numeric or c.name not in raw or _known(F.lit(""), c) is not None or contract.levels is None:
            continue
        names = df.columns
        lookup = contract.levels.where(F.col("column") == c.name).select(
            F.col("value").alias(f"_lv{i}"), F.lit(True).alias(f"_in{i}"))
        df = df.withColumn(f"_cat{i}", raw[c.name])
        df = df.join(lookup, F.col(f"_cat{i}") == F.col(f"_lv{i}"), "left").select(*map(q, names), f"_in{i}")
        known[c.name] = F.coalesce(F.col(f"_in{i}"), F.lit(False))
    return df, known


def coerce(df: DataFrame, contract: Contract, col: str = "pairs", label: Column | None = None,
           fill: bool = True) -> DataFrame:
    """Typed contract columns from a key-value map.

    Unparsable or missing values take the default when ``fill``; unseen
    categories take the mode; the target is forced to ``label`` when given.
    """
    df = df.withColumns({f"_raw_{i}": raw_text(q(col)[c.name]) for i, c in enumerate(contract.columns)})
    raw = {c.name: F.col(f"_raw_{i}") for i, c in enumerate(contract.columns)}
    df, joined = _check_long_categories(df, raw, contract)
    kept = df.columns
    df = df.withColumns({
        f"_num_{i}": number_or_null(raw[c.name]) for i, c in enumerate(contract.columns) if c.is_numeric})
    numbers = {c.name: F.col(f"_num_{i}") for i, c in enumerate(contract.columns)}
    out = {}
    for c in contract.columns:
        if c.name == contract.target and label is not None:
            out[c.name] = label.cast(c.dtype)
            continue
        text = raw[c.name]
        if c.is_numeric:
            value = coerce_number(numbers[c.name], c).cast(c.dtype)
        else:
            known = joined.get(c.name, _known(text, c))
            fallback = default_value(c)
            value = F.when(text.isNull(), None).when(known, text).otherwise(F.lit(fallback))
        if fill:
            value = F.coalesce(value, F.lit(default_value(c)).cast(c.dtype))
        out[c.name] = value
    keep = [n for n in kept if not n.startswith(("_in", "_raw_")) and n not in out]
    return df.select(*map(q, keep), *[v.alias(n) for n, v in out.items()])


def provided_keys(contract: Contract, col: str = "pairs") -> Column:
    names = F.array(*[F.lit(c.name) for c in contract.columns if c.name != contract.target])
    return F.size(F.array_intersect(F.map_keys(q(col)), names))


def required_keys(contract: Contract) -> int:
    others = sum(1 for c in contract.columns if c.name != contract.target)
    return max(3, int(0.1 * others))


def accept(df: DataFrame, contract: Contract, label_col: str, col: str = "pairs") -> DataFrame:
    """Rows with enough known keys, coerced, with the target forced to ``label_col`` and defaults filled."""
    enough = df.where(q(col).isNotNull() & (provided_keys(contract, col) >= required_keys(contract)))
    return coerce(enough, contract, col, label=q(label_col))


def cast_to_contract(df: DataFrame, contract: Contract) -> DataFrame:
    """Contract columns in contract order and type: missing ones added, numbers clipped, snapped and rounded."""
    have = set(df.columns)
    raw = {c.name: q(c.name).cast("string") for c in contract.columns if not c.is_numeric and c.name in have}
    df, joined = _check_long_categories(df, raw, contract)
    out = []
    for c in contract.columns:
        col = q(c.name) if c.name in have else F.lit(None).cast("string")
        if c.is_numeric:
            text = number_or_null(col.cast("string"))
            x = col.cast("double") if c.name in have and dict(df.dtypes)[c.name] != "string" else text
            if c.min is not None:
                x = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(c.max)), F.lit(c.min)))
            if c.support:
                x = snap(x, c.support)
            if c.integer_coded:
                x = F.rint(x)
            out.append(x.cast(c.dtype).alias(c.name))
        else:
            text = col.cast("string")
            known = joined.get(c.name, _known(text, c))
            out.append(F.when(F.coalesce(known, F.lit(False)), text).otherwise(F.lit(default_value(c))).alias(c.name))
    return df.select(*out)


def ingest_stats(df: DataFrame, contract: Contract, class_col: str, requested: dict[int, int] | None = None,
                 col: str = "pairs") -> DataFrame:
    """Per class: attempts, parse and coercion failures, accepted, rejected and rows still to resample."""
    parsed = q(col).isNotNull()
    enough = parsed & (provided_keys(contract, col) >= required_keys(contract))
    per = df.groupBy(q(class_col).alias("class_label")).agg(
        F.count(F.lit(1)).alias("total_attempts"),
        F.count_if(~parsed).alias("parse_failures"),
        F.count_if(parsed & ~enough).alias("coercion_failures"),
        F.count_if(F.coalesce(enough, F.lit(False))).alias("accepted_rows"))
    if requested:
        want = F.coalesce(*[F.when(F.col("class_label") == g, F.lit(n).cast("bigint")) for g, n in requested.items()],
                          F.lit(0).cast("bigint"))
    else:
        want = F.col("total_attempts")
    return per.select(
        "class_label", want.alias("requested_rows"), "total_attempts", "parse_failures", "coercion_failures",
        "accepted_rows", (F.col("total_attempts") - F.col("accepted_rows")).alias("rejected_rows"),
        F.greatest(want - F.col("accepted_rows"), F.lit(0).cast("bigint")).alias("resampled_rows"))


def stats_json(stats: DataFrame, out: str = "stats") -> DataFrame:
    """Ingest statistics as one JSON text per class."""
    return stats.select("class_label", F.to_json(F.struct(*stats.columns)).alias(out))
