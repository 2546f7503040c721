"""Text expressions shared by recodes, contracts and row text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Missing-value spellings the CSV reader of the data's origin
# recognises by default, plus the question mark the clinical file uses.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "?",
)
# Missing spellings accepted inside row text.
ROW_TEXT_NA = ("", "NA", "None", "nan", "NaN", "null", "NULL")

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def null_tokens(col: Column, tokens=NA_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def number_or_null(text: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is null."""
    clean = F.trim(text)
    return F.when(clean.rlike(NUMBER_PATTERN), clean.try_cast("double"))


def _below_shortest(x: Column) -> Column:
    """True where |x| is a hair below its shortest decimal text and that text ends in 5 at digit 16.

    Rounding the text to 15 digits would then round up although the exact
    binary value rounds down. Both sides are compared as exact whole numbers:
    x = m / 2^k and the text = d / 10^s.
    """
    plain = F.abs(x).cast("decimal(38,20)").cast("string")
    digits = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.", "")
    significant = F.regexp_replace(digits, "^0+", "")
    tie = (F.length(significant) == 16) & significant.endswith("5") & F.abs(x).between(1e-4, 1e15)
    k = F.lit(52) - F.floor(F.log2(F.abs(x))).cast("int")
    half = F.floor(k / 2).cast("int")
    m = (F.abs(x) * F.pow(F.lit(2.0), k)).cast("bigint").cast("decimal(20,0)")
    scale = F.length(F.regexp_replace(F.substring_index(plain, ".", -1), "0+$", ""))
    left = (m * F.pow(F.lit(10.0), scale).cast("decimal(22,0)")).cast("decimal(38,0)")
    one = F.lit(1).cast("bigint")
    powers = (F.call_function("shiftleft", one, half).cast("decimal(20,0)")
              * F.call_function("shiftleft", one, k - half).cast("decimal(20,0)")).cast("decimal(38,0)")
    right = (significant.cast("decimal(16,0)") * powers.cast("decimal(22,0)")).cast("decimal(38,0)")
    return F.when(tie, left < right).otherwise(False)


def value_text(col: Column, dtype: str) -> Column:
    """Deterministic text of a value: 15 significant digits, booleans as 1/0, null as NA."""
    if dtype == "boolean":
        text = F.when(col, "1").otherwise("0")
    elif dtype in ("double", "float"):
        x = col.cast("double")
        whole = (F.rint(x) == x) & (F.abs(x) < 1e15)
        # one step towards zero turns a false tie into a plain round-down
        shown = F.when(_below_shortest(x), x * F.lit(1 - 2.0 ** -53)).otherwise(x)
        padded = F.format_string("%.15g", shown)
        short = F.regexp_replace(F.regexp_replace(padded, r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
        text = F.when(whole, x.cast("bigint").cast("string")).otherwise(short)
    elif dtype == "string":
        text = F.trim(col)
    else:
        text = col.cast("string")
    return F.when(col.isNull(), F.lit("NA")).otherwise(text)
