"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import written
from tabwright.llm.decontamination import contamination
from tabwright.llm.line_dedup import line_dedup
from tabwright.llm.packing import pack
from tabwright.llm.quality_model import fit_quality, score_quality
from tabwright.llm.simhash import near_duplicates
from tabwright.llm.tokens import added_tokens

VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def _boxed(docs: DataFrame) -> DataFrame:
    """All columns but the text in one struct ``doc``: nothing that a stage adds can clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"), "text")


def _unboxed(boxed: DataFrame, docs: DataFrame) -> DataFrame:
    return boxed.select(*("text" if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def _row(boxed: DataFrame) -> Column:
    """A number that equal rows share; it depends on the values alone, so a retry gives the same."""
    return F.xxhash64("doc", "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; null texts and texts without words go.

    Null ids and repeated rows stay as they are; an empty table stays empty.
    """
    scored = score_quality(_boxed(docs), fit_quality(docs, "text"), ["doc", "text"])
    return _unboxed(scored.filter(F.col("quality") >= 0.5), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text.

    Null texts stay null and null sources are one host. Repeated rows count as
    pages each and null ids play no part; an empty table stays empty.
    """
    boxed = _boxed(docs).withColumn("host", F.col("doc.source"))
    cleaned = _unboxed(line_dedup(boxed, "host", "text"), docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id (null ids first), of repeated rows one.

    Null and blank texts are one group. An empty table stays empty.
    """
    boxed = _boxed(docs)
    boxed = boxed.select("doc", "text", F.struct(F.col("doc.doc_id").alias("id"), _row(boxed).alias("row")).alias("key"))
    marks = near_duplicates(boxed, "key", "text", width=4, max_bits=4)
    first = marks.filter(F.col("key").eqNullSafe(F.col("component_id"))).select("key.id", "key.row").distinct()
    a, b = boxed.alias("a"), first.alias("b")
    kept = a.join(b, F.col("a.key.id").eqNullSafe(F.col("b.id")) & (F.col("a.key.row") == F.col("b.row")), "left_semi")
    return _unboxed(kept.dropDuplicates(["key"]), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null texts have no windows and stay; so do null ids and repeated rows,
    judged by their text. An empty table stays empty.
    """
    boxed = _boxed(docs)
    name = F.concat_ws(":", F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null")), _row(boxed))
    boxed = boxed.withColumn("name", name)
    found = contamination(boxed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "name", "text", window=10)
    return _unboxed(boxed.join(found.filter("contaminated").select("name").distinct(), "name", "left_anti"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids with their sequence and offset.

    A null text is an empty one and has its end id only. Null ids and repeated
    rows are packed like any other; an empty table gives no pieces.
    """
    import public_tokenizers

    added = added_tokens(public_tokenizers.path(TOKENIZER))
    return pack(docs, public_tokenizers.path(VOCABULARY), "doc_id", "text", capacity=1024, end_id=0, added=added)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near dedup", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

# the fitted classifier and the groups of near duplicates are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
