"""Encoder state files, sectioned lookups, run manifests and fingerprints."""

from __future__ import annotations

import ctypes
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.operators.unitcode import UnitEncoder
from tabwright.session import materialize
from tabwright.sources.tables import path_exists

LIMIT_ROWS = 10_000
WHOLE_BYTES = 1 << 27  # files above are fingerprinted split by split


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def save_encoder(enc: UnitEncoder, prefix: str) -> None:
    """Write ``.limits``, ``.min_max`` and ``.cols``, and in ``.state`` what these cannot say.

    ``.limits`` holds ``{column: {"upper": category}}``, one document a line with
    at most ``LIMIT_ROWS`` intervals of a column, so it can grow with the levels.
    Unseen whole numbers before a level are one entry, ``..`` and the last of them.
    """
    spark = SparkSession.getActiveSession()
    if enc.limits is not None:
        chunk = F.floor(F.col("ord") / LIMIT_ROWS)
        level = F.struct("ord", F.col("upper").cast("string").alias("upper"), "category")
        chunks = _with_gaps(enc.limits).groupBy("column", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(level)).alias("levels"))
        levels = F.map_from_entries(F.transform("levels", lambda x: F.struct(x["upper"], x["category"])))
        lines = chunks.select("column", "chunk", F.to_json(F.create_map("column", levels)).alias("value"))
        lines.orderBy("column", "chunk").select("value").write.mode("errorifexists").text(f"{prefix}.limits")
    _write_text(spark, json.dumps({c: [lo, hi, int(c in enc.discrete)] for c, (lo, hi) in enc.min_max.items()}), f"{prefix}.min_max")
    _write_text(spark, json.dumps(enc.cols), f"{prefix}.cols")
    steps = {c: f.step for c, f in enc.facts.items() if f.step is not None}
    state = {"kinds": enc.kinds, "dtypes": enc.dtypes, "fills": enc.fills, "beta": enc.beta, "steps": steps}
    _write_text(spark, json.dumps(state), f"{prefix}.state")


def _with_gaps(limits: DataFrame) -> DataFrame:
    """``limits`` and an entry ``..v`` for every gap of unseen whole numbers up to v."""
    whole = limits.where("step IS NOT NULL AND ord > 0")
    before = limits.select("column", (F.col("ord") + 1).alias("ord"))
    gaps = whole.join(before, ["column", "ord"], "left_anti").select(
        "column", (F.col("ord") - 1).alias("ord"), F.col("lower").alias("upper"), F.concat(F.lit(".."), F.col("category").cast("bigint") - 1).alias("category"))
    return limits.select("column", "ord", "upper", "category").unionByName(gaps)


def read_limits(spark: SparkSession, path: str, steps: dict[str, float] | None = None) -> DataFrame:
    """(column, ord, lower, upper, category, step) from limits documents, one a line; keys parse as doubles.

    Levels of equal bounds keep their order in the document. ``steps`` is the
    width of an unseen level of columns that have any.
    """
    doc = spark.read.text(path).select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    flat = doc.select(F.explode("m").alias("column", "levels")).select(
        "column", F.posexplode("levels").alias("at", "upper", "category"))
    flat = flat.select("column", "at", F.col("upper").cast("double").alias("upper"), "category")
    order = Window.partitionBy("column").orderBy("upper", "at")
    bounded = flat.select(
        "column", (F.row_number().over(order) - 1).cast("bigint").alias("ord"),
        F.coalesce(F.lag("upper").over(order), F.lit(0.0)).alias("lower"), "upper", "category")
    widths = spark.createDataFrame(list((steps or {}).items()), "column string, step double")
    listed = bounded.join(F.broadcast(widths), "column", "left").where("step IS NULL OR NOT startswith(category, '..')")
    whole = F.when(F.col("step").isNotNull(), F.col("category").try_cast("bigint"))
    place = whole - F.min(whole).over(Window.partitionBy("column"))
    return listed.select("column", F.coalesce(place, "ord").alias("ord"), "lower", "upper", "category", "step")


def read_min_max(spark: SparkSession, path: str) -> DataFrame:
    """(column, min, max, discrete); an absent file gives no rows."""
    schema = "column string, min double, max double, discrete int"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    flat = text.select(F.explode(F.from_json("value", "map<string, array<double>>")).alias("column", "b"))
    return flat.select("column", F.col("b")[0].alias("min"), F.col("b")[1].alias("max"),
                       F.col("b")[2].cast("int").alias("discrete"))


def read_cols(spark: SparkSession, path: str) -> list[str] | None:
    if not path_exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", "array<string>").alias("c")).first()["c"]


def load_encoder(spark: SparkSession, prefix: str, dtypes: dict[str, str] | None = None,
                 kinds: dict[str, str] | None = None) -> UnitEncoder:
    """Encoder from its files; any of them may be missing.

    Without ``.state`` (or ``dtypes`` and ``kinds``) bounds make a column
    numeric and intervals make it nominal; missing numbers then fill to the
    middle of their bounds and missing levels to the widest interval.
    """
    bounds = read_min_max(spark, f"{prefix}.min_max").collect()
    state = {}
    if path_exists(spark, f"{prefix}.state"):
        state = json.loads(spark.read.text(f"{prefix}.state", wholetext=True).first()[0])
    limits = None
    if path_exists(spark, f"{prefix}.limits"):
        limits = materialize(read_limits(spark, f"{prefix}.limits", state.get("steps")))
    min_max = {r["column"]: (r["min"], r["max"]) for r in bounds}
    columns = [r[0] for r in limits.select("column").distinct().collect()] if limits is not None else []
    cols = read_cols(spark, f"{prefix}.cols") or sorted(columns) + sorted(min_max)
    kinds = kinds or state.get("kinds") or {c: "numeric" if c in min_max else "nominal" for c in cols}
    return UnitEncoder(cols, kinds, dtypes or state.get("dtypes", {}), limits, min_max=min_max, fills=state.get("fills", {}),
                       beta=state.get("beta", False), discrete={r["column"] for r in bounds if r["discrete"]}).settle()


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Stacked two-column lookups split by a lone comma line: (section, name, code, description).

    One small file by nature; each line keeps its position, the section is a
    running count of separators, and its name is the header's first column.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    order = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum((F.trim("line") == ",").cast("int")).over(order))
    cells = F.from_csv("line", F.lit("code string, description string"), {"quote": '"', "escape": '"'})
    body = lines.where(~F.trim("line").isin(",", "")).withColumn("c", cells)
    head = Window.partitionBy("section").orderBy("pos")
    named = body.select("section", F.first("c.code").over(head).alias("name"),
                        F.row_number().over(head).alias("rn"), "c.code", "c.description")
    return named.where("rn > 1").select("section", "name", "code", "description")


def sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each section as its own lookup table (code, description)."""
    rows = read_sections(spark, path)
    names = [r[0] for r in rows.select("name").distinct().collect()]
    return {n: rows.where(F.col("name") == n).select("code", "description") for n in names}


def file_sha256(spark: SparkSession, path: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """(path, sha256) of every file at ``path``; a file of more than ``whole`` bytes is read split by split, each by a task of its own.

    The digest is one chain over the bytes, so the splits of one file follow
    one another: a task takes the chain's state (112 bytes) from the one before.
    Files that Hadoop's text reader would unpack by their name are read whole,
    2 GB at most, as are all where Python has no OpenSSL.
    """
    files, digest = spark.read.format("binaryFile").load(path), F.sha2("content", 256).alias("sha256")
    large = files.where(F.col("length") > whole).select("path", "length").collect()
    if not large or not _openssl():
        return files.select("path", digest)
    out = files.where(F.col("length") <= whole).select("path", digest)  # a filter of the source: content above it is not read
    packed = [r["path"] for r in large if _PACKED.search(r["path"].lower())]
    if packed:
        out = out.unionByName(spark.read.format("binaryFile").load([*map(_exact, packed)]).select("path", digest))
    chained = [(r["path"], _chained_sha256(spark, r["path"], r["length"])) for r in large if r["path"] not in packed]
    return out.unionByName(spark.createDataFrame(chained, "path string, sha256 string"))


_PACKED = re.compile(r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$")


def _exact(path: str) -> str:
    """A path that is no pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _openssl():
    """OpenSSL's library as Python's own ``hashlib`` uses it, whose SHA-256 state is plain bytes; None where there is none."""
    try:
        import _hashlib
        lib = ctypes.CDLL(_hashlib.__file__)
        lib.SHA256_Init, lib.SHA256_Update, lib.SHA256_Final  # noqa: B018
        return lib
    except (ImportError, OSError, AttributeError):
        return None


def _hash_on(state: bytes, pieces) -> bytes:
    """The SHA-256 state after further bytes."""
    lib, held = _openssl(), ctypes.create_string_buffer(state, len(state))
    for piece in pieces:
        lib.SHA256_Update(held, piece, ctypes.c_size_t(len(piece)))
    return held.raw


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(start of the split, bytes) of the parts of a file between newlines, in order inside a split."""
    lines = spark.read.option("lineSep", "\n").text(_exact(path))
    return lines.select(F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _chained_sha256(spark: SparkSession, path: str, length: int) -> str:
    lines = split_lines(spark, path)
    splits = lines.rdd.getNumPartitions()
    for begin in (b"", b"\xef\xbb\xbf"):  # the text reader leaves out a byte order mark
        held = ctypes.create_string_buffer(256)
        _openssl().SHA256_Init(held)
        state, seen, last = _hash_on(held.raw, [begin]), len(begin), -1
        for i in range(splits):
            for start, size, after in spark.sparkContext.runJob(_hashed(lines, state, last < 0).rdd, list, [i]):
                if start <= last:
                    raise RuntimeError(f"splits of {path} are out of order")
                last, seen, state = start, seen + size, after
        if seen in (length, length - 1):
            break
    else:
        raise RuntimeError(f"{path} has {length} bytes, {seen} were read")
    held = ctypes.create_string_buffer(_hash_on(state, [b"\n"] * (length - seen)), 256)
    digest = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(digest, held)
    return digest.raw.hex()


def _hashed(lines: DataFrame, state: bytes, first: bool) -> DataFrame:
    """(start, bytes taken, state behind them) of a split: its lines, a newline before each but the file's first."""
    def run(batches):
        after, size, starts, begun = state, 0, set(), first
        for batch in batches:
            if batch.num_rows:
                starts.update(batch.column(0).unique().to_pylist())
                piece = b"\n".join([*([] if begun else [b""]), *batch.column(1).to_pylist()])
                after, size, begun = _hash_on(after, [piece]), size + len(piece), False
        if len(starts) > 1:
            raise RuntimeError("a task has more than one split")
        if starts:
            yield pa.RecordBatch.from_arrays([pa.array(list(starts), pa.int64()), pa.array([size], pa.int64()), pa.array([after], pa.binary())],
                                             names=["start", "size", "state"])

    return lines.mapInArrow(run, "start bigint, size bigint, state binary")


def row_sha256(df: DataFrame, col: str) -> DataFrame:
    """``df`` and the lowercase hex ``sha256`` of a text column's UTF-8 bytes; null stays null."""
    return df.withColumn("sha256", F.sha2(F.col(f"`{col}`"), 256))


def log_metrics(spark: SparkSession, table: str, run: str, values: dict, kind: str = "metric") -> None:
    """Append (run, kind, name, value, logged_at) rows to a run table."""
    rows = [(run, kind, str(k), None if v is None else str(v)) for k, v in values.items()]
    df = spark.createDataFrame(rows, "run string, kind string, name string, value string")
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(table)


def split_facts(df: DataFrame, target: str) -> dict[str, int]:
    """Row and class counts of one split."""
    label = F.rint(F.col(target).cast("double"))
    row = df.agg(F.count(F.lit(1)), F.count_if(label == 0), F.count_if(label == 1)).first()
    return {"rows": row[0], "class_0": row[1], "class_1": row[2]}


def write_manifest(spark: SparkSession, table: str, run: str, params: dict, splits: dict[str, tuple],
                   target: str, stats: DataFrame | None = None) -> None:
    """Parameters, per-split counts and input hashes, and generation statistics of one run.

    ``splits`` maps a name to (source frame, synthetic frame, source path or None).
    """
    log_metrics(spark, table, run, params, "param")
    facts = {}
    for name, (source, synthetic, path) in splits.items():
        for side, df in (("source", source), ("synthetic", synthetic)):
            facts |= {f"{name}.{side}.{k}": v for k, v in split_facts(df, target).items()}
        if path:
            hashes = file_sha256(spark, path).orderBy("path")
            joined = hashes.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("sha256"))), 256)).first()[0]
            facts[f"{name}.input_sha256"] = joined
    log_metrics(spark, table, run, facts, "split")
    if stats is not None:
        for r in stats.collect():
            log_metrics(spark, table, run, {f"class_{r['class_label']}.{k}": v for k, v in r.asDict().items()}, "stats")
