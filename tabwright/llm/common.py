"""Helpers shared by the text operators: scratch tables, row identity, Arrow passes, cuts in long texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def written(df: DataFrame, stem: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, goes when the driver ends."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns can't clash with what it adds."""
    return df.select(*(F.col(f"`{c}`").alias(name) for name, c in columns.items()))


def bucket(n: int, *cols: Column) -> Column:
    """A number from 0 to n-1 that depends on the values alone, so a retry deals rows alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def arrow_pass(df: DataFrame, keep: list[str], text: str, fields: list[tuple[str, T.DataType]],
               start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """One pass over ``text`` in Arrow batches: the ``keep`` columns and, behind them, ``fields``.

    ``start()`` runs once in each task and returns the function from a list of
    texts (None for null) to one list or array of values for each field.
    """
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    kinds = [arrow_kind(t) for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in small_batches(batch, n_keep):
                values = work(part.column(n_keep).to_pylist())
                columns = [part.column(i) for i in range(n_keep)] + [pa.array(v, type=k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def small_batches(batch: pa.RecordBatch, text: int, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, one row at least: Python objects stay small."""
    if not batch.num_rows:
        return
    per_row = max(1, batch.column(text).nbytes // batch.num_rows)
    step = max(1, size // per_row)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def arrow_kind(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_kind(t.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
            T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}[type(t)]


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that tokenize on their own.

    Cuts stand before a single space between two characters that are not white
    space: every pattern of byte-level BPE ends a pre-token there. A stretch
    without such a place stays whole.
    """
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = n
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n or not n:
        yield text[at:]
