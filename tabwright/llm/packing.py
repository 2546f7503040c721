"""Packing by minimum bin slack: whole windows of token ids with next to no padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, bucket, renamed, safe_pieces, written
from .tokens import encoder, shared_vocabulary

MAX_BUCKETS = 4096


def pieces(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0,
           added: dict[str, int] | None = None) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, salt): each document's ids and ``end_id``, cut at multiples of ``capacity``.

    Null texts count as empty and hold ``end_id`` alone. ``ids_crc32`` is over
    the ids as little-endian 32-bit words; ``salt`` numbers the rows of a task.
    """
    shared = shared_vocabulary(df.sparkSession, vocabulary)

    def start():
        from zlib import crc32

        encode, salt = encoder(shared.value, added), 0

        def cut(text: str | None) -> tuple[list[int], int]:
            ids = [np.array(encode(part), dtype="<u4") for part in safe_pieces(text or "", 1 << 18)]
            ids = np.concatenate([*ids, np.array([end_id], dtype="<u4")])
            return [crc32(ids[at:at + capacity].tobytes()) for at in range(0, len(ids), capacity)], len(ids)

        def work(texts):
            nonlocal salt
            found = [cut(t) for t in texts]
            salts = range(salt, salt + len(texts))
            salt += len(texts)
            return [[f[0] for f in found], [f[1] for f in found], list(salts)]

        return work

    fields = [("crcs", T.ArrayType(T.LongType())), ("doc_tokens", T.LongType()), ("salt", T.LongType())]
    docs = arrow_pass(renamed(df, key=key, text=text), ["key"], "text", fields, start)
    at = docs.select("key", "doc_tokens", "salt", F.posexplode("crcs").alias("n", "ids_crc32"))
    first = F.col("n").cast("long") * capacity
    return at.select("key", first.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - first).alias("length"),
                     "ids_crc32", "doc_tokens", "salt")


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum comes closest to ``room`` from below.

    Subset sums as the bits of one integer: a length that may be used m times is
    added in 1, 2, 4, ... copies; walking back through the stored states gives
    the copies used. Longer lengths come first, so short ones stay for later.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            left -= copies
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            copies *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + copies
            total -= length * copies
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, copies, sequence, offset): which ranks of a length go to which sequences.

    The longest length left opens a window, ``best_fill`` completes it, and the
    pattern is repeated while the counts allow. After each pattern some length
    has fewer pieces left than the pattern took, so the patterns are bounded by
    the sum of capacity / length, about 7,700 for 1,024, at any number of pieces.
    """
    left = {length: n for length, n in counts.items() if n}
    taken, rows, sequence = dict.fromkeys(left, 0), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = best_fill(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(left[x] // c for x, c in pattern.items()), 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, taken[length], taken[length] + copies * times, copies, sequence, offset))
            taken[length] += copies * times
            offset += copies * length
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def _placer(rows: list[tuple], names: list[str]):
    """Arrow pass: length and rank of a piece to its sequence and offset."""
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    key = np.array([(int(length) << 50) + int(first) for length, first in table[:, :2]], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            at = table[np.searchsorted(key, (length << 50) + rank, side="right") - 1]
            turn = rank - at[:, 1]
            places = [at[:, 4] + turn // at[:, 3], at[:, 5] + turn % at[:, 3] * length]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(p, type=pa.int64()) for p in places], names=[*names, "sequence_id", "offset"])

    return run


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0,
         added: dict[str, int] | None = None) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece.

    Tokens of ``added`` inside a text get their ids; without it they are ordinary
    text. A piece of ``capacity`` ids fills a sequence. Only the histogram of piece
    lengths, ``capacity`` numbers at most, reaches the driver, which plans the
    sequences by minimum bin slack. A piece finds its place by its rank among
    the pieces of its length: pieces are numbered inside buckets of (length,
    bucket) and the counts of earlier buckets are added, so one very common
    length is spread over many tasks. Null texts count as empty (``end_id``
    alone); null keys and repeated rows are packed like any other; an empty
    table gives no rows.
    """
    cut = written(pieces(df, vocabulary, key, text, capacity, end_id, added), "pieces")
    n_buckets = max(1, min(MAX_BUCKETS, cut.count() // 1000))
    dealt = cut.withColumn("bucket", bucket(n_buckets, F.col("key"), F.col("start"), F.col("salt")))
    sizes = written(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
    before = sizes.selectExpr("length", "bucket", "sum(n) over (partition by length order by bucket) - n as before")
    numbered = dealt.selectExpr("*", "row_number() over (partition by length, bucket order by key, start, ids_crc32, salt) - 1 as row")
    ranked = numbered.join(before, ["length", "bucket"]).withColumn("rank", F.col("row") + F.col("before"))
    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])
    placed = ranked.select(*names, "rank").mapInArrow(_placer(plan(counts, capacity), names), schema)
    return placed.withColumnRenamed("key", key)
