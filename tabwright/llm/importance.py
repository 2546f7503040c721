"""Importance resampling towards a target: hashed n-gram counts of corpus and target, gains, Gumbel scores, a global draw."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import key_rank
from .common import arrow_pass, renamed, small_batches, written


def _bytes_table() -> bytes:
    """Letters in lower case, digits and bytes of longer UTF-8 characters as they are, all else blank."""
    keep = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
    return bytes(b if b in keep else 0x20 for b in bytes(range(0x100)).lower())


def _bucket_blocks(text: str | None, order: int, buckets: int, size: int = 1 << 20) -> Iterator[tuple[int, list[int]]]:
    """(words, buckets of all runs of 1 to ``order`` words) for each block of about ``size`` bytes.

    The crc32 of a run seeds the crc32 of the run one word longer. The last
    words of a block go on into the next, so no run is lost or seen twice.
    """
    from zlib import crc32

    data = (text or "").encode("utf-8", "surrogatepass").translate(_bytes_table())
    at, tail = 0, []
    while at < len(data):
        cut = data.find(b" ", at + size)
        cut = len(data) if cut < 0 else cut
        fresh = data[at:cut].split()
        at = cut
        words = tail + fresh
        joined = [b" " + w for w in words]
        sums = list(map(crc32, words))
        found = [c % buckets for c in sums[len(tail):]]
        for n in range(2, order + 1):
            sums = list(map(crc32, joined[n - 1:], sums))
            found += [c % buckets for c in sums[max(0, len(tail) - n + 1):]]
        yield len(fresh), found
        tail = words[len(words) - order + 1:] if 1 < order <= len(words) else words if order > 1 else []


def bucket_counts(df: DataFrame, text: str = "text", order: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any are left out.

    A task counts all its texts in one Counter of at most ``buckets`` entries,
    so the shuffle holds that many rows a task however long the texts are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in small_batches(batch, 0):
                for each in part.column(0).to_pylist():
                    for _, found in _bucket_blocks(each, order, buckets):
                        total.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["bucket", "n"])

    counted = renamed(df, text=text).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus), by bucket.

    Both are ``bucket_counts`` tables: the driver gets at most ``buckets`` rows of each.
    """
    s, t = ({r["bucket"]: r["n"] for r in side.collect()} for side in (corpus, target))
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def text_weights(df: DataFrame, gains: list[int], key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean gain of a text's features, 0 without features."""
    def start():
        def measure(text: str | None) -> tuple[int, int, int]:
            words = features = total = 0
            for n, found in _bucket_blocks(text, order, len(gains)):
                words += n
                features += len(found)
                total += sum(gains[b] * k for b, k in Counter(found).items())
            return words, features, total // features if features else 0

        return lambda texts: list(zip(*map(measure, texts)))

    fields = [(name, T.LongType()) for name in ("n_words", "n_features", "weight")]
    return arrow_pass(renamed(df, key=key, text=text), ["key"], "text", fields, start)


def gumbel_milli(key: Column, salt: str) -> Column:
    """A Gumbel draw in thousandths, floored, from the first 32 bits of sha256(``salt:key``); a null key is empty text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2,
                        buckets: int = 10_000, min_words: int = 20, percent: int = 25, salt: str = "7") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): one row for each row of ``df``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower
    case; features are all runs of 1 to ``order`` words. ``weight`` is the
    floored mean gain, ``score`` adds a Gumbel draw of the key, and the highest
    ``percent`` of the rows with at least ``min_words`` words are ranked 1, 2,
    3, ... without replacement; ties go to the smaller key, null keys first,
    then to fewer features. All other rows have a null rank. Null, empty and
    wordless texts have weight 0 and are never drawn. Repeated rows count and
    are drawn each by itself. Empty tables give no rows (``df``) or the gains of
    an empty target. Other columns are left alone, whatever their names.
    """
    gains = bucket_gains(bucket_counts(df, text, order, buckets), bucket_counts(target, "text", order, buckets), buckets)
    weighed = text_weights(df, gains, key, text, order)
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel_milli(F.col("key"), salt)), "scored")
    n = scored.filter(F.col("n_words") >= min_words).count()
    drawn = percent * n // 100
    keyed = scored.select("*", (F.col("n_words") < min_words).alias("_last"), (-F.col("score")).alias("_low"))
    placed = key_rank(keyed, ["_last", "_low", "key", "n_features", "weight"], out="place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return placed.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", rank)
