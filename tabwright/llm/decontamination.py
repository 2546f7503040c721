"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, renamed, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # after lower-casing
ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    """Runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased; null gives no words."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)  # then lower() touches nothing but A-Z
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    """64-bit id of ``width`` words from position ``at``; equal ids are verified later, word by word."""
    return F.xxhash64(F.lit(width), *(F.get(words, at + i) for i in range(width)))


def _shingles(docs: DataFrame, keep: list[str], widths: list[int]) -> DataFrame:
    """keep, pos, shingle: every shingle of every document, one row for each position and width."""
    at = docs.select(*dict.fromkeys([*keep, "words"]), F.posexplode("words").alias("pos", "__word"))
    n = F.size("words")
    if len(widths) == 1:
        return at.filter(F.col("pos") + widths[0] <= n).select(*keep, "pos", _shingle(F.col("words"), F.col("pos"), widths[0]).alias("shingle"))
    each = F.array(*(F.when(F.col("pos") + w <= n, _shingle(F.col("words"), F.col("pos"), w)) for w in widths))
    return at.select(*keep, "pos", F.explode(each).alias("shingle")).filter("shingle is not null")


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """(win, items): the distinct windows of the benchmark, each with the ids of its items as text.

    A window is ``window`` words in a row; an item of fewer, but not none, is one
    window. Items without an id count as contamination but are never listed.
    """
    words = renamed(benchmark, item=item, text=text).select(F.col("item").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    at = words.filter(F.size("words") > 0).select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return at.groupBy(F.slice("words", F.col("at") + 1, window).alias("win")).agg(F.collect_set("item").alias("items"))


def _rarest(windows: DataFrame, counts: DataFrame, widths: list[int]) -> DataFrame:
    """win, items, at, shingle: for each window its rarest shingle, the prefix that containment of 1 needs."""
    width = F.least(F.size("win"), F.lit(SHINGLE))
    each = windows.select("win", "items", F.posexplode("win").alias("at", "__word")).filter(F.col("at") + width <= F.size("win"))
    code = F.coalesce(*(F.when(width == w, _shingle(F.col("win"), F.col("at"), w)) for w in widths))
    each = each.select("win", "items", "at", code.alias("shingle")).join(counts, "shingle")
    best = each.groupBy("win").agg(F.min(F.struct("n", "at", "shingle")).alias("best"), F.first("items").alias("items"))
    return best.select("win", "items", F.size("win").alias("len"), "best.at", "best.shingle")


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = 10, block_windows: int = 100_000) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated): one row for each row of ``df``.

    Each window is a set of word shingles, ordered by how rare they are in all
    of ``df``. Full containment needs a prefix of one shingle, so documents meet
    a window only where its rarest shingle occurs (windows whose rarest shingle
    occurs nowhere drop out). The place of the shingle in the window fixes the
    start; bounds on start and length come next, and the window's words are then
    compared one by one. ``n_hit`` counts the words inside any occurrence,
    ``items`` lists the items found, sorted as text.

    Only the window index is broadcast, in blocks of ``block_windows`` windows of
    at most ``window`` words each, so a larger benchmark takes more passes and
    no more memory. Texts are never shuffled. Null and empty texts have no
    words; an empty benchmark hits nothing; rows with equal key and text get
    equal results; other columns are ignored.
    """
    docs = renamed(df, key=key, text=text).select("key", F.xxhash64("text").alias("text_id"), "text")
    tokens = docs.select("key", "text_id", words_of(F.col("text")).alias("words"))
    windows = written(item_windows(benchmark, item, item_text, window), "windows")
    n_windows, widths = windows.agg(F.count(F.lit(1)), F.collect_set(F.least(F.size("win"), F.lit(SHINGLE)))).first()
    widths, blocks = sorted(widths), -(-n_windows // block_windows)
    found = []
    for k in range(blocks):
        block = windows if blocks == 1 else windows.filter(bucket(blocks, F.col("win")) == k)
        width = F.least(F.size("win"), F.lit(SHINGLE))
        own = block.select("win", F.posexplode("win").alias("at", "__word")).filter(F.col("at") + width <= F.size("win"))
        own = own.select(F.coalesce(*(F.when(width == w, _shingle(F.col("win"), F.col("at"), w)) for w in widths)).alias("shingle")).distinct()
        counts = _shingles(tokens, [], widths).join(F.broadcast(own), "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
        index = written(_rarest(block, counts, widths), "prefixes")
        start = F.col("pos") - F.col("at")
        met = _shingles(tokens, ["key", "text_id", "words"], widths).join(F.broadcast(index), "shingle")
        met = met.filter((start >= 0) & (start + F.col("len") <= F.size("words")))
        met = met.filter(F.slice("words", start + 1, F.col("len")) == F.col("win"))
        found.append(met.select("key", "text_id", F.struct(start.alias("start"), F.col("len")).alias("span"), "items"))
    counted = docs.select("key", "text_id", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), ANY_CASE), "")).cast("long").alias("n_words"))
    if not found:
        hits = counted.select("key", "text_id", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    else:
        hits = reduce(DataFrame.unionByName, found).groupBy("key", "text_id").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
        covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))
        hits = hits.select("key", "text_id", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
                           F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    a, b = counted.alias("a"), hits.alias("b")
    both = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.text_id") == F.col("b.text_id")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return both.select(F.col("a.key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                       items.alias("items"), (n_hit > 0).alias("contaminated"))
