"""Host-level quality rules: failures of a host's documents, shrunk by an empirical beta prior."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, renamed, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that stand in the text twice or more, the first time included."""
    if len(words) <= width:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    n, size, grams = len(words) - width + 1, len(codes), ids[: len(words) - width + 1]
    for k in range(1, width):
        if (int(grams.max()) + 1) * size >= 1 << 62:  # keep the pairs exact for any vocabulary
            grams = np.unique(grams, return_inverse=True)[1].reshape(-1)
        grams = grams * size + ids[k:k + n]
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    inside, again = np.zeros(len(words), bool), times[back.reshape(-1)] > 1
    for k in range(width):
        inside[k:k + n] |= again
    return int(inside.sum())


def _counts():
    def count(text: str | None) -> tuple[int, int, int, int, int]:
        text = text or ""
        data = text.encode()
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        return (len(words), len(text) - sum(map(text.count, SPACES)), sum(data.count(b) for b in SYMBOLS),
                len(lines) - len(set(lines)), repeated_words(words))

    return lambda texts: [list(c) for c in zip(*map(count, texts))] if texts else [[]] * len(COUNTS)


def text_counts(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text.

    Words are runs of characters other than space and 0x09-0x0D; null texts have none.
    """
    return arrow_pass(df, keep, text, [(c, T.LongType()) for c in COUNTS], _counts)


@dataclass
class BetaPrior:
    alpha: float
    beta: float

    def rate(self, failed: Column, n: Column) -> Column:
        return (failed + F.lit(self.alpha)) / (n + F.lit(self.alpha + self.beta))


def empirical_prior(hosts: DataFrame, most: float = 10_000.0) -> BetaPrior:
    """Beta prior by moments from (pages, failed) of all hosts; its weight, in pages, is 1 to ``most``.

    The variance of the hosts' rates less what chance alone gives is what hosts
    really differ by; if nothing is left, hosts are taken as alike.
    """
    rate = F.col("failed") / F.col("pages")
    mean, square, chance = hosts.agg(F.avg(rate), F.avg(rate * rate), F.avg(1 / F.col("pages"))).first()
    if mean is None:
        return BetaPrior(0.5, 0.5)
    spread = mean * (1 - mean)
    real = square - mean * mean - spread * chance
    weight = min(most, max(1.0, spread / real - 1)) if real > 0 else most
    mean = min(1 - 1e-6, max(1e-6, mean))
    return BetaPrior(mean * weight, (1 - mean) * weight)


def host_rules(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_words: int = 50,
               max_repeat_percent: int = 50, max_host_rate: float = 0.5, broadcast_hosts: int = 200_000) -> DataFrame:
    """(key, host, counts, base_failed, host_rate, kept): one row for each row of ``df``.

    A document fails the base rule with fewer than ``min_words`` words or more
    than ``max_repeat_percent`` of them in repeated windows. A host's failure
    rate is shrunk towards all hosts by an empirical beta prior; documents that
    pass are kept unless their host's rate is above ``max_host_rate``. Null hosts
    form one host, null texts fail, repeated rows count as documents, other
    columns are ignored, an empty table gives an empty result. Verdicts are
    broadcast for at most ``broadcast_hosts`` hosts; beyond, Spark's join splits
    a host with very many documents. Texts are read once and never shuffled.
    """
    counted = text_counts(renamed(df, key=key, host=host, text=text), ["key", "host"])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = written(counted.withColumn("base_failed", failed), "counts")
    hosts = written(counted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if("base_failed").alias("failed")), "hosts")
    prior = empirical_prior(hosts)
    rates = hosts.select(F.col("host").alias("site"), prior.rate(F.col("failed"), F.col("pages")).alias("host_rate"))
    few = hosts.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    both = counted.join(F.broadcast(rates) if few else rates, F.col("host").eqNullSafe(F.col("site")))
    kept = ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)
    return both.select(F.col("key").alias(key), F.col("host").alias(host), *COUNTS, "base_failed", "host_rate", kept.alias("kept"))
