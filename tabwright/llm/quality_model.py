"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import operator
import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, renamed
from .weak_labels import ABSTAIN, NO, YES, LabelModel, fit, fit_linear, pattern_code, pattern_votes

SIZE = 4096
STATS = ("symbols", "capitals", "echoes", "distinct", "shouts", "letters", "bars", "stops", "word_length", "words")
_SYMBOLS = re.compile(rb"[#*$%&|<>]+")
_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if b in b"\t\n\x0b\x0c\r" else b
                for b in range(256))


def text_stats(data: bytes, words: list[bytes]) -> dict[str, float]:
    """Shares that the labellers look at; a text without words has zeros."""
    n = max(1, len(words))
    shapes = data.translate(_SHAPES)
    upper, lower = shapes.count(b"A"), shapes.count(b"a")
    inked = max(1, len(shapes) - shapes.count(b" "))
    return {"symbols": len(_SYMBOLS.findall(data)) / n, "capitals": upper / max(1, upper + lower),
            "echoes": sum(map(operator.eq, words, words[1:])) / n, "distinct": len(set(words)) / n,
            "shouts": data.count(b"!!") / n, "letters": (upper + lower + shapes.count(b"0")) / max(1, inked - shapes.count(b".") - shapes.count(b",")), "bars": data.count(b" |") / n,
            "stops": sum(w.endswith((b".", b"!", b"?")) for w in words) / n, "word_length": inked / n, "words": len(words)}


def labeller_votes(s: dict[str, float]) -> list[int]:
    """One vote of each labeller: NO for bad, YES for good.

    A labeller that looks for one kind of junk has nothing to say of a text
    without it, so it votes NO or abstains; those that look at the text as a
    whole vote both ways.
    """
    def no(bad):
        return NO if bad else ABSTAIN

    def whole(bad, good):
        return NO if bad else YES if good else ABSTAIN

    if not s["words"]:
        return [ABSTAIN] * 8 + [NO]
    several = s["words"] >= 8
    return [no(s["symbols"] > 0.25), no(several and s["capitals"] > 0.5), no(several and s["echoes"] > 0.2),
            no(s["words"] >= 30 and s["distinct"] < 0.15), no(s["shouts"] > 0.2), no(s["bars"] > 0.2),
            whole(s["letters"] < 0.7, s["letters"] >= 0.85), whole(s["words"] >= 60 and not s["stops"], s["stops"] >= 0.01),
            whole(s["word_length"] > 20, 2 <= s["word_length"] <= 14)]


VOTERS = 9


def hashed_features(data: bytes, words: list[bytes], s: dict[str, float]) -> dict[int, float]:
    """Hashed word shapes, weighted by the root of their share, and hashed steps of the shares."""
    a = np.frombuffer(data.translate(_SHAPES), np.uint8)
    shapes = a[np.append(a[1:] != a[:-1], True)].tobytes().split() if len(a) else []
    found: dict[int, float] = {}
    for shape, n in Counter(shapes).items():
        at = crc32(shape) % SIZE
        found[at] = found.get(at, 0.0) + (n / len(words)) ** 0.5
    for name in STATS[:-1]:
        at = crc32(f"{name} {min(10, int(10 * s[name] / (8 if name == 'word_length' else 1)))}".encode()) % SIZE
        found[at] = found.get(at, 0.0) + 1.0
    return found


def _parts(text: str | None) -> tuple[bytes, list[bytes]]:
    data = (text or "").encode()
    return data, data.split()


def _votes():
    return lambda texts: [[pattern_code(labeller_votes(text_stats(*_parts(t)))) for t in texts]]


def _features():
    def work(texts):
        codes, places, values = [], [], []
        for t in texts:
            data, words = _parts(t)
            s = text_stats(data, words)
            x = hashed_features(data, words, s)
            codes.append(pattern_code(labeller_votes(s)))
            places.append(list(x))
            values.append(list(x.values()))
        return [codes, places, values]

    return work


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def fit_quality(df: DataFrame, text: str = "text", train_rows: int = 20_000) -> QualityModel:
    """Label model from the votes on every row, scorer from posterior labels of about ``train_rows`` rows.

    The votes reach the driver as counts of vote patterns, at most 3^9 whatever
    the rows. The scorer's sample takes distinct texts by a hash below a threshold
    that makes ``train_rows`` of them expected (all, if there are fewer); copies
    count once and null texts are left out, so no group of rows can fill it.
    """
    docs = renamed(df, text=text)
    patterns = arrow_pass(docs, [], "text", [("code", T.LongType())], _votes).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    votes = pattern_votes(np.array([r["code"] for r in patterns], dtype=np.int64), VOTERS)
    labels = fit(votes, np.array([float(r["n"]) for r in patterns]), prior=0.8, weights=(3.0, 1.0))
    filled = docs.filter("text is not null")
    share = train_rows / max(1, filled.agg(F.approx_count_distinct(F.xxhash64("text"), 0.02)).first()[0])
    drawn = filled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(min(1 << 30, int(share * (1 << 30)) + 1))).distinct()
    fields = [("code", T.LongType()), ("place", T.ArrayType(T.IntegerType())), ("value", T.ArrayType(T.FloatType()))]
    sample = arrow_pass(drawn, [], "text", fields, _features).toPandas()
    sizes = sample["place"].map(len).to_numpy(dtype=np.int64) if len(sample) else np.zeros(0, np.int64)
    flat = [np.concatenate(list(sample[c])) if len(sample) else np.zeros(0) for c in ("place", "value")]
    target = labels.posterior(pattern_votes(sample["code"].to_numpy(dtype=np.int64), VOTERS)) if len(sample) else np.zeros(0)
    weights, bias = fit_linear(flat[0], flat[1], np.repeat(np.arange(len(sizes)), sizes), target, SIZE)
    return QualityModel(labels, weights, bias)


def score_quality(df: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``quality`` (0 to 1, 1 for good) and ``label_posterior`` of each row; texts without words get 0."""
    weights, bias, labels = model.weights.astype(np.float32), model.bias, model.labels
    known: dict[int, float] = {}

    def start():
        def work(texts):
            scores, posteriors = [], []
            for t in texts:
                data, words = _parts(t)
                s = text_stats(data, words)
                x = hashed_features(data, words, s)
                z = bias + float(np.dot(weights[list(x)], list(x.values())))
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))) if words else 0.0)
                code = pattern_code(labeller_votes(s))
                if code not in known:
                    known[code] = float(labels.posterior(pattern_votes(np.array([code]), VOTERS))[0])
                posteriors.append(known[code])
            return [scores, posteriors]

        return work

    docs = df.select(*keep, F.col(f"`{text}`").alias("__body"))
    return arrow_pass(docs, keep, "__body", [("quality", T.DoubleType()), ("label_posterior", T.DoubleType())], start)


def classify_quality(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, train_rows: int = 20_000) -> DataFrame:
    """(key, quality, label_posterior, kept): fit on ``df`` itself, score every row, keep ``quality`` >= ``threshold``.

    No labels are read. Null texts count as empty; texts without words score 0
    and go. Null keys and repeated rows are scored like any other, other columns
    are ignored, and an empty table gives an empty result.
    """
    docs = renamed(df, key=key, text=text)
    scored = score_quality(docs, fit_quality(docs, "text", train_rows), ["key"])
    return scored.select(F.col("key").alias(key), "quality", "label_posterior", (F.col("quality") >= threshold).alias("kept"))
