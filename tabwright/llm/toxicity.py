"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model with correlations, a linear scorer."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, renamed, written
from .weak_labels import ABSTAIN, NO, YES, LabelModel, fit, fit_linear, pattern_code, pattern_votes

# fixed values: everyday insults, a lexicon that needs no labels
INSULTS = frozenset("idiot moron stupid dumb fool loser scum trash garbage jerk clown pathetic disgusting worthless".split())
_WORDS = re.compile(r"[^\W\d_]+").findall
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEVELS = (1, 3, 6)
WORD_END = "$"
VOTERS = 11


def stems(word: str) -> list[str]:
    """Beginnings of 3 to 7 letters and the whole word, marked by its end."""
    return [word[:n] for n in range(3, min(7, len(word)) + 1)] + [word + WORD_END]


def text_words(text: str | None) -> Counter:
    return Counter(_WORDS((text or "").lower()))


def text_terms(words: Counter, only: frozenset[str] | None = None) -> dict[str, int]:
    """How often each stem occurs in a whole text; ``only`` names the stems of interest."""
    found: dict[str, int] = {}
    for word, n in words.items():
        for stem in stems(word):
            if only is None or stem in only:
                found[stem] = found.get(stem, 0) + n
    return found


def leveled(found: dict[str, int]) -> list[str]:
    """Terms: a stem at each level of occurrences that it reaches."""
    return [f"{level}{stem}" for stem, n in found.items() for level in LEVELS if n >= level]


@dataclass
class Lexicon:
    terms: dict[str, int]  # term: its number
    odds: np.ndarray  # log odds of toxic against clean documents

    @property
    def stems(self) -> frozenset[str]:
        return frozenset(t[1:] for t in self.terms)


def _terms_pass(df: DataFrame, known: frozenset[str] | None) -> DataFrame:
    def start():
        only = None if known is None else frozenset(t[1:] for t in known)
        return lambda texts: [[[t for t in leveled(text_terms(text_words(x), only)) if known is None or t in known] for x in texts]]

    return arrow_pass(df, [], "text", [("terms", T.ArrayType(T.StringType()))], start).select(F.explode("terms").alias("term"))


def learn_lexicon(sample: DataFrame, size: int = 500, min_share: float = 0.01, min_count: int = 3, least_odds: float = 1.4) -> Lexicon:
    """The ``size`` terms that tell toxic rows of ``sample`` (text, toxic) best from clean ones.

    A term must occur in ``min_count`` toxic documents and in ``min_share`` of
    them. Terms are counted in Spark, first over toxic documents, then those
    that pass over clean ones.
    """
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_yes, n_no = totals.get(1, 0), totals.get(0, 0)
    least = max(min_count, int(np.ceil(min_share * n_yes)))
    yes = _terms_pass(sample.filter("toxic = 1"), None).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    yes = {r["term"]: r["n"] for r in yes.orderBy(F.desc("n"), "term").limit(40 * size).collect()}
    no = _terms_pass(sample.filter("toxic = 0"), frozenset(yes)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    no = {r["term"]: r["n"] for r in no.collect()}
    odds = {t: log((n + 0.5) / (n_yes + 1)) - log((no.get(t, 0) + 0.5) / (n_no + 1)) for t, n in yes.items()}
    best = sorted((t for t in yes if odds[t] >= least_odds), key=lambda t: (-yes[t] * odds[t], t))[:size]
    return Lexicon({t: i for i, t in enumerate(best)}, np.array([odds[t] for t in best]))


def text_votes(text: str | None, words: Counter, hits: list[str], lexicon: Lexicon, strong_odds: float = 3.0) -> list[int]:
    """The votes of all voters; ``hits`` are the lexicon's terms in the text."""
    data = (text or "").encode()
    capitals, letters = (len(data) - len(data.translate(None, x)) for x in (CAPITALS, CAPITALS + CAPITALS.lower()))
    strong = [t for t in hits if lexicon.odds[lexicon.terms[t]] >= strong_odds]
    whole = [t for t in strong if t.endswith(WORD_END)]
    short = [t for t in strong if t not in whole and len(t) <= 5]
    long = [t for t in strong if t not in whole and len(t) > 5]

    def yes(x):
        return YES if x else ABSTAIN

    return [yes(any(t[0] == "1" for t in whole)), yes(any(t[0] == "1" for t in short)), yes(any(t[0] == "1" for t in long)),
            yes(any(t[0] != "1" for t in short)), yes(any(t[0] != "1" for t in whole + long)),
            yes(len(hits) - len(strong) >= 3), yes(len(strong) >= 4), ABSTAIN if hits or not lexicon.terms else NO,
            yes(not INSULTS.isdisjoint(words)), yes(letters >= 20 and 2 * capitals > letters), yes(data.count(b"!!") >= 3)]


def _votes_pass(lexicon: Lexicon):
    known, kept = frozenset(lexicon.terms), lexicon.stems

    def start():
        def work(texts):
            codes, numbers = [], []
            for t in texts:
                words = text_words(t)
                hits = [x for x in leveled(text_terms(words, kept)) if x in known]
                codes.append(pattern_code(text_votes(t, words, hits, lexicon)))
                numbers.append(sorted(lexicon.terms[x] for x in hits))
            return [codes, numbers]

        return work

    return start


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    labels: LabelModel
    weights: np.ndarray  # of the terms, then of each voter's NO and YES
    bias: float


def _entries(hits: list, codes: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, value and row of the scorer's inputs: terms found, and votes that are not abstentions."""
    sizes = np.array([len(h) for h in hits], dtype=np.int64)
    index = np.concatenate([np.asarray(h, dtype=np.int64) for h in hits] + [np.zeros(0, np.int64)])
    row, voter = np.nonzero((votes := pattern_votes(codes, VOTERS)) != ABSTAIN)
    index = np.concatenate([index, n_terms + 2 * voter + votes[row, voter] - 1])
    value = np.concatenate([np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes), np.ones(len(row))])
    return index, value, np.concatenate([np.repeat(np.arange(len(hits)), sizes), row])


def _below(share: float, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < F.lit(min(1 << 30, int(share * (1 << 30)) + 1))


def score_toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                   train_rows: int = 20_000) -> tuple[DataFrame, ToxicityModel]:
    """(key, score, label_posterior) of every row of ``df``, and the model.

    ``labels`` (key, label 0/1) holds the labels that may be learned from; null
    keys and labels are ignored, and a key with both labels counts as toxic.
    About ``train_rows`` labelled rows, drawn by a hash of the key (all, if there
    are fewer), give the lexicon and known labels; the label model is fitted on
    the vote patterns of all rows, 3^11 counts at most; the linear scorer on the
    posterior labels of the labelled rows and of about ``train_rows`` others,
    rows of equal key, votes and hits once.

    The inputs of a score are the text alone. Null texts count as empty; a text
    without any vote still gets its score. Null keys and repeated rows are scored
    like any other; other columns are ignored; without labels the voters that
    need none decide; an empty table gives an empty result.
    """
    docs = renamed(df, key=key, text=text)
    known = renamed(labels, key=key, toxic=label).filter("key is not null and toxic is not null")
    share = train_rows / max(1, known.count())
    known = known.filter(_below(share, F.col("key"))).groupBy("key").agg(F.max("toxic").cast("int").alias("toxic"))
    known = F.broadcast(written(known, "labels"))  # about train_rows rows, by the draw above
    sample = written(docs.join(known, "key").select("text", "toxic"), "sample")
    lexicon = learn_lexicon(sample)
    fields = [("code", T.LongType()), ("hits", T.ArrayType(T.IntegerType()))]
    voted = written(arrow_pass(docs, ["key"], "text", fields, _votes_pass(lexicon)), "votes")
    voted = voted.join(known, "key", "left").withColumn("toxic", F.coalesce("toxic", F.lit(-1)))
    patterns = voted.groupBy("code", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    codes, marks, counts = (np.array([r[c] for r in patterns], dtype=np.int64) for c in ("code", "toxic", "n"))
    model = fit(pattern_votes(codes, VOTERS), counts.astype(float), correlated=True, known=marks, prior=0.1)
    rest = train_rows / max(1, int(counts[marks < 0].sum()))
    train = voted.filter((F.col("toxic") >= 0) | _below(rest, F.col("key"), F.col("hits"))).select("key", "code", "hits", "toxic").distinct().collect()
    code = np.array([r["code"] for r in train], dtype=np.int64)
    gold = np.array([r["toxic"] for r in train], dtype=np.int64)
    target = np.where(gold < 0, model.posterior(pattern_votes(code, VOTERS)), gold) if len(train) else np.zeros(0)
    n_terms = len(lexicon.terms)
    index, value, row = _entries([r["hits"] for r in train], code, n_terms)
    weights, bias = fit_linear(index, value, row, target, n_terms + 2 * VOTERS, penalty=1e-3)
    fitted = ToxicityModel(lexicon, model, weights, bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).to_numpy()
            index, value, row = _entries(batch.column(2).to_pylist(), codes, n_terms)
            z = np.bincount(row, value * weights[index], batch.num_rows) + bias
            columns = [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(model.posterior(pattern_votes(codes, VOTERS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "score", "label_posterior"])

    schema = T.StructType([voted.schema["key"], T.StructField("score", T.DoubleType()), T.StructField("label_posterior", T.DoubleType())])
    return voted.select("key", "code", "hits").mapInArrow(run, schema).withColumnRenamed("key", key), fitted
