import random

import numpy as np
from fixtures import document_rows, documents, sentence

from tabwright.llm.quality_model import classify_quality
from tabwright.llm.weak_labels import ABSTAIN, NO, YES, fit, fit_linear, pattern_code, pattern_votes


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth, right = rng.random(20_000) < 0.3, np.array([0.95, 0.9, 0.8, 0.6])
    votes = np.where((rng.random((20_000, 4)) < right) == truth[:, None], YES, NO)
    votes[rng.random(votes.shape) < 0.2] = ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = fit(patterns, counts.astype(float), prior=0.4)
    assert abs(model.prior[1] - 0.3) < 0.03 and np.abs(model.accuracies() - right).max() < 0.05
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_copied_voters_are_counted_once():
    rng = np.random.default_rng(2)
    truth = rng.random(40_000) < 0.5
    good = np.where((rng.random((40_000, 3)) < 0.85) == truth[:, None], YES, NO)
    weak = np.where((rng.random(40_000) < 0.6) == truth, YES, NO)
    votes = np.column_stack([good] + [weak] * 5)  # five copies of one weak voter outvote three good ones
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    known = np.full(len(patterns), -1)
    leaning = fit(patterns, counts.astype(float), correlated=True, known=known)
    assert sum(p >= 3 for p in leaning.parents[3:]) >= 4
    assert ((leaning.posterior(votes) > 0.5) == truth).mean() > ((votes == YES).mean(1) > 0.5).__eq__(truth).mean()


def test_pattern_codes_round_trip():
    rows = [[random.Random(i).randrange(3) for _ in range(7)] for i in range(50)]
    assert pattern_votes(np.array([pattern_code(r) for r in rows]), 7).tolist() == rows


def test_linear_scorer_learns_soft_targets():
    rng = np.random.default_rng(3)
    index, row = rng.integers(0, 20, 6000), np.repeat(np.arange(2000), 3)
    target = (np.bincount(row, index < 5, 2000) > 0).astype(float) * 0.9 + 0.05
    w, b = fit_linear(index, np.ones(6000), row, target, 20)
    assert w[:5].min() > 1 > w[5:].max()
    assert fit_linear(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), 4)[1] == 0.0


def junk(rng):
    words = sentence(rng, 80).split()
    return [" ".join(w + "***" for w in words), " | ".join(words), " ".join([words[0]] * 60 + [words[1]] * 60), "!! ".join(words).upper()]


def test_separates_junk_from_prose(spark):
    rng = random.Random(6)
    rows = [r for r in document_rows(n=200) if r[1]] + [(5000 + 4 * i + k, t, "en", "s", 1, None, None, None) for i in range(15) for k, t in enumerate(junk(rng))]
    got = classify_quality(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert np.mean([r["kept"] for r in got if (r["doc_id"] or 0) >= 5000]) < 0.05
    assert np.mean([r["kept"] for r in got if (r["doc_id"] or 0) < 60]) > 0.95


def test_held_out_accuracy_on_given_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", "quality as label")
    rows = classify_quality(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["label"] == 1]
    bad = [r["kept"] for r in rows if r["label"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_nulls_blanks_and_empty_tables(spark):
    got = {(r["doc_id"], r["kept"]): r["quality"] for r in classify_quality(documents(spark)).collect()}
    assert all(not kept for (key, kept), q in got.items() if q == 0.0)
    assert sum(q == 0.0 for q in got.values()) >= 4
    assert classify_quality(documents(spark, [])).count() == 0
    assert classify_quality(documents(spark, [(1, None) + (None,) * 6])).collect()[0]["kept"] is False
