from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from fixtures import document_rows, documents

from tabwright.llm.lm_scoring import CLASSES, COMMON, HASHED, class_count, class_ids, fit_network, score_texts, windows, word_counts, words_of
from tabwright.llm.lm_scoring import WindowNetwork, _Classes


def class_sum(net, ids):
    return float(net.log_probs(windows([ids], net.classes), ids).sum())


@pytest.mark.parametrize("frequent", [200_000, 40, 0])  # all words by value, some, and all through the join
def test_every_word_has_its_own_probability(spark, frequent):
    docs = documents(spark)
    counts = word_counts(docs)
    words, net = fit_network(docs, counts=counts)
    seen = Counter(w for r in document_rows() for w in (r[1] or "").encode().lower().split())
    shared = {w: n for w, n in seen.items() if w not in words}
    totals = Counter()
    for w, n in shared.items():
        totals[crc32(w) % HASHED] += n
    texts = [document_rows()[0][1], document_rows()[0][1] + " unseenword", "one one x_y", None]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), words, net, counts=counts, frequent=frequent).collect()
    assert len(got) == len(rows)
    classes = _Classes({w: i for i, w in enumerate(words)})
    for r in got:
        text = (texts[1] if r["doc_id"] is None else texts[r["doc_id"]]) or ""
        second = sum(np.log(shared.get(w, 1) / (totals[crc32(w) % HASHED] + 1)) for w in text.encode().lower().split() if w not in words)
        assert r["pseudo_log_likelihood"] == pytest.approx(class_sum(net, class_ids(words_of(text), classes)) + second, abs=1e-3)


def test_rare_words_of_the_same_class_score_apart(spark):
    rows = [(i, " ".join(f"c{k}" for k in range(COMMON)) + " often" * 5 + " once", "en", "s", 0, 0.0, True, "") for i in range(40)]
    docs = documents(spark, rows)
    counts = word_counts(docs)
    words, net = fit_network(docs, counts=counts)
    assert b"once" not in words
    noise = next(f"noise{i}" for i in range(10_000) if crc32(f"noise{i}".encode()) % HASHED == crc32(b"once") % HASHED)
    table = spark.createDataFrame([(1, "c1 once c2"), (2, f"c1 {noise} c2")], "doc_id long, text string")
    got = {r["doc_id"]: r["mean_log_prob"] for r in score_texts(table, words, net, counts=counts).collect()}
    assert got[1] > got[2] + 1


def test_classes_grow_with_the_vocabulary():
    assert class_count(0) == class_count(1 << 17) == CLASSES
    assert class_count(1 << 21) == 2 * CLASSES and class_count(1 << 25) == 4 * CLASSES
    net = WindowNetwork.fresh(0, 2 * CLASSES)
    assert WindowNetwork.from_flat(net.flat(), 2 * CLASSES).classes == 2 * CLASSES and np.isfinite(class_sum(net, np.arange(2 * CLASSES)))
