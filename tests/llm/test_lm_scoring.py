import random
from collections import Counter

import numpy as np
from fixtures import document_rows, documents

from tabwright.llm.lm_scoring import CLASSES, COMMON, GROUP, PAD, SIDE, WindowNetwork, class_ids, common_words, fit_network, score_texts, windows, words_of
from tabwright.llm.lm_scoring import _Classes

FOLDER = "/root/testdata/sf0.01"


def test_windows_look_to_both_sides():
    ids = np.array([5, 6, 7, 8])
    one = [[PAD, PAD, 6, 7], [PAD, 5, 7, 8], [5, 6, 8, PAD], [6, 7, PAD, PAD]]
    none, last = np.zeros(0, np.int64), np.array([9])
    assert windows([ids]).tolist() == one
    assert windows([none, ids, none, last, ids]).tolist() == [*one, [PAD] * 4, *one]
    assert windows([none]).shape == windows([]).shape == (0, 2 * SIDE)


def test_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(0)
    net, ids = WindowNetwork.fresh(), rng.integers(0, 5, 3000)
    ids[1::2] = (ids[:-1:2] + 1) % 5  # every second token follows from the one before
    before = -net.log_probs(windows([ids]), ids).mean()
    squares = [np.full(a.shape, 0.1) / 3000 for a in net.arrays]
    for _ in range(60):
        net.step(windows([ids]), ids, squares, 0.1)
    assert -net.log_probs(windows([ids]), ids).mean() < 0.75 * min(before, np.log(5) + 0.4)
    same = WindowNetwork.from_flat(net.flat())
    assert np.allclose(same.log_probs(windows([ids]), ids), net.log_probs(windows([ids]), ids), atol=1e-5)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    net, ids = WindowNetwork.fresh(3), rng.integers(0, CLASSES, 400)
    context = windows([ids])
    steps = WindowNetwork(*(a.copy() for a in net.arrays))
    squares = [np.full(a.shape, 1e12) for a in net.arrays]  # so that a step is the gradient over a million
    steps.step(context, ids, squares, 1e12)
    for k, place in ((0, (1, int(ids[7]), 3)), (1, (5,)), (2, (3, 4)), (3, (2,)), (4, (int(ids[0]) // GROUP, 2, 7)), (5, (int(ids[3]) // GROUP, 1))):
        loss = []
        for d in (1e-2, -1e-2):
            moved = WindowNetwork(*(a.astype(np.float64) for a in net.arrays))
            moved.arrays[k][place] += d
            loss.append(-moved.log_probs(context, ids).astype(np.float64).mean())
        gradient = (net.arrays[k][place] - steps.arrays[k][place]) / 1e6
        assert abs(gradient - (loss[0] - loss[1]) / 2e-2) < 2e-4


def test_probabilities_add_up_to_one():
    net, context = WindowNetwork.fresh(2), np.array([[1, 2, 3, 4], [PAD, PAD, 7, PAD]])
    total = sum(np.exp(net.log_probs(context, np.full(2, c))) for c in range(CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_common_words_are_counted_over_all_texts(spark):
    rows = document_rows()
    counts = Counter(w for r in rows for w in (r[1] or "").encode().lower().split())
    want = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]
    assert common_words(documents(spark, rows)) == want


def test_scores_match_a_plain_loop_and_prefer_real_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words, net = fit_network(docs, rounds=2)
    texts = [r["text"] for r in docs.where("lang = 'en' and n_chars between 400 and 2000").limit(40).collect()]
    rng, shuffled = random.Random(1), []
    for t in texts:
        w = t.split()
        rng.shuffle(w)
        shuffled.append(" ".join(w))
    table = spark.createDataFrame(list(enumerate(texts + shuffled)) + [(None, texts[0]), (999, None), (998, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_texts(table, words, net).collect()}
    classes = _Classes({w: i for i, w in enumerate(words)})
    for i, t in enumerate(texts[:10]):
        ids, total = class_ids(words_of(t), classes), 0.0
        for at, token in enumerate(ids):
            side = [ids[at + d] if 0 <= at + d < len(ids) else PAD for d in (-2, -1, 1, 2)]
            h = np.tanh(sum(net.embed[k][c] for k, c in enumerate(side)) + net.hidden)
            for z, own in ((h @ net.top + net.top_bias, token // GROUP), (h @ net.leaf[token // GROUP] + net.leaf_bias[token // GROUP], token % GROUP)):
                total += z[own] - np.log(np.exp(z).sum())
        assert abs(got[i]["pseudo_log_likelihood"] - total) < 1e-2 * max(1, abs(total)) and got[i]["n_tokens"] == len(ids)
    real = np.mean([got[i]["mean_log_prob"] for i in range(len(texts))])
    mixed = np.mean([got[len(texts) + i]["mean_log_prob"] for i in range(len(texts))])
    assert real > mixed and real > -np.log(CLASSES)
    assert got[999]["n_tokens"] == 0 and got[999]["pseudo_log_likelihood"] == 0 and got[998]["mean_log_prob"] is None


def test_empty_table_and_clashing_columns(spark):
    words, net = fit_network(documents(spark, []))
    assert words == [] and score_texts(documents(spark, []), words, net).count() == 0
    assert score_texts(documents(spark), words, net).columns == ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_prob"]


def test_sums_by_class_and_outputs_by_group():
    from tabwright.llm import lm_scoring as L

    rng = np.random.default_rng(2)
    rows, own = rng.normal(size=(500, 4)), rng.choice(40, 500) * 2
    want = np.zeros((90, 4))
    np.add.at(want, own, rows)
    assert np.allclose(L._sums_by_class(np.ascontiguousarray(rows.T), own, 90), want)
    net, group = L.WindowNetwork.fresh(1, 256), rng.integers(3, 9, 300)
    h = rng.normal(size=(300, L.WIDTH)).astype(np.float32)
    order, cuts = L._by_group(group)
    z = net._leaves(h[order], cuts)
    assert np.allclose(z, [h[i] @ net.leaf[group[i]] + net.leaf_bias[group[i]] for i in order], atol=1e-5)


def test_softmax_by_class_adds_as_numpy_does_along_a_row():
    from tabwright.llm import lm_scoring as L
    rng = np.random.default_rng(6)
    for classes in (4, 8, 16, 20, 52, 128, 132):
        z = (4 * rng.normal(size=(50, classes))).astype(np.float32)
        down = z - z.max(axis=1, keepdims=True)
        assert np.array_equal(L._log_softmax(z).T, down - np.log(np.exp(down).sum(axis=1, keepdims=True)))


def test_a_word_is_looked_up_once():
    from tabwright.llm import lm_scoring as L
    slots = L._Slots({b"the": 3}, 3)
    slots.missed = []
    found = class_ids([b"the", b"rare", b"the", b"rare"], slots).tolist()
    assert found[0] == found[2] == 3 and found[1] == found[3] < 3
    assert slots.missed == [b"rare", b"rare"] and len(slots) == 1
