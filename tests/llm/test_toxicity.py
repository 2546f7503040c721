import random
from zlib import crc32

import numpy as np
from fixtures import document_rows, documents, sentence

from tabwright.llm.toxicity import score_toxicity, stems, text_terms, text_words

LABELS = "doc_id long, toxic int, score string"


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = sentence(rng, 120).split()
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(120)] = rng.choice(["grobka", "grobkalo", "Grobkami"] if i % 16 else ["idiot", "scum!"])
        rows.append((i, " ".join(words), "en", "s", 1, None, None, None))
        labels.append((i, int(toxic), "x"))
    return rows, labels


def test_stems_and_counts():
    assert stems("grobka") == ["gro", "grob", "grobk", "grobka", "grobka$"]
    assert text_terms(text_words("Grob grob, grobs"), frozenset({"gro", "grob$"})) == {"gro": 3, "grob$": 2}


def test_learns_new_stems_and_holds_out(spark):
    rows, labels = corpus()
    learnable = [x for x in labels if crc32(str(x[0]).encode()) % 4 != 2] + [(None, 1, "x"), (5, None, "x"), (7, 0, "y")]
    scored, model = score_toxicity(documents(spark, rows), spark.createDataFrame(learnable, LABELS))
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    held = [(got[i], t) for i, t, _ in labels if crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == t for s, t in held]) > 0.95
    assert min(s for s, t in held if t) > max(np.quantile([s for s, t in held if not t], 0.9), 0.3)
    assert all(0 <= s <= 1 for s in got.values()) and any(t.endswith("grob") for t in model.lexicon.terms)


def test_given_tables_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    every = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scored, _ = score_toxicity(docs, labels.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    got = [(r["score"], every[r["doc_id"]]) for r in scored.collect() if crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] in every]
    yes, no = ([s for s, t in got if t == v] for v in (1, 0))
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in no] for a in yes])
    hits, false = np.mean([s >= 0.3 for s in yes]), np.mean([s >= 0.3 for s in no])
    assert auc > 0.85 and hits > 0.75 and false < 0.03, (auc, hits, false)


def test_no_labels_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    rows = document_rows() + [(950, "you idiot moron, you trash", "en", "s", 1, None, None, None)]
    got = {}
    for r in score_toxicity(documents(spark, rows), none)[0].collect():
        got.setdefault(r["doc_id"], []).append(r["label_posterior"])
    assert sum(map(len, got.values())) == len(rows) and got[950][0] > max(s for k, v in got.items() if k != 950 for s in v)
    assert score_toxicity(documents(spark, []), none)[0].count() == 0
