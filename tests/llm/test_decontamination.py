import re
from collections import Counter

import pytest
from fixtures import document_rows, documents

from tabwright.llm.decontamination import contamination

ITEMS = "item_id long, text string, key string"


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow(rows, items, window=10):
    windows = []
    for item, text, *_ in items:
        w = words_of(text)
        windows += [(item, w[i:i + window]) for i in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for key, text, *_ in rows:
        w = words_of(text)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(item)
        out.append((key, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


def bench_items(rows):
    texts = [r[1] for r in rows]
    part = " ".join(words_of(texts[10])[2:20])
    return [(1, part, "x"), (2, texts[11], "x"), (10, part + " unseen", "x"), (3, None, "x"), (4, "", "x"), (5, "..!", "x"), (6, "É è", "x"),
            (7, "two WORDS", "x"), (8, "one", "x"), (9, "never seen words", "x"), (1, part, "x"), (None, " ".join(words_of(texts[12])[:12]), "x")]


def compare(spark, rows, items, **more):
    got = contamination(documents(spark, rows), spark.createDataFrame(items, ITEMS), **more).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == slow(rows, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)


@pytest.mark.parametrize("block", [100_000, 7])
def test_matches_brute_force(spark, block):
    rows = [r for r in document_rows() if len(r[1] or "") < 50_000]
    rows.append((900, " ".join([rows[10][1]] * 30), "en", "src0", 0, None, None, None))  # many overlapping occurrences
    compare(spark, rows, bench_items(rows), block_windows=block)


def test_given_tables_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = contamination(docs, bench).collect()
    want = slow([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    assert any(r["contaminated"] for r in got)


def test_empty_tables(spark):
    rows = document_rows()[:5]
    compare(spark, [], bench_items(document_rows()))
    compare(spark, rows, [])
    compare(spark, rows, [(1, None, "x")])
