import hashlib
import math
import re
import zlib
from collections import Counter

from fixtures import document_rows, documents

from tabwright.llm.importance import _bucket_blocks, bucket_counts, importance_resample


def slow_features(text, order=2):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    grams = [" ".join(words[i:i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def slow(rows, target, percent=25):
    found = [slow_features(r[1]) for r in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for r in target for b in slow_features(r[1])[1])
    total_s, total_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 10_000) / ((s[b] + 1.0) * (total_t + 10_000)))) for b in range(10_000)]
    out = []
    for r, (n, f) in zip(rows, found):
        h = int(hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        out.append([r[0], n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    order = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0], x[2], x[3]))
    for place, x in enumerate(order[: percent * len(order) // 100], 1):
        x[5] = place
    return Counter(map(tuple, out))


def benchmark_rows(rows):
    return [(i, r[1]) for i, r in enumerate(rows[:10])] + [(90, None), (91, ""), (92, "Two words"), (92, "Two words")]


def test_matches_brute_force(spark):
    rows = document_rows()
    target = benchmark_rows(rows)
    got = importance_resample(documents(spark, rows), spark.createDataFrame(target, "item_id long, text string")).collect()
    want = slow(rows, target)
    assert Counter(map(tuple, got)) == want
    assert sum(r["rank"] is not None for r in got) > 10
    assert all(r["weight"] == 0 for r in got if not r["n_features"])


def test_blocks_lose_no_run():
    text = "É one two\x00three, four five SIX " * 40 + "end"
    for order in (1, 2, 3, 5):
        want = slow_features(text, order)
        for size in (1, 7, 64, 1 << 20):
            blocks = list(_bucket_blocks(text, order, 10_000, size))
            assert sum(n for n, _ in blocks) == want[0]
            assert Counter(b for _, f in blocks for b in f) == Counter(want[1])
    assert not list(_bucket_blocks(None, 2, 10_000)) and not list(_bucket_blocks("", 2, 10_000))


def test_ties_go_to_the_smaller_key_and_copies_stand_alone(spark):
    rows = [(7, "a b c")] * 3 + [(8, "x y z"), (None, "a b c"), (None, None), (9, "")]
    got = importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"),
                              min_words=3, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    assert sum(r["rank"] is None for r in got) == 2
    ranks = [r["rank"] for r in got if r["doc_id"] == 7]
    assert max(ranks) - min(ranks) == 2


def test_target_like_texts_weigh_more(spark):
    rows = [(i, " ".join(f"plain{(i * 7 + k) % 50}" for k in range(40))) for i in range(40)]
    rows += [(100 + i, " ".join(f"goal{(i * 3 + k) % 9}" for k in range(40))) for i in range(10)]
    target = [(" ".join(f"goal{k % 9}" for k in range(200_000)),)]
    got = importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string"), percent=20).collect()
    assert min(r["weight"] for r in got if r["doc_id"] >= 100) > max(r["weight"] for r in got if r["doc_id"] < 100)
    assert sum(r["rank"] is not None for r in got if r["doc_id"] >= 100) == sum(r["rank"] is not None for r in got) == 10


def test_empty_tables(spark):
    assert importance_resample(documents(spark, []), documents(spark, [])).count() == 0
    assert bucket_counts(documents(spark, [])).count() == 0
