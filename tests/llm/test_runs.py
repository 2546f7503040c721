import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import document_rows, documents

from tabwright.llm import runs
from tabwright.llm.queries import _op13
from tabwright.llm.runs import CommonExtensions, block_runs, periodic_runs

SPACE = r"[\x20\x09-\x0D]+"


def slow_runs(words, least=6, repeats=4):
    found = {}
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, repeats * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i) + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(key, text):
    words = [w for w in re.split(SPACE, text or "") if w]
    n = len(words)
    if key is None or not n or zlib.crc32(str(key).encode()) % 10:
        return words
    g = zlib.crc32(str(key).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def slow_row(key, text):
    words = planted(key, text)
    found = slow_runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (key, len(found), *best, digest("".join(f"{s},{n},{p}\n" for s, n, p in found)), digest(collapse(words, found)))


@pytest.mark.parametrize("short, chunk", [(256, 1 << 21), (2, 50), (0, 1)])
def test_blocks_match_brute_force(monkeypatch, short, chunk):
    monkeypatch.setattr(runs, "SHORT_PERIODS", short)
    monkeypatch.setattr(runs._grid, "__defaults__", (chunk,))
    rng = random.Random(1)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 12)):
            n, k = rng.choice([0, 1, 5, 6, 7, 30, 100, 300]), rng.choice([1, 2, 3, 8])
            words = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n > 20 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 4))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        for repeats, least in ((4, 6), (2, 2), (3, 9)):
            got = block_runs(docs, least, repeats).T.tolist()
            assert got == [[d, *r] for d, words in enumerate(docs) for r in slow_runs(words, least, repeats)]


@pytest.mark.parametrize("codes", [[0] * 200, [i % 7 for i in range(200)], [], [5], list(range(90)) * 2])
def test_common_extensions(codes):
    rng = random.Random(2)
    table = CommonExtensions(np.array(codes, np.int64))
    n = len(codes)
    pairs = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(500)]
    pairs = [(i, j) for i, j in pairs if i != j]
    want = [next((k for k in range(n + 1) if max(i, j) + k >= n or codes[i + k] != codes[j + k])) for i, j in pairs]
    if pairs:
        assert table.lengths(*np.array(pairs).T).tolist() == want
    inside = table.samples
    assert len(inside) <= (n // 31 + 1) * 6  # only the suffixes of the cover are sorted
    tails = [tuple(table.codes[s:]) for s in inside.tolist()]
    order = np.argsort(table.place).tolist()
    assert sorted(table.place.tolist()) == list(range(len(inside)))
    assert all(table.lengths(inside[[a]], inside[[b]])[0] == next(k for k in range(n + 40) if tails[a][k] != tails[b][k]) for a, b in zip(order, order[1:]) if n)


def test_rows_match_brute_force(spark):
    rows = document_rows()
    rows += [(900 + i, " ".join(["x"] * i), "en", "s", 0, None, None, None) for i in range(9)]
    rows += [(950, "a b c " * 4 + "z " + "a b " * 9, "en", "s", 0, None, None, None), (951, "É\u00a0x\x1f " * 8, "en", "s", 0, None, None, None)]
    want = Counter()
    for r in rows:
        words = [w for w in re.split(SPACE, r[1] or "") if w]
        found = slow_runs(words) if len(words) < 10_000 else None
        want[r[0], len(words), found if found is None else tuple(found), found if found is None else collapse(words, found)] += 1
    for size in (1 << 20, 1):
        got = Counter()
        for r in periodic_runs(documents(spark, rows), block_words=size).collect():
            long = r["n_words"] >= 10_000
            got[r["doc_id"], r["n_words"], None if long else tuple(map(tuple, r["runs"])), None if long else r["collapsed"]] += 1
        assert got == want


def test_query_matches_brute_force(spark):
    odd = spark.createDataFrame([(None, "a " * 9), (10, None), (11, ""), (12, "one"), (12, "one"), *((2000 + i, "q w e r t y u i o p a s") for i in range(60))], "doc_id long, text string")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = given.unionByName(odd)
    got = _op13(lambda name, *exprs: docs.selectExpr(*exprs) if exprs else docs).collect()
    rows = docs.collect()
    assert Counter(map(tuple, got)) == Counter(slow_row(*r) for r in rows)
    assert sum(r["n_runs"] > 0 for r in got) >= 10


def test_long_periodic_text(spark):
    words = [f"w{i % 1000}" for i in range(400_000)]
    text = "head " + " ".join(words) + " tail"
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in row["runs"]] == [(1, 400_000, 1000)]
    assert row["collapsed"] == "head " + " ".join(words[:1000]) + " tail"


def test_empty_table(spark):
    assert periodic_runs(documents(spark, [])).count() == 0
