import re
from collections import Counter

import xxhash
from fixtures import document_rows, documents

from tabwright.llm.simhash import components, fingerprints, linked_pairs, near_duplicates


def slow_fingerprint(text, width=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(keyed, max_bits=4):
    fps = [f for _, f in keyed]
    group = list(range(len(fps)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    low = {}
    for i, (key, _) in enumerate(keyed):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return [low.get(find(i)) for i in range(len(fps))]


def test_matches_brute_force(spark):
    rows = document_rows()
    keyed = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = Counter((k, f"{f:016x}", c) for (k, f), c in zip(keyed, slow_components(keyed)))
    got = near_duplicates(documents(spark)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert max(Counter(r["component_id"] for r in got).values()) > 4  # blanks, nulls and copies meet


def test_given_tables_match_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    keyed = [(r[0], slow_fingerprint(r[1])) for r in rows]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in
           near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == {k: (f"{f:016x}", c) for (k, f), c in zip(keyed, slow_components(keyed))}


def test_links_lose_no_pair(spark):
    import random
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:20]:
        for bits in range(1, 7):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), bits)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (0, 2, 4):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
        assert sorted(map(tuple, linked_pairs(table, bits).collect())) == sorted(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 201: 200}


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert near_duplicates(documents(spark, [(7, None) + (None,) * 6])).collect()[0]["component_id"] == 7


def test_long_text_in_blocks(spark):
    text = " ".join(f"w{i % 977}x{i % 13}" for i in range(400_000))
    row = fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row["fp"] % 2**64 == slow_fingerprint(text)


def test_joins_are_not_left_to_broadcasts(spark):
    classes = spark.range(5).selectExpr("id * 7 AS fp")
    plan = linked_pairs(classes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
