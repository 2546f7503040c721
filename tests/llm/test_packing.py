import random
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import public_tokenizers
from fixtures import document_rows, documents
from tokenizers import Tokenizer

from tabwright.llm.packing import best_fill, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def test_best_fill_is_the_closest_subset_sum():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 70)
        best = max((sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room), default=0)
        used, counts = best_fill(Counter(items), room), Counter(items)
        assert sum(x * n for x, n in used.items()) == best and all(0 < n <= counts[x] for x, n in used.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    counts = {rng.randint(1, 1024): rng.randint(1, 4000) for _ in range(300)}
    counts[1024], counts[700] = 50, 1_000_000  # one very common length
    rows = plan(counts, 1024)
    assert len(rows) < 40_000
    spans, filled = defaultdict(list), {}
    for length, first, last, copies, sequence, offset in rows:
        spans[length].append((first, last))
        filled.setdefault((sequence, (last - first) // copies), []).append((offset, copies * length))
    for length, n in counts.items():
        ends = sorted(spans[length])
        assert ends[0][0] == 0 and ends[-1][1] == n and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    for slots in filled.values():
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
        assert at <= 1024


def check(rows, got, tokens):
    want = defaultdict(Counter)
    for key, text, *_ in rows:
        ids = [*tokens(text), 0]
        for at in range(0, len(ids), 1024):
            want[key][at, len(ids[at:at + 1024]), crc32(np.array(ids[at:at + 1024], "<u4").tobytes()), len(ids)] += 1
    have, sequences = defaultdict(Counter), defaultdict(list)
    for r in got:
        have[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(1024 - sum(n for _, n in p) for p in sequences.values()) / (1024 * max(1, len(sequences)))


def test_packs_every_id_once(spark):
    rows = document_rows()
    check(rows, pack(documents(spark, rows), PATH).collect(), lambda t: TOKENIZER.encode(t or "", add_special_tokens=False).ids)
    assert pack(documents(spark, []), PATH).count() == 0


def test_given_tables_have_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    padding = check(rows, pack(docs, PATH).collect(), lambda t: TOKENIZER.encode(t or "", add_special_tokens=False).ids)
    assert padding < 0.01


def test_padding_shrinks_with_the_corpus():
    rng = random.Random(6)
    for n in (1_000, 100_000):
        counts = Counter(min(1024, int(rng.paretovariate(0.7) * 40)) for _ in range(n))
        rows = plan(counts, 1024)
        sequences = max(r[4] + (r[2] - r[1]) // r[3] for r in rows)
        assert 1024 * sequences - sum(k * v for k, v in counts.items()) < 0.0005 * 1024 * sequences + 1024
