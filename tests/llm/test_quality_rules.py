import re
from collections import Counter

import numpy as np
from fixtures import document_rows, documents

from tabwright.llm.quality_rules import host_rules, repeated_words


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


def slow(rows, limit=0.5):
    counts = [(r[0], r[3], *slow_counts(r[1])) for r in rows]
    failed = [c[2] < 50 or 100 * c[6] > 50 * c[2] for c in counts]
    hosts = {}
    for c, bad in zip(counts, failed):
        n, k = hosts.get(c[1], (0, 0))
        hosts[c[1]] = n + 1, k + bad
    rates = np.array([k / n for n, k in hosts.values()])
    mean, chance = rates.mean(), np.mean([1 / n for n, _ in hosts.values()])
    real = (rates ** 2).mean() - mean ** 2 - mean * (1 - mean) * chance
    weight = min(1e4, max(1, mean * (1 - mean) / real - 1)) if real > 0 else 1e4
    rate = {h: (k + mean * weight) / (n + weight) for h, (n, k) in hosts.items()}
    return Counter((*c, bad, not bad and rate[c[1]] <= limit) for c, bad in zip(counts, failed))


def junk_host():
    texts = ["* * * | menu"] * 30 + [" ".join(f"w{i}x{k}" for i in range(60)) for k in range(5)]
    return [(2000 + i, t, "en", "junk", 1, None, None, None) for i, t in enumerate(texts)]


def test_matches_brute_force_in_both_joins(spark):
    rows = [r for r in document_rows() if len(r[1] or "") < 50_000] + junk_host() + [(3000, "a b c a b c # <x>\n\n \na\na\x0ba\na", "en", None, 0, None, None, None)]
    for limit in (200_000, 0):
        got = host_rules(documents(spark, rows), broadcast_hosts=limit).collect()
        assert Counter((r["doc_id"], r["source"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                        r["base_failed"], r["kept"]) for r in got) == slow(rows)
    verdicts = {r["doc_id"]: r for r in got}
    assert not verdicts[2030]["base_failed"] and not verdicts[2030]["kept"]  # a passing page of a failing host
    assert verdicts[2030]["host_rate"] > 0.5


def test_long_text_and_large_vocabulary():
    words = [f"w{i}".encode() for i in range(3000)]
    assert repeated_words(words) == 0 and repeated_words(words + words) == 6000
    assert repeated_words([b"a"] * 3) == 0 and repeated_words([b"a"] * 4) == 4 and repeated_words([]) == 0


def test_empty_table(spark):
    assert host_rules(documents(spark, [])).count() == 0
