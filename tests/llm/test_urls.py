import random
from collections import Counter

import pytest

from tabwright.llm.urls import UrlIndex, clean_rules, filter_urls, host_and_path, index_bytes

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URLS = ["http://a.example.net/en/1", "https://A.EXAMPLE.NET/EN/1", "http://net/", "http://net", "net/", "http://x.net?q=/en/", "http://b.org/fr/#x",
        "http://b.org/frank", "http://example.com/de/a?b", "http://notexample.com/de/a", "http://example.net.com/en/", "http://u@net:80/x", None, "", "://",
        "ftp://É.net/ü", "http://a..net/x", "http://.net/x", "http://net./x", "x://y://z.net/en/", "http://" + "a." * 50_000 + "net/x" * 1000, "http://h.net\n/en/"]


def slow(urls, rules, default="allow"):
    both = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        if host:
            both[host, slash + path] = max(verdict, both.get((host, slash + path), ""))
    out = []
    for key, url in urls:
        host, path = host_and_path(url)
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in both.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((key, host, path, *(max(fits)[2:] if fits else (None, default))))
    return Counter(out)


def many(seed=5, n=400):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("abÉ") for _ in range(rng.randint(1, 2)))
    host = lambda: ".".join(part() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + part() for _ in range(rng.randint(0, 3))) + rng.choice(["", "/"])
    rules = [(host() + path(), rng.choice(["allow", "block"])) for _ in range(150)]
    return [(i, f"http://{host()}{path()}{rng.choice(['', '?q', '#/a'])}") for i in range(n)], rules + [rules[0], (rules[1][0], "block"), (rules[1][0], "allow")]


def test_parts():
    assert host_and_path("http://A.b/C?d#e") == ("a.b", "/C")
    assert host_and_path("http://A.b?d/e") == ("a.b", "")
    assert host_and_path("http://A.b#/e") == ("a.b", "")
    assert host_and_path("http:/a") == host_and_path(None) == ("", "")
    assert host_and_path("a?://B/c") == ("b", "/c")


@pytest.mark.parametrize("max_rules", [1_000_000, 0])
def test_matches_brute_force_in_both_ways(spark, max_rules):
    for urls, rules in ([*enumerate(URLS), (None, URLS[0]), (3, URLS[3])], RULES), many():
        pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in urls], "page_id long, url string, rule string, key string")
        got = filter_urls(pages, spark.createDataFrame(rules, "rule string, verdict string"), max_rules=max_rules).collect()
        assert Counter(map(tuple, got)) == slow(urls, rules)


def test_colliding_digests_are_told_apart():
    urls, rules = many(seed=6)
    cleaned = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        cleaned[host, slash + path] = max(verdict, cleaned.get((host, slash + path), ""))
    triples = [(*k, v) for k, v in cleaned.items()]
    digest = lambda s: len(s) % 3
    for index in UrlIndex(index_bytes(triples)), UrlIndex(index_bytes(triples, digest), digest):
        got = index.judge([u for _, u in urls])
        assert Counter((k, h, p, r, v or "allow") for (k, _), (h, p, r, v) in zip(urls, got)) == slow(urls, rules)


def test_odd_rules_and_empty_tables(spark):
    rules = spark.createDataFrame([(None, "block"), ("/x", "block"), ("a.b", "block"), ("A.c/D", "maybe"), ("Q.c/D", "allow"), ("e/", None)], "rule string, verdict string")
    assert sorted(map(tuple, clean_rules(rules).collect())) == [("a.b", "", "block"), ("q.c", "/D", "allow")]
    pages = spark.createDataFrame([(1, "http://x.a.b"), (2, "http://a.b?x"), (3, "http://a.bc")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in filter_urls(pages, rules).collect()} == {1: "a.b", 2: "a.b", 3: None}
    assert filter_urls(pages.limit(0), rules).count() == 0
    for limit in (10, -1):
        assert {r["verdict"] for r in filter_urls(pages, rules.limit(0), default="block", max_rules=max(limit, 0)).collect()} == {"block"}
