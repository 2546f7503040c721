"""Registered queries of the text operators; SQL counterparts where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query


@query("op5_simhash_near_dedup")
def _op5(t):
    from .simhash import near_duplicates
    return near_duplicates(t("documents"), width=4, max_bits=4)


WINDOWS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
spots AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, w[i + 1:i + 10] AS win FROM spots),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
places AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM places JOIN wins ON places.w[places.i + 1:places.i + places.n] = wins.win),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items,
                 string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


@query("op10_benchmark_decontamination", WINDOWS_SQL)
def _op10(t):
    from .decontamination import contamination
    found = contamination(t("documents"), t("benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op1_packing")
def _op1(t):
    import public_tokenizers

    from .packing import pack
    from .tokens import added_tokens
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(t("documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024, end_id=0, added=added)


@query("op8_quality_classifier")
def _op8(t):
    from .quality_model import classify_quality
    return classify_quality(t("documents"), threshold=0.5, train_rows=20_000)


@query("op2_token_counts")
def _op2(t):
    import public_tokenizers

    from .token_counts import scrubbed_counts
    from .tokens import added_tokens
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return scrubbed_counts(t("documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added)


@query("op3_lm_scoring")
def _op3(t):
    from .common import written
    from .lm_scoring import fit_network, score_texts, word_counts
    docs = t("documents")
    counts = written(word_counts(docs), "words")
    return score_texts(docs, *fit_network(docs, rounds=2, counts=counts), counts=counts)


@query("op4_toxicity")
def _op4(t):
    from .toxicity import score_toxicity
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    scored, _ = score_toxicity(t("documents"), t("labels").filter(~held_out), label="toxic", train_rows=20_000)
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted, "label_posterior")


LINES_SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM d),
pages AS (SELECT source, count(*) AS n FROM d GROUP BY source),
common AS (SELECT e.source, e.line FROM each e JOIN pages p ON e.source IS NOT DISTINCT FROM p.source
           GROUP BY e.source, e.line, p.n HAVING count(*) >= 5 AND count(*) > CAST(0.05 AS DOUBLE) * p.n),
listed AS (SELECT source, list(line) AS bad FROM common GROUP BY source),
k AS (SELECT d.*, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, CAST([] AS VARCHAR[])), trim(x))) AS kept
      FROM d LEFT JOIN listed l ON d.source IS NOT DISTINCT FROM l.source),
u AS (SELECT *, len(list_filter(kept, lambda x: trim(x) <> '')) = 0 AS whole FROM k)
SELECT doc_id, CASE WHEN whole THEN text ELSE array_to_string(kept, chr(10)) END AS text,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines,
       CASE WHEN whole THEN 0 ELSE len(lines) - len(kept) END AS n_dropped FROM u"""


@query("op6_line_dedup", LINES_SQL)
def _op6(t):
    from .line_dedup import line_dedup
    return line_dedup(t("documents"), "source", "text", ratio=0.05, min_pages=5).select("doc_id", "text", "n_lines", "n_dropped")


def _licences_sql() -> str:
    from . import licences

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        def put(x: str, pattern: str, usual: str) -> str:
            return f"regexp_replace({x}, {quoted(pattern)}, {quoted(usual)}, 'g')"

        x = put(put(x, licences.STATEMENT, f"{chr(92)}1{chr(10)}{chr(92)}6"), licences.COPYRIGHT, chr(10))
        x = put(f"translate({x}, {quoted(licences.MARKS)}, {quoted(' ' * len(licences.MARKS))})", licences.PUNCTUATION, " ")
        for pattern, usual in licences.SPELLINGS:
            x = put(x, pattern, usual)
        return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"

    texts = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licences.known_texts())
    digests = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licences.DIGESTS)
    return f"""
WITH known AS (SELECT licence, sha256(array_to_string({lines('lower(t)')}, ' ')) AS digest FROM (VALUES {texts}) AS v(licence, t)
               UNION SELECT * FROM (VALUES {digests}) AS g(licence, digest)),
d AS (SELECT doc_id, {lines('lower(text)')} AS lines FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, TRUE AS whole, array_to_string(lines, ' ') AS part FROM d UNION ALL SELECT doc_id, FALSE, unnest(list_distinct(lines)) FROM d),
found AS (SELECT u.doc_id, u.whole, k.licence FROM units u JOIN known k ON sha256(u.part) = k.digest AND u.part <> '')
SELECT d.doc_id, min(CASE WHEN f.whole THEN f.licence END) AS licence,
       coalesce(string_agg(DISTINCT CASE WHEN NOT f.whole THEN f.licence END, ',' ORDER BY CASE WHEN NOT f.whole THEN f.licence END), '') AS notices
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


@query("op7_licence_scan", _licences_sql())
def _op7(t):
    from .licences import scan_licences
    return scan_licences(t("documents")).select("doc_id", "licence", F.array_join("notices", ",").alias("notices"))


HOSTS_SQL = r"""
WITH b AS (SELECT doc_id, source, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM spots),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM b),
c AS (SELECT b.doc_id, b.source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
      FROM b JOIN l ON b.doc_id = l.doc_id LEFT JOIN covered v ON b.doc_id = v.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS pages, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS failed FROM f GROUP BY source),
m AS (SELECT avg(failed / pages) AS mean, avg((failed / pages) * (failed / pages)) AS square, avg(1 / pages) AS chance FROM h),
s AS (SELECT mean, mean * (1 - mean) AS spread, square - mean * mean - mean * (1 - mean) * chance AS remainder FROM m),
p AS (SELECT least(1 - 1e-6, greatest(1e-6, mean)) AS mean,
             CASE WHEN remainder > 0 THEN least(10000, greatest(1, spread / remainder - 1)) ELSE 10000 END AS weight FROM s)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.failed + p.mean * p.weight) / (h.pages + p.weight) <= 0.5 AS kept,
       round((h.failed + p.mean * p.weight) / (h.pages + p.weight), 6) + 0 AS host_rate
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p"""


@query("op9_quality_rules", HOSTS_SQL)
def _op9(t):
    from .quality_rules import host_rules
    found = host_rules(t("documents"), host="source", min_words=50, max_repeat_percent=50, max_host_rate=0.5)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept", (F.round("host_rate", 6) + 0.0).alias("host_rate"))


GAINS_SQL = r"""
WITH words AS (SELECT doc_id, benchmark, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
               FROM (SELECT doc_id, text, FALSE AS benchmark FROM documents UNION ALL SELECT item_id, text, TRUE FROM benchmark)),
runs AS (SELECT doc_id, benchmark, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
n AS (SELECT doc_id, benchmark, f, count(*) AS n FROM runs GROUP BY ALL),
tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t
        FROM range(256) AS r(i)),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)),
                    lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS b FROM h, tab),
tally AS (SELECT b, sum(CASE WHEN benchmark THEN 0 ELSE n END) AS s, sum(CASE WHEN benchmark THEN n ELSE 0 END) AS t FROM n JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * (SELECT sum(s) + 10000.0::DOUBLE FROM tally)
                      / ((s + 1.0::DOUBLE) * (SELECT sum(t) + 10000.0::DOUBLE FROM tally)))) AS gain FROM tally),
m AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM n JOIN b USING (f) JOIN g USING (b) WHERE NOT benchmark GROUP BY doc_id),
d AS (SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('7:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
      FROM words w LEFT JOIN m ON w.doc_id = m.doc_id WHERE NOT benchmark),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT 25 * count(*) // 100 FROM z WHERE n_words >= 20) THEN place END AS rank FROM p"""


@query("op11_importance_resampling", GAINS_SQL)
def _op11(t):
    from .importance import importance_resample
    drawn = importance_resample(t("documents"), t("benchmark"), order=2, buckets=10_000, min_words=20, percent=25, salt="7")
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

URLS_SQL = f"""
WITH r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
           FROM (VALUES {', '.join(str(x) for x in URL_RULES)}) AS v(rule, verdict)),
p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s)
SELECT h.page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY h.page_id, host, path"""


@query("op12_url_filters", URLS_SQL)
def _op12(t):
    from .urls import filter_urls
    pages = t("pages")
    rules = pages.sparkSession.createDataFrame(URL_RULES, "rule string, verdict string")
    return filter_urls(pages, rules, key="page_id", url="url", default="allow")


@query("op13_periodic_runs")
def _op13(t):
    from .runs import periodic_runs
    docs = t("documents", "doc_id", "text", "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) AS h")
    docs = docs.withColumn("words", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.expr("CAST(h div 10 % greatest(n, 1) AS INT)"))
    docs = docs.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + h div 10 % 8) AS INT)"))
    head, cycle = F.expr("slice(words, 1, a)"), F.expr("slice(words, a + 1, p)")
    planted = F.array_join(F.slice(F.concat(head, F.flatten(F.array_repeat(cycle, F.expr("CAST(ceil((n - a) / p) AS INT)")))), F.lit(1), F.col("n")), " ")
    docs = docs.select("doc_id", F.when(F.expr("h % 10 = 0 AND n > 0"), planted).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(docs, min_length=6, repeats=4)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("low"), (-r.period).alias("few"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.low")).alias("start"), F.col("longest.length").alias("length"),
        (-F.col("longest.few")).alias("period"), F.expr("longest.length * 1000 div -longest.few").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
