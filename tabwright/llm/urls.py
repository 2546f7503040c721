"""URL filter: rules as a sorted array of 64-bit digests in a memory-mapped file, probed by binary search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_rows, scratch_path
from .common import arrow_pass, renamed

MAX_RULES = 1_000_000
VERDICTS = ("allow", "block")
_HOST_END, _PATH_END = re.compile("[/?#]"), re.compile("[?#]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case, and from there up to ``?``, ``#`` or the end."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    end = _HOST_END.search(url, at + 3)
    if end is None:
        return url[at + 3:].translate(_LOWER), ""
    stop = _PATH_END.search(url, end.start())
    return url[at + 3:end.start()].translate(_LOWER), url[end.start():stop.start() if stop else len(url)]


def digest64(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def index_bytes(rules: Iterable[tuple[str, str, str]], digest: Callable[[str], int] = digest64) -> bytes:
    """The index file of (host, path, verdict) rules, one for each host and path.

    A rule is an entry ``host + path`` with its verdict; a host with rules is an
    entry ``/host`` of its own, with the lengths of its rules' paths. Entries are sorted by
    digest, then text. Layout, all little-endian 64-bit numbers but the texts:
    entries, lengths, longest host | digests | offsets of texts | numbers | lengths | texts.
    """
    import numpy as np

    paths: dict[str, set[int]] = {}
    entries = []
    for host, path, verdict in rules:
        paths.setdefault(host, set()).add(len(path))
        entries.append((host + path, VERDICTS.index(verdict)))
    lengths: list[int] = []
    for host, sizes in paths.items():
        entries.append((f"/{host}", len(lengths) << 32 | len(sizes)))
        lengths += sorted(sizes, reverse=True)
    entries = sorted((digest(text), text.encode("utf-8", "surrogatepass"), number) for text, number in entries)
    head = np.array([len(entries), len(lengths), max(map(len, paths), default=0)], "<u8")
    digests = np.array([d for d, _, _ in entries], "<u8")
    offsets = np.cumsum([0, *(len(t) for _, t, _ in entries)]).astype("<u8")
    numbers = np.array([n for _, _, n in entries], "<u8")
    return b"".join([*(a.tobytes() for a in (head, digests, offsets, numbers, np.array(lengths, "<u8"))), *(t for _, t, _ in entries)])


class UrlIndex:
    """Answers from an index file: ``data`` is its bytes, memory-mapped or not."""

    def __init__(self, data, digest: Callable[[str], int] = digest64):
        import numpy as np

        self.digest = digest
        whole = np.frombuffer(data, np.uint8)
        n, n_lengths, self.longest = (int(x) for x in whole[:24].view("<u8"))
        ends = np.cumsum([24, 8 * n, 8 * (n + 1), 8 * n, 8 * n_lengths])
        self.digests, self.offsets, self.numbers, self.lengths = (whole[a:b].view("<u8") for a, b in zip(ends, ends[1:]))
        self.texts = whole[ends[-1]:]

    def find(self, keys: list[str]) -> list[int]:
        """The number stored with each key, -1 for a key that isn't stored.

        One vectorised binary search over all keys; an entry counts only if its
        full text is equal, and entries of equal digest are all looked at.
        """
        import numpy as np

        out = [-1] * len(keys)
        if not keys or not len(self.digests):
            return out
        want = np.array([self.digest(k) for k in keys], "<u8")
        at = np.searchsorted(self.digests, want)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == want).tolist():
            text, entry = keys[i].encode("utf-8", "surrogatepass"), int(at[i])
            while entry < len(self.digests) and self.digests[entry] == want[i]:
                if self.texts[int(self.offsets[entry]):int(self.offsets[entry + 1])].tobytes() == text:
                    out[i] = int(self.numbers[entry])
                    break
                entry += 1
        return out

    def _parents(self, host: str) -> list[str]:
        """The host and the domains above it, as far as they can be a rule's host; longest first."""
        found = [host] if len(host) <= self.longest else []
        at = host.find(".", max(0, len(host) - self.longest - 1))
        while at >= 0:
            found.append(host[at + 1:])
            at = host.find(".", at + 1)
        return [h for h in found if h]

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str | None]]:
        """(host, path, rule, verdict) of each URL; rule and verdict are None where no rule fits."""
        parts = [host_and_path(u) for u in urls]
        hosts = list(dict.fromkeys(h for h, _ in parts))
        above = [(host, parent) for host in hosts for parent in self._parents(host)]
        ruled: dict[str, list[tuple[str, list[int]]]] = {}
        for (host, parent), number in zip(above, self.find([f"/{parent}" for _, parent in above])):
            if number >= 0:
                first = number >> 32
                ruled.setdefault(host, []).append((parent, self.lengths[first:first + (number & 0xFFFFFFFF)].tolist()))
        probes = [(i, parent, path[:size]) for i, (host, path) in enumerate(parts)
                  for parent, sizes in ruled.get(host, ()) for size in sizes if size <= len(path)]
        best: dict[int, tuple] = {}
        for (i, parent, path), number in zip(probes, self.find([p + q for _, p, q in probes])):
            if number >= 0:
                best[i] = max(best.get(i, (0,)), (len(parent) + len(path), len(parent), parent + path, VERDICTS[number]))
        return [(*part, *best.get(i, (None, None))[-2:]) for i, part in enumerate(parts)]


def clean_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) from (rule, verdict): ``host/path``, A-Z of the host in lower case; of one rule with both verdicts, block."""
    host = F.translate(F.substring_index("rule", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = rules.select(host.alias("host"), F.expr("substring(rule, char_length(substring_index(rule, '/', 1)) + 1)").alias("path"), "verdict")
    return parts.filter("host <> '' AND verdict IN ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


def shared_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Write ``data`` below the shared folder and have every executor, later ones too, fetch it; the name to open it by."""
    path = scratch_path(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def _by_index(pages: DataFrame, rules: list, default: str) -> DataFrame:
    name = shared_file(pages.sparkSession, index_bytes(rules), "url-rules")

    def start():
        import mmap

        with open(SparkFiles.get(name), "rb") as file:
            index = UrlIndex(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

        def work(urls: list) -> list:
            judged = [(h, p, r, default if v is None else v) for h, p, r, v in index.judge(urls)]
            return list(zip(*judged)) if judged else [[], [], [], []]

        return work

    return arrow_pass(pages, ["key"], "url", [(n, T.StringType()) for n in ("host", "path", "rule", "verdict")], start)


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same answers for rules too many for one file: distinct hosts and paths meet the rules in shuffle joins."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    split = pages.select("key", F.coalesce(rest, F.lit("")).alias("rest"))
    split = split.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0))
    host = F.translate("raw", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host")
    path = F.regexp_extract(F.expr("substring(rest, char_length(raw) + 1)"), "^[^?#]*", 0).alias("path")
    split = split.select("key", host, path)
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0]
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda n: F.concat_ws(".", F.slice(labels, -n, n)))
    parents = split.select("host").distinct().select("host", F.explode(tails).alias("parent"))
    sizes = rules.select(F.col("host").alias("parent"), F.length("path").alias("size")).distinct()
    probes = split.select("host", "path").distinct().join(parents.join(sizes, "parent"), "host").filter(F.length("path") >= F.col("size"))
    probes = probes.withColumn("start", F.expr("substring(path, 1, size)"))
    named = rules.select(F.col("host").alias("parent"), F.col("path").alias("start"), "verdict")
    order = F.struct(F.length("parent") + F.col("size"), F.length("parent"))
    found = probes.join(named, ["parent", "start"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("parent", "start").alias("rule"), "verdict"), order).alias("best"))
    return split.join(found, ["host", "path"], "left").select(
        "key", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
                max_rules: int = MAX_RULES) -> DataFrame:
    """(key, host, path, rule, verdict): one row for each row of ``df``.

    ``rules`` has (rule, verdict), a rule being ``host/path`` and a verdict
    ``allow`` or ``block``. A rule fits its host and all hosts below it whose
    URL's path starts with the rule's (path and prefix compared as they are, a
    host's port and user included). The longest fitting rule wins, of two as
    long the one with the longer host; a rule given with both verdicts blocks.
    Where none fits, ``rule`` is null and the verdict ``default``. Null URLs and
    those without ``://`` have an empty host and path, which no rule fits.
    Rules that are null, have no host or another verdict are left out. Repeated
    rows and null keys are kept; empty tables of either kind work. Up to
    ``max_rules`` rules go to the executors as one file (about 100 bytes a
    rule); more are met in joins, with the same answers.
    """
    pages, cleaned = renamed(df, key=key, url=url), clean_rules(rules)
    few = bounded_rows(cleaned, max_rules)
    judged = _by_join(pages, cleaned, default) if few is None else _by_index(pages, few, default)
    return judged.withColumnRenamed("key", key)
