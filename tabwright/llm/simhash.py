"""SimHash near-duplicates: positional byte index, count filter, exact distance, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, renamed, written

BYTES = 8


def _word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a text, split at ASCII white space, in blocks of about ``size`` bytes."""
    at = 0
    while len(data) - at > size:
        cut = at + size
        while cut < len(data) and data[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


def _fingerprinter(width: int):
    """start() of the Arrow pass: texts to signed 64-bit fingerprints."""

    def start():
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        lanes = np.uint64(0x0101010101010101)
        shifts = [np.uint64(k) for k in range(8)]

        def hashes(words: list[bytes]):
            joined = b" ".join(words)
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            first = [0, *(ends[: len(words) - width] + 1).tolist()]
            last = [*ends[width - 1:].tolist(), len(joined)]
            return np.array([digest(joined[a:b], 42) for a, b in zip(first, last)], dtype=np.uint64)

        def count(h, ones) -> None:
            blocks = np.arange(0, len(h), 255)  # at most 255 ones in each byte-wide lane of a block
            for k in range(8):
                ones[:, k] += np.add.reduceat((h >> shifts[k]) & lanes, blocks).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)

        def fingerprint(text: str | None) -> int:
            ones, n, tail = np.zeros((8, 8), np.int64), 0, []
            for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
                tail += block
                if len(tail) >= width:
                    h = hashes(tail)
                    count(h, ones)
                    n += len(h)
                    tail = tail[len(tail) - width + 1:]
            if not n:
                if not tail:
                    return 0
                ones[:] = (digest(b" ".join(tail), 42) >> np.arange(64, dtype=object).reshape(8, 8)) & 1
                n = 1
            return int(np.packbits((2 * ones > n).astype(np.uint8), axis=1, bitorder="little").reshape(-1).view(np.int64)[0])

        return lambda texts: [[fingerprint(t) for t in texts]]

    return start


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp): the 64-bit SimHash of each row's word shingles.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased; a
    shingle is ``width`` words joined by spaces, repeats counted, hashed by
    XXH64 with seed 42. A bit is set if it is set in over half of the hashes.
    A text of fewer words is one shingle; null, empty and blank texts get 0.
    """
    return arrow_pass(renamed(df, key=key, text=text), ["key"], "text", [("fp", T.LongType())], _fingerprinter(width))


def _byte_masks(shared: int) -> list[int]:
    """One signed mask for each choice of ``shared`` byte positions."""
    masks = [sum(0xFF << 8 * b for b in chosen) for chosen in combinations(range(BYTES), shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _common_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(m)) == 0, 1).otherwise(0) for m in _byte_masks(1)), F.lit(0))


def linked_pairs(classes: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in ``fp`` that differ in at most ``max_bits`` bits.

    Bits that differ spoil at most ``max_bits`` of the eight bytes, so a link
    shares 8 - max_bits positional bytes at least. The inverted index therefore
    lists fingerprints under every choice of that many (position, byte) entries:
    whoever meets in a list has the guaranteed count, and lists are 2^32 values
    wide (four bytes) instead of 2^8. Each pair is tallied in the lists it shares
    and goes on from the first of them only, then its distance is verified.
    ``max_bits`` is 0 to 7. Fingerprints must be distinct, so copies never meet here.
    Spark takes the lists for as small as ``classes``, so their join is never left to its broadcasts.
    """
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be 0 to 7")
    masks = _byte_masks(BYTES - max_bits)
    index = F.array(*(F.lit(m) for m in masks))
    lists = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("choice"))
    lists = lists.select("fp", "choice", F.col("fp").bitwiseAND(F.get(index, F.col("choice"))).alias("entry"))
    a, b = lists.alias("a"), lists.hint("merge").alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = ((F.col("a.choice") == F.col("b.choice")) & (F.col("a.entry") == F.col("b.entry"))
            & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= max_bits))
    pairs = a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"), F.col("a.choice").alias("choice"))
    tally = _common_bytes(F.col("a"), F.col("b"))
    first = F.array_position(F.transform(index, lambda m: F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(m) == 0), True) - 1
    return pairs.filter((tally >= BYTES - max_bits) & (F.col("choice") == first)).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b) the smallest node it can reach, the roots left out.

    Large-star and small-star rounds in turn, each written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain. Minima
    are partial aggregates and the joins have splittable sides, so a node with
    very many links does not land in one task. Links of few nodes pack well, so
    the size of their file says little and no join is left to Spark's broadcasts.
    """
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = _checksum(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _checksum(edges)
        if before == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)"))).first()
    return tuple(row)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): one row for each row of ``df``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest
    key that links of at most ``max_bits`` differing bits reach, the row itself
    included. Rows with equal fingerprints form one class and only classes are
    compared, so copies cost nothing; blank and null texts form the class of
    fingerprint zero. Null keys are kept and never the smallest unless all are
    null. Repeated rows stay repeated. An empty table gives an empty result.
    """
    marked = written(fingerprints(df, key, text, width), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("key").alias("low")), "classes")
    grouped = written(components(linked_pairs(classes, max_bits)), "components")
    grouped = grouped.unionByName(grouped.select(F.col("root").alias("node"), "root").distinct())
    members = grouped.join(classes.hint("merge"), grouped.node == classes.fp)
    lowest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = members.join(lowest.hint("merge"), "root").select("fp", "component_id")
    names = written(classes.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "names")
    named = marked.join(names.hint("merge"), "fp")
    return named.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
