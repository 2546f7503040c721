"""Periodic runs of words: longest common extensions through a difference cover, candidates from a harmonic grid."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, renamed

# fixed value: a perfect difference set, every distance modulo 31 occurs once
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
BLOCK_WORDS = 1 << 20
SHORT_PERIODS = 256  # up to here one period over all documents at a time, beyond all periods of one document


def _shift_table():
    """shift[x, y]: the fewest steps after which positions of residues x and y are both in the cover."""
    import numpy as np

    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    table = np.full((MODULUS, MODULUS), -1, np.int64)
    steps = np.arange(MODULUS)
    for d in range(MODULUS - 1, -1, -1):
        table[np.ix_(inside[(steps + d) % MODULUS], inside[(steps + d) % MODULUS])] = d
    return table


class CommonExtensions:
    """Longest common extensions of a sequence of codes, answered for arrays of position pairs.

    Only the suffixes at positions of the cover are sorted: first by their next
    ``MODULUS`` codes, two at a time among those still tied, then by doubling,
    since a cover position plus the modulus is one again. Equal neighbours in
    this order have their common length from the ranks kept at every doubling;
    a sparse table gives its minimum over any range. A query compares the few
    codes up to the next place where both positions are in the cover.
    The end of the sequence differs from every code.
    """

    def __init__(self, codes):
        import numpy as np

        n = len(codes)
        self.codes = np.concatenate([codes.astype(np.int64), np.arange(-1, -4 * MODULUS, -1)])
        starts = np.arange(0, n + 1, MODULUS, dtype=np.int64)
        self.samples = (starts[:, None] + np.array(COVER)).ravel()
        self.number = np.full(MODULUS, -1, np.int64)
        self.number[list(COVER)] = np.arange(len(COVER))
        self.shift = _shift_table()
        self._sort()

    def sample_of(self, position):
        """The index in ``samples`` of positions in the cover."""
        return position // MODULUS * len(COVER) + self.number[position % MODULUS]

    def _sort(self) -> None:
        import numpy as np

        m, per = len(self.samples), len(COVER)
        order, rank = np.arange(m), np.zeros(m, np.int64)
        tied = np.arange(m)  # places in the order whose group has more than one member

        def refine(key):
            """Split every group by ``key`` of its members; a rank is the first place of its group."""
            nonlocal tied
            members = order[tied]
            by = np.lexsort((key, rank[members]))
            members, key = members[by], key[by]
            order[tied] = members
            old = rank[members]
            new_group = np.concatenate([[True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])])
            first = tied[np.maximum.accumulate(np.where(new_group, np.arange(len(tied)), 0))]
            rank[members] = first
            alone = new_group & np.concatenate([new_group[1:], [True]])
            tied = tied[~alone]

        low = int(self.codes.min())
        width = int(self.codes.max()) - low + 1
        for step in range(0, MODULUS, 2):
            if not len(tied):
                break
            at = self.samples[order[tied]] + step
            pair = self.codes[at] - low
            if step + 1 < MODULUS:
                pair = pair * width + (self.codes[at + 1] - low)
            refine(pair)
        levels = [rank.copy()]  # levels[k]: equal ranks have MODULUS * 2^k codes in common
        hop = per
        while len(tied):
            beyond = order[tied] + hop
            refine(np.where(beyond < m, rank[np.minimum(beyond, m - 1)], -1 - beyond))
            levels.append(rank.copy())
            hop *= 2
        self.place = rank
        a, b = order[:-1], order[1:]
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common // MODULUS * per, b + common // MODULUS * per
            fits = (x < m) & (y < m)
            fits[fits] = levels[k][x[fits]] == levels[k][y[fits]]
            common += np.where(fits, MODULUS << k, 0)
        common += self._direct(self.samples[a] + common, self.samples[b] + common, np.full(len(a), MODULUS))
        self.least = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _direct(self, i, j, limit):
        """Equal codes from i and j on, at most ``limit``, by comparison."""
        import numpy as np

        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(limit > 0)
        step = 0
        while len(live):
            live = live[self.codes[i[live] + step] == self.codes[j[live] + step]]
            step += 1
            out[live] = step
            live = live[limit[live] > step]
        return out

    def lengths(self, i, j):
        """The number of equal codes from positions i and j on, i <> j, both 0 to n."""
        import numpy as np

        need = self.shift[i % MODULUS, j % MODULUS]
        out = self._direct(i, j, need)
        whole = np.flatnonzero(out == need)
        if len(whole):
            a, b = self.place[self.sample_of(i[whole] + need[whole])], self.place[self.sample_of(j[whole] + need[whole])]
            a, b = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp(b - a)[1].astype(np.int64) - 1
            found = np.empty(len(whole), np.int64)
            for k in np.unique(level).tolist():
                here = np.flatnonzero(level == k)
                table = self.least[k]
                found[here] = np.minimum(table[a[here]], table[b[here] - (1 << k)])
            out[whole] += found
        return out


def _grid(starts, sizes, repeats: int, least: int, chunk: int = 1 << 21) -> Iterator[tuple]:
    """Arrays (position, period, document) of all grid points, about ``chunk`` at a time.

    A run of period p has at least ``(repeats - 1) * p`` consecutive positions
    equal to the one p further on. So the multiples of that width, from the
    start of the document, meet every run: a harmonic number of points.
    """
    import numpy as np

    batch: list[tuple] = []
    held = 0
    by_size = np.argsort(-sizes, kind="stable")
    longest = int(sizes[by_size[0]]) // repeats if len(sizes) else 0
    for p in range(1, min(longest, SHORT_PERIODS) + 1):
        fits = by_size[: int(np.searchsorted(-sizes[by_size], -max(least, repeats * p), side="right"))]
        owner, k = _spread(fits, (sizes[fits] - p - 1) // ((repeats - 1) * p) + 1)
        batch.append((starts[owner] + k * ((repeats - 1) * p), np.full(len(k), p), owner))
        held += len(k)
        if held >= chunk:
            yield tuple(map(np.concatenate, zip(*batch)))
            batch, held = [], 0
    for d in by_size[sizes[by_size] >= max(least, repeats * (SHORT_PERIODS + 1))].tolist():
        periods = np.arange(SHORT_PERIODS + 1, sizes[d] // repeats + 1)
        points = (sizes[d] - periods - 1) // ((repeats - 1) * periods) + 1
        ends = np.searchsorted(np.cumsum(points), np.arange(chunk, points.sum() + chunk, chunk)) + 1
        for a, b in zip([0, *ends.tolist()], ends.tolist()):
            period, k = _spread(periods[a:b], points[a:b])
            batch.append((starts[d] + k * ((repeats - 1) * period), period, np.full(len(k), d)))
            held += len(k)
            if held >= chunk:
                yield tuple(map(np.concatenate, zip(*batch)))
                batch, held = [], 0
    if batch:
        yield tuple(map(np.concatenate, zip(*batch)))


def _spread(values, counts):
    """Each value ``counts`` times, and 0, 1, 2, ... beside its copies."""
    import numpy as np

    return np.repeat(values, counts), np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def find_runs(codes, starts, sizes, min_length: int = 6, repeats: int = 4):
    """(document, start, length, period) arrays of all runs, by document, start, period.

    ``codes`` holds the documents one after another, each followed by a code
    that occurs nowhere else; document d is codes[starts[d]:starts[d] + sizes[d]].
    ``repeats`` is 2 at least.
    """
    import numpy as np

    forward = backward = None
    parts = []
    n = len(codes)
    for at, period, owner in _grid(starts, sizes, repeats, min_length):
        equal = np.flatnonzero(codes[at] == codes[at + period])
        if not len(equal):
            continue
        at, period, owner = at[equal], period[equal], owner[equal]
        if forward is None:
            forward, backward = CommonExtensions(codes), CommonExtensions(codes[::-1])
        right = forward.lengths(at, at + period)
        left = backward.lengths(n - at, n - at - period)
        size = left + right + period
        good = size >= np.maximum(min_length, repeats * period)
        parts.append(_smallest(np.stack([owner[good], at[good] - left[good] - starts[owner[good]], size[good], period[good]])))
    found = _smallest(np.concatenate(parts, axis=1)) if parts else np.zeros((4, 0), np.int64)
    return found[:, np.lexsort((found[3], found[1], found[0]))]


def _smallest(found):
    """Of each (document, start, length) the smallest period: the others are its multiples."""
    import numpy as np

    found = found[:, np.lexsort((found[3], found[2], found[1], found[0]))]
    return found[:, np.concatenate([[True], (found[:3, 1:] != found[:3, :-1]).any(axis=0)])[: found.shape[1]]]


def _blocks(texts: list[str | None], limit: int) -> Iterator[list[list[bytes]]]:
    """Words of texts, as many texts at a time as have about ``limit`` words, one at least."""
    held, words = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").split())
        words += len(held[-1])
        if words >= limit:
            yield held
            held, words = [], 0
    if held:
        yield held


def block_runs(docs: list[list[bytes]], min_length: int, repeats: int):
    """``find_runs`` over lists of words."""
    import numpy as np
    import pyarrow as pa

    sizes = np.array([len(w) for w in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = pa.array(list(chain.from_iterable(docs)), pa.large_binary()).dictionary_encode()
    codes = np.zeros(int(sizes.sum()) + len(docs), np.int64)
    ends = starts + sizes
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = words.indices.to_numpy(zero_copy_only=False)
    codes[ends] = len(words.dictionary) + np.arange(len(docs))
    return find_runs(codes, starts, sizes, min_length, repeats)


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, repeats: int = 4,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_words, runs, collapsed): one row for each row of ``df``.

    Words are split at space and 0x09-0x0D. A run is a stretch of words with
    smallest period q (words q apart are equal), as long as it can be and with
    at least ``min_length`` words and ``repeats`` (2 or more) times q. ``runs``
    lists (start, length, period), by start, then period; ``collapsed`` is the
    text without the words that a run holds behind its first q, words joined by
    one space. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Rows are independent: repeated rows, null keys and an empty
    table are kept as they are. A task holds the words of about ``block_words``
    words of texts, or one text, at a time.
    """
    def start():
        import numpy as np

        def measure(docs: list[list[bytes]]) -> Iterator[tuple]:
            owner, first, size, period = block_runs(docs, min_length, repeats)
            cuts = np.searchsorted(owner, np.arange(len(docs) + 1))
            for d, words in enumerate(docs):
                a, b = cuts[d], cuts[d + 1]
                kept = words
                if a < b:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, first[a:b] + period[a:b], 1)
                    np.add.at(change, first[a:b] + size[a:b], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                listed = np.stack([first[a:b], size[a:b], period[a:b]], axis=1).tolist()
                yield len(words), listed, b" ".join(kept).decode("utf-8", "surrogatepass")

        def work(texts: list) -> list:
            rows = [row for docs in _blocks(texts, block_words) for row in measure(docs)]
            return list(zip(*rows)) if rows else [[], [], []]

        return work

    fields = [("n_words", T.LongType()), ("_runs", T.ArrayType(T.ArrayType(T.LongType()))), ("collapsed", T.StringType())]
    found = arrow_pass(renamed(df, key=key, text=text), ["key"], "text", fields, start)
    runs = F.transform("_runs", lambda r: F.struct(r[0].alias("start"), r[1].alias("length"), r[2].alias("period"))).alias("runs")
    return found.select(F.col("key").alias(key), "n_words", runs, "collapsed")
