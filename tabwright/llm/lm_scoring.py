"""Masked pseudo-likelihood: a bidirectional window network predicts each token's class from both sides, word counts the token."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_pass, renamed, small_batches, written

COMMON, HASHED, SIDE, WIDTH, BATCH = 192, 64, 2, 16, 4096
CLASSES = COMMON + HASHED
PAD = CLASSES
GROUP = 16  # classes of a group of the two-level softmax


def slots(classes: int) -> list[tuple[int, ...]]:
    groups = classes // GROUP
    return [(2 * SIDE, classes + 1, WIDTH), (WIDTH,), (WIDTH, groups), (groups,), (groups, WIDTH, GROUP), (groups, GROUP)]


def class_count(vocabulary: int) -> int:
    """CLASSES up to 2^17 distinct words, beyond growing with the fourth root of their number; three quarters are single words."""
    return max(CLASSES, HASHED * round(CLASSES / HASHED * (vocabulary / (1 << 17)) ** 0.25))


@dataclass
class WindowNetwork:
    """Embeddings for each place of the window, a hidden layer, and a softmax over groups of classes, then over a group's classes.

    A token is predicted by its own group's outputs only, so its cost grows with
    the groups and the size of one, not with the classes.
    """

    embed: np.ndarray
    hidden: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    leaf: np.ndarray
    leaf_bias: np.ndarray

    @classmethod
    def fresh(cls, seed: int = 0, classes: int = CLASSES) -> WindowNetwork:
        rng = np.random.default_rng(seed)
        biases = (1, 3, 5)
        return cls(*(np.zeros(s, np.float32) if i in biases else rng.normal(0, 0.3, s).astype(np.float32) for i, s in enumerate(slots(classes))))

    @property
    def classes(self) -> int:
        return self.leaf_bias.size

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.top, self.top_bias, self.leaf, self.leaf_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.reshape(-1) for a in self.arrays])

    @classmethod
    def from_flat(cls, values: np.ndarray, classes: int = CLASSES) -> WindowNetwork:
        arrays, at = [], 0
        for s in slots(classes):
            arrays.append(values[at:at + int(np.prod(s))].astype(np.float32).reshape(s))
            at += int(np.prod(s))
        return cls(*arrays)

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        h = np.take(self.embed[0], context[:, 0], axis=0)  # a third of the time of an index in brackets
        for k in range(1, 2 * SIDE):
            h += np.take(self.embed[k], context[:, k], axis=0)
        h += self.hidden
        return np.tanh(h, out=h)

    def _leaves(self, h: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
        """Outputs for the classes of each row's group, rows in order of group."""
        z = np.empty((len(h), GROUP), np.float32)
        for g, a, b in cuts:
            z[a:b] = h[a:b] @ self.leaf[g] + self.leaf_bias[g]
        return z

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(class | both sides) of every token, from its context (row, place)."""
        out = np.empty(len(target), np.float32)
        for at in range(0, len(target), 4 * BATCH):
            h, own = self._hidden(context[at:at + 4 * BATCH]), target[at:at + 4 * BATCH]
            group, place = own // GROUP, own % GROUP
            part = _log_softmax(h @ self.top + self.top_bias)[group, np.arange(len(own))]
            order, cuts = _by_group(group)
            part[order] += _log_softmax(self._leaves(np.take(h, order, axis=0), cuts))[place[order], np.arange(len(own))]
            out[at:at + 4 * BATCH] = part
        return out

    def step(self, context: np.ndarray, target: np.ndarray, squares: list[np.ndarray], rate: float) -> None:
        """One step of adaptive gradient descent on the mean loss of a batch."""
        n, h = len(target), self._hidden(context)
        group, place = target // GROUP, target % GROUP
        dz = np.ascontiguousarray(np.exp(_log_softmax(h @ self.top + self.top_bias)).T)
        dz[np.arange(n), group] -= 1
        dz /= n
        dh = dz @ self.top.T
        leaf, leaf_bias = np.zeros_like(self.leaf), np.zeros_like(self.leaf_bias)
        order, cuts = _by_group(group)
        own, place = np.take(h, order, axis=0), place[order]
        dy = np.ascontiguousarray(np.exp(_log_softmax(self._leaves(own, cuts))).T)
        dy[np.arange(n), place] -= 1
        dy /= n
        back, placed = np.empty_like(own), np.empty_like(own)
        for g, a, b in cuts:
            leaf[g], leaf_bias[g] = own[a:b].T @ dy[a:b], dy[a:b].sum(0)
            back[a:b] = dy[a:b] @ self.leaf[g].T
        placed[order] = back
        dh += placed
        dh *= 1 - h * h
        wide = dh.T.astype(np.float64, order="C")
        embed = np.stack([_sums_by_class(wide, context[:, k], self.classes + 1) for k in range(2 * SIDE)])
        for a, s, g in zip(self.arrays, squares, (embed, dh.sum(0), h.T @ dz, dz.sum(0), leaf, leaf_bias)):
            s += g * g
            a -= (rate * g / (np.sqrt(s) + 1e-6)).astype(np.float32)


def _sums_by_class(columns: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """(class, place) sums of ``columns`` (place, row) by the rows' class."""
    return np.stack([np.bincount(own, c, minlength=classes) for c in columns], axis=1)


def _narrow(ids: np.ndarray) -> np.ndarray:
    """As 16 bits where they fit: these are sorted by radix."""
    return ids.astype(np.int16 if ids.size == 0 or ids.max() < 1 << 15 else np.int64)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    """(class, row) from (row, class): along the rows' own short axis every step takes several times as long."""
    z = np.ascontiguousarray(z.T)
    z -= z.max(axis=0)
    return z - np.log(_sums(np.exp(z)))


def _sums(e: np.ndarray) -> np.ndarray:
    """Sums over classes, in the order in which numpy adds the values of one row."""
    whole = len(e) - len(e) % 8
    if not 8 <= len(e) <= 128:
        return np.ascontiguousarray(e.T).sum(axis=1)
    r = e[:8]
    for at in range(8, whole, 8):
        r = r + e[at:at + 8]
    r = r[0::2] + r[1::2]
    total = (r[0] + r[1]) + (r[2] + r[3])
    for rest in e[whole:]:
        total += rest
    return total


def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Rows in order of group, and (group, begin, end) of each group that occurs."""
    order = np.argsort(_narrow(group), kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    return order, [(int(group[order[a]]), int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


def windows(texts: list[np.ndarray], pad: int = PAD) -> np.ndarray:
    """For each token of all texts the SIDE tokens before and the SIDE after it; beyond its text stands ``pad``."""
    gap = np.full(SIDE, pad, np.int64)
    padded = np.concatenate([gap, *(x for ids in texts for x in (ids, gap))])
    sizes = np.array([len(ids) for ids in texts], np.int64)
    at = np.arange(int(sizes.sum())) + SIDE * np.repeat(np.arange(1, len(texts) + 1), sizes)
    return np.stack([np.take(padded, at + d) for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]).T  # a place's values side by side


class _Classes(dict):
    """Word to class: common words have their own, others share the last quarter, by hash."""

    def __init__(self, own: dict, classes: int = CLASSES):
        super().__init__(own)
        self.hashed = classes // 4
        self.common = classes - self.hashed

    def __missing__(self, word: bytes) -> int:
        found = self.common + crc32(word) % self.hashed
        if len(self) < 200_000:
            self[word] = found
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_ids(words: list[bytes], classes: dict) -> np.ndarray:
    return np.fromiter(map(classes.__getitem__, words), np.int64, len(words))


class _Slots(dict):
    """Word to its place in the arrays of classes and shares; words without an entry are gathered in ``missed`` and take the first places, by hash."""

    missed: list[bytes]

    def __init__(self, known: dict, hashed: int):
        super().__init__(known)
        self.hashed = hashed

    def __missing__(self, word: bytes) -> int:
        self.missed.append(word)
        return crc32(word) % self.hashed


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all texts, combined in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch, 0):
                counts: Counter = Counter()
                for t in part.column(0).to_pylist():
                    counts.update(words_of(t))
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame, counts: DataFrame | None = None, n: int = COMMON) -> list[bytes]:
    """The ``n`` most common words of all texts, ties by the word."""
    counted = word_counts(docs) if counts is None else counts
    return [bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(n).collect()]


def _train_round(docs: DataFrame, words: list[bytes], network: WindowNetwork, rate: float) -> WindowNetwork:
    """Every task trains from the shared weights on all its windows; the weights are then averaged by windows, in Spark."""
    own = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, classes, seen = WindowNetwork(*(a.copy() for a in network.arrays)), _Classes(own, network.classes), 0
        squares = [np.full(a.shape, 0.1) / BATCH for a in net.arrays]
        held: list[np.ndarray] = []
        rest = np.zeros((0, 2 * SIDE), np.int64), np.zeros(0, np.int64)
        size = 0

        def flush(everything: bool) -> None:
            nonlocal held, size, seen, rest
            context = np.concatenate([rest[0], windows(held, net.classes)])
            target = np.concatenate([rest[1], *held])
            end = len(target) if everything else len(target) - len(target) % BATCH
            for at in range(0, end, BATCH):
                net.step(context[at:at + BATCH], target[at:at + BATCH], squares, rate)
            seen += end
            held, size, rest = [], 0, (context[end:], target[end:])

        for batch in batches:
            for part in small_batches(batch, 0):
                for t in part.column(0).to_pylist():
                    held.append(class_ids(words_of(t), classes))
                    size += len(held[-1])
                    if size >= 16 * BATCH:
                        flush(False)
        if size or len(rest[1]):
            flush(True)
        if seen:
            flat = net.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * seen), pa.array(np.full(len(flat), seen), pa.int64())],
                                             names=["slot", "total", "seen"])

    trained = docs.select("text").mapInArrow(run, "slot int, total double, seen long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    rows = trained.select("slot", (F.col("total") / F.col("seen")).alias("value")).collect()
    if not rows:
        return network
    values = np.empty(len(rows))
    values[[r["slot"] for r in rows]] = [r["value"] for r in rows]
    return WindowNetwork.from_flat(values, network.classes)


def fit_network(df: DataFrame, text: str = "text", rounds: int = 2, rate: float = 0.1, seed: int = 0,
                counts: DataFrame | None = None) -> tuple[list[bytes], WindowNetwork]:
    """Word classes from the counts of all words, and the network trained on every window of every text once.

    ``counts`` is ``word_counts`` of the texts as a table, if there is one
    already. The number of classes follows its rows (``class_count``).

    Round r trains on the texts whose hash is r modulo ``rounds``; its tasks run
    apart and their weights are averaged, so what moves is one set of weights
    for each task and the word counts, both in proportion to the corpus.
    """
    docs = renamed(df, text=text)
    counts = written(word_counts(docs), "words") if counts is None else counts
    classes = class_count(counts.count())
    words, network = common_words(docs, counts, classes - classes // 4), WindowNetwork.fresh(seed, classes)
    for r in range(rounds):
        part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r)
        network = _train_round(part, words, network, rate / (1 + r))
    return words, network


def _shared_words(counts: DataFrame, words: list[bytes], classes: int) -> tuple[DataFrame, dict[int, int]]:
    """Words that share a class with others, with that class, and the count of all words of each such class."""
    spark = counts.sparkSession
    own = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
    hashed = classes // 4
    shared = counts.join(F.broadcast(own), "word", "left_anti").withColumn("class", F.lit(classes - hashed) + F.crc32("word") % hashed)
    return shared, {r["class"]: r["total"] for r in shared.groupBy("class").agg(F.sum("n").alias("total")).collect()}


def _frequent_from(shared: DataFrame, frequent: int) -> int:
    """The smallest count that at most ``frequent`` words reach, by steps of an eighth of a power of two."""
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int").alias("step")
    least, seen = 1 << 62, 0
    for r in sorted(shared.groupBy(step).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect(), reverse=True):
        seen += r["words"]
        if seen > frequent:
            break
        least = r["least"]
    return least


def score_texts(df: DataFrame, words: list[bytes], network: WindowNetwork, key: str = "doc_id", text: str = "text",
                counts: DataFrame | None = None, frequent: int = 200_000) -> DataFrame:
    """(key, n_tokens, pseudo_log_likelihood, mean_log_prob): one row for each row of ``df``.

    Each word of a whole text is masked and predicted from the two words on
    either side: log P(class | both sides) + log P(word | class), summed over the
    text. The second term comes from ``counts``, the table (word, n) of the texts
    that the network was fitted on: n over the words of the class and one more,
    which stands for all unseen words. Without ``counts`` the sum is that of the
    classes alone. About ``frequent`` words at most go to the tasks by value; all
    others are joined to the table. Null and blank texts have no tokens, a sum of
    0 and a null mean. Null keys and repeated rows are scored like any other;
    other columns are ignored.
    """
    hashed, whole = network.classes // 4, counts is not None
    common = network.classes - hashed
    known = {w: hashed + i for i, w in enumerate(words)}  # the first places are those of words without an entry
    class_of, share_of = [*range(common, network.classes), *range(len(words))], [0.0] * (hashed + len(words))
    if whole:
        shared, totals = _shared_words(counts, words, network.classes)
        least = _frequent_from(shared, frequent)
        for r in shared.filter(F.col("n") >= least).collect():
            known[bytes(r["word"])] = len(class_of)
            class_of.append(r["class"])
            share_of.append(float(np.log(r["n"]) - np.log(totals[r["class"]] + 1)))
    given = df.sparkSession.sparkContext.broadcast((known, np.array(class_of, np.int64), np.array(share_of)))

    def start():
        held_words, classes, shares = given.value
        slots = _Slots(held_words, hashed)

        def score(blocks: list[np.ndarray]) -> list[float]:
            """Sums of log P(class | both sides) of texts, all in one block."""
            found = network.log_probs(windows(blocks, network.classes), np.concatenate(blocks)) if blocks else []
            ends = np.cumsum([len(b) for b in blocks])
            return [float(x.sum(dtype=np.float64)) for x in np.split(found, ends[:-1])] if blocks else []

        def work(texts):
            sizes, sums, seconds, rest, times, held, waiting = [], [], [], [], [], [], 0
            for t in texts:
                each = words_of(t)
                slots.missed = []
                found = class_ids(each, slots)
                held.append(np.take(classes, found))
                seconds.append(float(np.take(shares, found).sum()))
                missed = Counter(slots.missed) if whole else {}
                sizes.append(len(each))
                rest.append(list(missed))
                times.append(list(missed.values()))
                waiting += len(each)
                if waiting >= 1 << 18:
                    sums += score(held)
                    held, waiting = [], 0
            sums += score(held)
            return [sizes, [a + b for a, b in zip(sums, seconds)], rest, times]

        return work

    docs = renamed(df, key=key, text=text)
    fields = [("n_tokens", T.LongType()), ("pseudo_log_likelihood", T.DoubleType()), ("rest", T.ArrayType(T.BinaryType())), ("times", T.ArrayType(T.LongType()))]
    scored = arrow_pass(docs, ["key"], "text", fields, start)
    if whole:
        scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # the table keeps the numbers
        pairs = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("times"))
        pairs = pairs.withColumn("class", F.lit(network.classes - hashed) + F.crc32("word") % hashed)
        sums = F.broadcast(df.sparkSession.createDataFrame(list(totals.items()), "class long, total long"))
        found = pairs.join(shared.filter(F.col("n") < least).select("word", "n"), "word", "left").join(sums, "class", "left")
        share = F.log(F.coalesce("n", F.lit(1)).cast("double")) - F.log(F.coalesce("total", F.lit(0)) + F.lit(1.0))
        second = found.groupBy("row").agg(F.sum(F.col("times") * share).alias("second"))
        total = F.col("pseudo_log_likelihood") + F.coalesce("second", F.lit(0.0))
        scored = scored.join(second, "row", "left").withColumn("pseudo_log_likelihood", total)
    scored = scored.select("key", "n_tokens", "pseudo_log_likelihood")
    mean = F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens"))
    return scored.withColumn("mean_log_prob", mean).withColumnRenamed("key", key)
