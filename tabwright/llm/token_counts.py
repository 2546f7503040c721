"""Edit-aware token counts: segment trees over runs of pre-tokens, re-encoded only where an edit touches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_kind, renamed, safe_pieces, small_batches
from .tokens import encoder, shared_vocabulary

LEAF = 512  # characters of a leaf, about

# personal data and noise that a corpus is scrubbed of: pattern and replacement
# (a mail address starts where its run of characters starts, so that a long run is read once)
SCRUBS = [(r"(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.-]+\w", "<email>"), (r"\+?\d[\d ()-]{6,}\d", "<phone>"), (r"https?://[^\s]+", "<url>"),
          (r"!{2,}", "!"), (r"[ \t]{2,}", " ")]


class TokenTree:
    """A text as leaves of whole pre-tokens, with segment trees of their characters and tokens.

    Leaves meet before a single space between two characters that are not white
    space, where pre-tokens always end, so each leaf is encoded on its own. An
    edit re-encodes the leaves it touches, and a neighbour if the edit spoils the
    place where they met; sums change on the paths to the root only.
    """

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        self.count, self.leaf = count, leaf
        self.plant(list(safe_pieces(text, leaf)))

    def plant(self, leaves: list[str], tokens: list[int] | None = None) -> None:
        self.leaves, self.encoded_chars = leaves, getattr(self, "encoded_chars", 0)
        self.base = 1 << (len(leaves) - 1).bit_length()
        if tokens is None:
            tokens = [self.count(x) for x in leaves]
            self.encoded_chars += sum(map(len, leaves))
        self.chars = [0] * self.base + [len(x) for x in leaves] + [0] * (self.base - len(leaves))
        self.tokens = [0] * self.base + tokens + [0] * (self.base - len(leaves))
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf with text for the end) and where that leaf begins."""
        if at >= self.chars[1]:
            last = max((i for i, x in enumerate(self.leaves) if x), default=0)
            return last, self.chars[1] - len(self.leaves[last])
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.base, begin

    def _put(self, i: int, text: str, tokens: int) -> None:
        self.leaves[i] = text
        node, chars, tokens = i + self.base, len(text) - self.chars[i + self.base], tokens - self.tokens[i + self.base]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def _neighbour(self, i: int, step: int) -> int | None:
        i += step
        while 0 <= i < len(self.leaves) and not self.leaves[i]:
            i += step
        return i if 0 <= i < len(self.leaves) else None

    @staticmethod
    def _meet(left: str, right: str) -> bool:
        return not left[-1].isspace() and len(right) > 1 and right[0] == " " and not right[1].isspace()

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start``; both are cut to the text."""
        self.edit_all([(start, length, replacement)])

    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits in order of place, none overlapping, all places as the text is now: a leaf is encoded once for all its edits."""
        spans: list[list] = []  # first leaf, where it begins, last leaf, edits
        for start, length, replacement in edits:
            start = min(max(0, start), self.chars[1])
            end = min(start + max(0, length), self.chars[1])
            (first, begin), (last, _) = self.find(start), self.find(max(start, end - 1))
            if spans and first <= spans[-1][2]:
                spans[-1][2] = max(last, spans[-1][2])
                spans[-1][3].append((start, end, replacement))
            else:
                spans.append([first, begin, last, [(start, end, replacement)]])
        for first, begin, last, changes in reversed(spans):  # from the end, so that places stay right
            old, at, parts = "".join(self.leaves[first:last + 1]), 0, []
            for start, end, replacement in changes:
                parts += [old[at:start - begin], replacement]
                at = end - begin
            self._replace(first, last, "".join(parts) + old[at:])

    def _replace(self, first: int, last: int, region: str) -> None:
        """Put ``region`` in place of the leaves ``first`` to ``last``."""
        while True:  # take in neighbours until both ends are places where pre-tokens end
            before, after = self._neighbour(first, -1), self._neighbour(last, 1)
            if not region:
                if before is None or after is None or self._meet(self.leaves[before], self.leaves[after]):
                    break
                region, first = self.leaves[before], before
            elif before is not None and not self._meet(self.leaves[before], region):
                region, first = self.leaves[before] + region, before
            elif after is not None and not self._meet(region, self.leaves[after]):
                region, last = region + self.leaves[after], after
            else:
                break
        pieces = list(safe_pieces(region, self.leaf)) if region else []
        counts = [self.count(p) for p in pieces]
        self.encoded_chars += len(region)
        slots = last - first + 1
        if len(pieces) > slots:  # the tree grows: no leaf outside the region is encoded again
            tokens = self.tokens[self.base:self.base + len(self.leaves)]
            self.plant(self.leaves[:first] + pieces + self.leaves[last + 1:], tokens[:first] + counts + tokens[last + 1:])
            return
        for k in range(slots):
            self._put(first + k, *((pieces[k], counts[k]) if k < len(pieces) else ("", 0)))

    @classmethod
    def kept(cls, leaves: list[str], tokens: list[int], count: Callable[[str], int], leaf: int = LEAF) -> TokenTree:
        """The tree of stored leaves and their token counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.leaf = count, leaf
        tree.plant(leaves or [""], tokens or [0])
        return tree

    def stored(self) -> tuple[list[str], list[int]]:
        """Leaves with text, and their token counts."""
        pairs = [(x, n) for x, n in zip(self.leaves, self.tokens[self.base:]) if x]
        return [x for x, _ in pairs], [n for _, n in pairs]


def separate(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Edits of one text, by place; of edits that overlap the one that begins first, then the longer, counts."""
    kept, end = [], 0
    for start, length, replacement in sorted(edits, key=lambda e: (e[0], -e[1], e[2])):
        if start >= end:
            kept.append((start, length, replacement))
            end = start + length
    return kept


def scrub_edits(text: str, scrubs: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, length, replacement) of all matches of the patterns."""
    return separate([(m.start(), len(m[0]), replacement) for pattern, replacement in scrubs for m in re.finditer(pattern, text)])


FIELDS = ("n_tokens", "n_edits", "n_tokens_edited", "chars_encoded_again", "n_chars_edited")


def usable(n_chars: int, given: list | None) -> list[tuple[int, int, str]]:
    """The edits of an ``edits`` value that lie in a text of ``n_chars`` characters, overlaps left out."""
    triples = [tuple(e.values()) for e in given or [] if e is not None]
    return separate([(a, n, r or "") for a, n, r in triples if a is not None and n is not None and 0 <= a <= n_chars and n >= 0])


def checked(added: dict[str, int] | None) -> dict[str, int] | None:
    """Added tokens without white space: no leaf is cut inside one."""
    if any(c.isspace() for token in added or () for c in token):
        raise ValueError("an added token holds white space")
    return added


def _recounted(df: DataFrame, vocabulary: str, edits_of: Callable[[str, list | None], list[tuple[int, int, str]]],
               added: dict[str, int] | None) -> DataFrame:
    shared = shared_vocabulary(df.sparkSession, vocabulary)
    names, given, added = ["key", *FIELDS], "edits" in df.columns, checked(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, added)

        def count(text: str) -> int:
            return len(encode(text))

        def one(text: str | None, edits: list | None) -> tuple[int, ...]:
            tree = TokenTree(text or "", count)
            before, chars, edits = tree.n_tokens, tree.encoded_chars, edits_of(text or "", edits)
            tree.edit_all(edits)
            return before, len(edits), tree.n_tokens, tree.encoded_chars - chars, tree.chars[1]

        for batch in batches:
            for part in small_batches(batch, 1):
                edits = part.column(2).to_pylist() if given else [None] * part.num_rows
                rows = [one(t, e) for t, e in zip(part.column(1).to_pylist(), edits)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names)

    schema = T.StructType([df.schema["key"]] + [T.StructField(n, T.LongType()) for n in FIELDS])
    return df.mapInArrow(run, schema)


def edited_counts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", edits: str = "edits",
                  added: dict[str, int] | None = None) -> DataFrame:
    """(key, n_tokens, n_edits, n_tokens_edited, chars_encoded_again, n_chars_edited): token counts before and after edits.

    ``edits`` is an array of structs (start, length, replacement) whose places
    refer to the text as it was; null entries and null places are ignored, a null
    replacement deletes, and of edits that overlap only the first counts. Only
    leaves around edits are encoded again. Texts are not shuffled. Null texts
    count as empty, null keys and repeated rows are counted like any other, other
    columns are ignored, an empty table gives an empty result. ``added`` tokens
    inside a text count as one each.
    """
    ready = renamed(df, key=key, text=text, edits=edits)
    return _recounted(ready, vocabulary, lambda t, given: usable(len(t), given), added).withColumnRenamed("key", key)


def scrubbed_counts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", scrubs: list[tuple[str, str]] | None = None,
                    added: dict[str, int] | None = None) -> DataFrame:
    """``edited_counts`` for the edits that replace every match of the patterns of ``scrubs`` (pattern, replacement)."""
    scrubs = SCRUBS if scrubs is None else scrubs
    return _recounted(renamed(df, key=key, text=text), vocabulary, lambda text, _: scrub_edits(text, scrubs), added).withColumnRenamed("key", key)


def _trees(df: DataFrame, vocabulary: str, key: str, added: dict[str, int] | None, extra: list[str], columns: int, grow: Callable) -> DataFrame:
    """Rows (key, leaves, leaf_tokens, n_tokens, n_chars, extra...) of the trees that ``grow(count, *values)`` makes of the columns behind the key."""
    shared, added = shared_vocabulary(df.sparkSession, vocabulary), checked(added)
    fields = [("leaves", T.ArrayType(T.StringType())), ("leaf_tokens", T.ArrayType(T.LongType())),
              *((n, T.LongType()) for n in ("n_tokens", "n_chars", *extra))]
    schema = T.StructType([df.schema["key"]] + [T.StructField(n, t) for n, t in fields])
    names, kinds = [n for n, _ in fields], [arrow_kind(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value, added)

        def one(*values) -> tuple:
            tree, more = grow(lambda text: len(encode(text)), *values)
            return *tree.stored(), tree.n_tokens, tree.chars[1], *more

        for batch in batches:
            for part in small_batches(batch, 1):
                rows = [one(*v) for v in zip(*(part.column(i + 1).to_pylist() for i in range(columns)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["key", *names])

    return df.mapInArrow(run, schema).withColumnRenamed("key", key)


def plant_trees(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", added: dict[str, int] | None = None) -> DataFrame:
    """(key, leaves, leaf_tokens, n_tokens, n_chars): every text as a kept tree, to be written and edited later by ``edit_trees``.

    One row for each row of ``df``; the leaves joined are the text. Null and empty
    texts have no leaves; null keys and repeated rows stay; other columns are ignored.
    """
    return _trees(renamed(df, key=key, text=text), vocabulary, key, added, [], 1, lambda count, t: (TokenTree(t or "", count), ()))


def edit_trees(trees: DataFrame, vocabulary: str, key: str = "doc_id", edits: str = "edits", added: dict[str, int] | None = None) -> DataFrame:
    """Kept trees after ``edits`` (as in ``edited_counts``, null: none): the columns of ``plant_trees``, n_edits and chars_encoded.

    ``trees`` is the table of ``plant_trees`` or of an earlier ``edit_trees``, with
    the edits joined to it. Only leaves around edits are encoded (``chars_encoded``
    characters); counts of all others are taken from the table, so a further round
    costs what it touches. Rows are not shuffled; null leaves count as an empty text.
    """
    def grow(count: Callable[[str], int], leaves: list | None, tokens: list | None, given: list | None) -> tuple[TokenTree, tuple[int, int]]:
        tree = TokenTree.kept(leaves or [], tokens or [], count)
        wanted = usable(tree.chars[1], given)
        tree.edit_all(wanted)
        return tree, (len(wanted), tree.encoded_chars)

    ready = renamed(trees, key=key, leaves="leaves", leaf_tokens="leaf_tokens", edits=edits)
    return _trees(ready, vocabulary, key, added, ["n_edits", "chars_encoded"], 3, grow)
