"""Byte-level BPE token ids for whole texts, from a public vocabulary given by its path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

# fixed values: the published pre-token pattern of this vocabulary, and the same without its look-ahead
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_LOOKAHEAD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast value: executors need no copy of the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file and their ids; only tokens that take no text around them."""
    import json

    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found):
        raise ValueError(f"{path}: an added token depends on the text around it")
    return {t["content"]: t["id"] for t in found}


def encoder(vocabulary: bytes, added: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """Text to ids, for a vocabulary of lines "base64-token rank".

    A text is cut at the tokens of ``added``, which become their ids; without
    ``added`` their names are ordinary text. The look-ahead only matters where
    white space repeats, and the pattern without it is faster.
    """
    import base64
    import re

    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    exact, quick = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("exact", PATTERN), ("quick", NO_LOOKAHEAD)))
    repeated = re.compile(r"\s\s").search

    def ordinary(text: str) -> list[int]:
        return (exact if repeated(text) else quick).encode_ordinary(text)

    if not added:
        return ordinary
    marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> list[int]:
        if not marks.search(text):
            return ordinary(text)
        return [i for part in marks.split(text) for i in ([added[part]] if part in added else ordinary(part))]

    return encode
