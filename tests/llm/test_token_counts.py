import random
import time
from collections import Counter

import public_tokenizers
import pytest
from fixtures import document_rows, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabwright.llm.common import safe_pieces
from tabwright.llm.token_counts import SCRUBS, TokenTree, edit_trees, edited_counts, plant_trees, scrub_edits, scrubbed_counts
from tabwright.llm.tokens import added_tokens, encoder

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ADDED = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["a", "Ab", " ", "  ", "\n", " \n ", "'s", "'", "é", "1", "12", "!!", "\t", " ", "x y", "<|endoftext|>", "汉", ". "]


@pytest.fixture(scope="module")
def encode():
    with open(PATH, "rb") as f:
        return encoder(f.read(), ADDED)


def full(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(encode):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [r[1] or "" for r in document_rows()]
    for t in texts:
        assert encode(t) == full(t)
        for size in (1, 7, 100):
            pieces = list(safe_pieces(t, size))
            assert "".join(pieces) == t and [i for p in pieces for i in encode(p)] == full(t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=50).map("".join), st.data())
def test_tree_follows_any_edits(encode, text, data):
    tree = TokenTree(text, lambda t: len(encode(t)), leaf=6)
    for _ in range(data.draw(st.integers(0, 6))):
        start, length = data.draw(st.integers(0, len(text))), data.draw(st.integers(0, 12))
        new = data.draw(st.lists(st.sampled_from(ODD), max_size=8).map("".join))
        tree.edit(start, length, new)
        text = text[:start] + new + text[start + length:]
        assert tree.text == text and tree.n_tokens == len(full(text)) and tree.chars[1] == len(text)


def test_small_edit_encodes_little_again(encode):
    text = " ".join(f"word{i}" for i in range(50_000))
    tree = TokenTree(text, lambda t: len(encode(t)))
    before = tree.encoded_chars
    tree.edit(200_000, 5, "other")
    assert tree.encoded_chars - before < 2_000 and tree.n_tokens == len(full(tree.text))


def scrubbed(text):
    for start, length, new in reversed(scrub_edits(text, SCRUBS)):
        text = text[:start] + new + text[start + length:]
    return text


def test_scrubbed_tables_match_brute_force(spark):
    rows = document_rows() + [(800, "Mail a.b@c.example or call +1 (499) 555-6503!!! Now  or  never<|endoftext|>", "en", "s", 1, None, None, None)]
    got = scrubbed_counts(documents(spark, rows), PATH, added=ADDED).collect()
    want = Counter((r[0], len(full(r[1] or "")), len(full(scrubbed(r[1] or ""))), len(scrubbed(r[1] or ""))) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) for r in got) == want
    assert sum(r["n_edits"] for r in got) > 5 and scrubbed_counts(documents(spark, []), PATH).count() == 0


def test_edit_column(spark):
    table = spark.createDataFrame(
        [(1, "one two three", [(4, 3, "2"), (5, 4, "lost"), None, (None, 1, "x"), (13, 0, "!"), (99, 1, "far")]), (2, None, [(0, 0, "new text")]), (None, "a b", None)],
        "doc_id long, text string, edits array<struct<start: int, length: int, replacement: string>>")
    got = {r["doc_id"]: (r["n_edits"], r["n_tokens_edited"], r["n_chars_edited"]) for r in edited_counts(table, PATH).collect()}
    assert got == {1: (2, len(full("one 2 three!")), 12), 2: (1, len(full("new text")), 8), None: (0, 2, 3)}


def test_many_edits_of_one_leaf_are_one_encoding(encode):
    text = "ab!!" * 50_000  # a million letters without a space are one leaf
    edits = scrub_edits(text, SCRUBS)
    tree = TokenTree(text, lambda t: len(encode(t)))
    before = tree.encoded_chars
    tree.edit_all(edits)
    assert len(edits) == 50_000 and tree.text == "ab!" * 50_000 and tree.encoded_chars - before == 150_000
    assert tree.n_tokens == len(full(tree.text))


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a." * 500_000, "1 " * 500_000, "a@" * 500_000, "x@" + "-" * 1_000_000, "x@y." + "-" * 1_000_000,
                                  "1" + " (" * 500_000, "+" * 1_000_000, "!" * 1_000_000])
def test_scrubs_read_a_long_run_once(text):
    begin = time.process_time()
    scrub_edits(text, SCRUBS)
    assert time.process_time() - begin < 3


def test_mail_addresses_are_found_whole():
    assert scrubbed("<a.b+c@d-e.example.org>, x@y.zz. q@w") == "<<email>>, <email>. q@w"


def test_a_second_round_encodes_only_what_it_touches(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["some", "words", "é", "x<|endoftext|>y", "1 2", "it's"]) for _ in range(n)) for n in (20_000, 300, 1)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (1, texts[1])]
    trees = plant_trees(spark.createDataFrame(rows, "doc_id long, text string"), PATH, added=ADDED)
    for _ in range(2):
        kept = [r.asDict() for r in trees.select("doc_id", "leaves", "leaf_tokens", "n_tokens").collect()]
        now = [("".join(r["leaves"]), r) for r in kept]
        assert all(r["n_tokens"] == len(full(t)) == sum(r["leaf_tokens"]) for t, r in now)
        edited = [(r["doc_id"], r["leaves"], r["leaf_tokens"], [(len(t) // 2, 3, " new<|endoftext|>"), (len(t) // 2 + 3, 1, None), (len(t), 0, "!")])
                  for t, r in now]
        schema = "doc_id long, leaves array<string>, leaf_tokens array<long>, edits array<struct<start: int, length: int, replacement: string>>"
        trees = edit_trees(spark.createDataFrame(edited, schema), PATH, added=ADDED).cache()
        want = Counter((r["doc_id"], t[:len(t) // 2] + " new<|endoftext|>" + t[len(t) // 2 + 4:] + "!" * bool(t)) for t, r in now)  # in an empty text the first covers the last
        got = trees.collect()
        assert Counter((r["doc_id"], "".join(r["leaves"])) for r in got) == want
        assert all(r["n_tokens"] == len(full("".join(r["leaves"]))) and r["chars_encoded"] < 3_000 for r in got)
    none = spark.createDataFrame([(1, None, None, None)], schema)
    assert [(r["n_tokens"], r["leaves"], r["n_edits"]) for r in edit_trees(none, PATH).collect()] == [(0, [], 0)]
    assert edit_trees(none.limit(0), PATH).count() == 0
