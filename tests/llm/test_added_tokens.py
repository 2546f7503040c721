import random
from zlib import crc32

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tabwright.llm.packing import pack
from tabwright.llm.queries import _op1
from tabwright.llm.tokens import added_tokens, encoder

PATH, JSON = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))
TOKENIZER = Tokenizer.from_file(JSON)  # as it is: added tokens inside a text count
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "plain  text", "word " * 600 + "<|endoftext|>" + " word" * 600]


def want(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_ids_of_the_tokenizer():
    with open(PATH, "rb") as f:
        encode = encoder(f.read(), added_tokens(JSON))
    assert encode(TEXTS[0]) == want(TEXTS[0]) == [64, 220, 50256, 275]
    rng = random.Random(3)
    odd = ["<|endoftext|>", " ", "  ", "\n", "a", "'s", "<|", "|>", "é", "1", "endoftext", "\t", "汉"]
    for text in TEXTS + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 20))) for _ in range(500)]:
        assert encode(text) == want(text)


def test_query_and_pipeline_pack_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    expected = set()
    for key, text in enumerate(TEXTS):
        ids = [*want(text), 0]
        expected |= {(key, at, len(ids[at:at + 1024]), crc32(np.array(ids[at:at + 1024], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 1024)}
    for got in (pack(docs, PATH, added=added_tokens(JSON)), corpus_pipeline.packing_stage(spark, docs, "")):
        assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got.collect()} == expected
    assert {r["doc_id"] for r in _op1(lambda name: docs).where("ids_crc32 = %d" % crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes())).collect()} == {0}
