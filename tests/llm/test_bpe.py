import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vectide.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
MERGES = bpe.Merges(bpe.load(PATH))

TEXTS = [
    "", " ", "  ", "a", "I'll they've  it's\n\n x", "café naïve 你好 \U0001f600\U0001f600", "12345 67 8a9", "<|endoftext|>",
    "x<|endoftext|> y <|endof", "\t\t\n   z", "=" * 5000, "a" * 3000 + " " * 3000 + "b", " " * 2500, "'" * 2000 + "ll", "." * 1500 + "'s", " " + "Z" * 4000 + "'re 9" + "7" * 2500,
    "ab́c" * 900, "é" * 2100, "\n" * 3000 + "x", "x" + "\n" * 1999 + " y",
]


def lib(text):
    return LIB.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_whole_and_in_parts(k):
    text, rng = TEXTS[k], random.Random(k)
    want = lib(text)
    assert bpe.Encoder(MERGES).encode(text) == want
    for size in (1, 7, 1000):
        tool, got, at = bpe.Encoder(MERGES), [], 0
        while at < len(text):
            n = rng.randint(1, size)
            got += tool.feed(text[at : at + n])
            at += n
        assert got + tool.flush() == want
    assert bpe.Decoder(MERGES).decode(want) == LIB.decode(want, skip_special_tokens=False)


def test_random_texts():
    rng = random.Random(5)
    pool = "ab cdefghij  \n\t'slmtrved0123.,!?éß你=-_/#"
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 300)))
        if rng.random() < 0.3:
            text += rng.choice(pool) * rng.randint(1, 1500) + text
        want = lib(text)
        assert bpe.Encoder(MERGES).encode(text) == want
        tool, got, at = bpe.Encoder(MERGES), [], 0
        while at < len(text):
            n = rng.randint(1, 40)
            got += tool.feed(text[at : at + n])
            at += n
        assert got + tool.flush() == want


def test_piece_transducer_keeps_constant_memory():
    rng = random.Random(1)
    text = "".join(rng.choice(["th", "e", "er", "ing", "a", "zz", "on"]) for _ in range(40000))
    way, got, most = bpe.PieceTransducer(MERGES), [], 0
    for k in range(0, len(text), 100):
        got += way.feed(text[k : k + 100].encode())
        most = max(most, len(way.held))
    assert got + way.flush() == lib(text)
    assert most <= 4 * MERGES.lookahead + bpe.LONG + 200


def test_decoder_state():
    data = "é你\U0001f600".encode()
    by_byte = {b: MERGES.first[b] for b in range(256)}
    tool = bpe.Decoder(MERGES)
    assert "".join(tool.feed([by_byte[b]]) for b in data) + tool.flush() == data.decode()
    assert bpe.Decoder(MERGES).decode([by_byte[0xF0], by_byte[0x9F], by_byte[0x41]]) == "�A"


def test_frames(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, TEXTS[4], "z"), (3, TEXTS[4], "z")], "doc_id long, text string, token_ids string")
    both = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [r.token_ids for r in both] == [[], [], lib(TEXTS[4]), lib(TEXTS[4])]
    assert [r.decoded for r in both] == ["", "", TEXTS[4], TEXTS[4]]
    rows = bpe.digests(df, PATH).collect()
    assert [r.n_tokens for r in rows] == [0, 0, len(lib(TEXTS[4]))] + [len(lib(TEXTS[4]))]
    assert bpe.digests(df.limit(0), PATH).collect() == []


def test_digests_against_the_library(spark):
    texts = [*TEXTS, None, "", "a" * 5000, " " * 3000 + "end", "x <|endoftext|> y", "".join(chr(k) for k in range(0x20, 0x2000, 7)), ("wörter und words 123 " * 9000)[: 2 * bpe.PART + 77]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.digests(df, PATH).collect():
        ids = lib(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False)))
