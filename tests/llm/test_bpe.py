"""Encoding, decoding and counting against the tokenizers library."""

import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodekv.llm.bpe import codec
from lodekv.llm.token_count import counter

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def cases():
    rng = random.Random(7)
    yield from ["", " ", "Hello, World! it's we'll I'D x'S", "a b c\x1cd\x85e", "<|startoftext|>Hi<|endoftext|> there<|endoftext|>", "<|START|>", "İstanbul ΣΑΣ ς ß ﬁ é Å", "日本語 テキスト 한국어 тест ١٢٣ 👍🏽 \U0001e900 ǅ", "x" * 3000, "ab" * 700 + "é" * 300, "\x00\x01 � ​"]
    for _ in range(300):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x11000), rng.randrange(0x1F300, 0x1FA00), 32, 32])) for _ in range(rng.randrange(60)))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, 0x12000, 64):
        yield " a".join(map(chr, points[k : k + 64]))
        yield "".join(map(chr, points[k : k + 64]))


def test_same_as_library(library):
    code, count = codec(PATH), counter(PATH)
    for text in cases():
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = code.encode(text)
        assert ids == struct.pack(f"<{len(want)}I", *want), repr(text)
        assert b" ".join(decoded).decode() == library.decode(want, skip_special_tokens=False) == code.decode(ids), repr(text)
        assert count(text) == len(want), repr(text)


def test_cuts_are_certain(library):
    """A fragment boundary never lies inside a token; some boundaries are found."""
    code, rng, cuts = codec(PATH), random.Random(3), 0
    for _ in range(2000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßжц") for _ in range(rng.randrange(1, 14)))
        fragments = code.cut(word)
        assert [s for f in fragments for s in f] == code.vocab.symbols(word)
        cuts += len(fragments) - 1
    assert cuts > 50


def test_null_is_empty():
    assert codec(PATH).encode(None) == (b"", [])
    assert counter(PATH)(None) == 0
