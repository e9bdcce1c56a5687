"""Encoding for packing: where texts are cut, and its CPU time on texts whose words are known or new."""

import random
import time

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from citeweave.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def same(texts):
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokens(WORD).encode_batch(texts)] == want


def test_cuts_at_any_character():
    signs = [chr(c) for c in (*range(0x3100), *range(0xFE00, 0x10000), 0x1F600)]
    same([f"a{c}b,c. É{c},{c}.d" for c in signs])
    same([f"{c} ,{c}.Þ{c}" for c in signs])
    same([",a", ".", "", "é", ",", "×,", "÷.", "ß,", "\xa0", "a　", " .", "x́,y", "ÀÉ", "a" * 64 + " " + "É" * 64, "b" * 65 + "." + "é" * 65, "<|endoftext|>,a"])
    assert packing.WordTokens(WORD).encode_batch([]) == [] and packing.WordTokens(WORD).encode_batch([" ", ""]) == [b"", b""]


def test_rotating_the_cache_loses_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 40)
    draw, own, library = random.Random(8), packing.WordTokens(WORD), Tokenizer.from_file(WORD)
    for _ in range(60):
        texts = [" ".join("".join(draw.choice("abé1!") for _ in range(draw.randrange(1, 4))) for _ in range(12)) for _ in range(4)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def seconds(run, *inputs):
    """CPU seconds of the fastest of several runs, each on an input of its own."""
    out = []
    for x in inputs:
        began = time.process_time()
        run(x)
        out.append(time.process_time() - began)
    return min(out)


def test_cpu_seconds_of_known_and_new_words():
    draw, own = random.Random(1), packing.WordTokens(WORD)
    words = ["".join(draw.choice("abcdefgéñ") for _ in range(draw.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(draw.choice(words) + draw.choice(["", "", ",", "."]) for _ in range(2000)) for _ in range(150)]
    own.encode_batch(texts)
    # known words: 4.7 times as long as splitting alone when every word of a text became a Python object, 1.5 as arrays
    assert seconds(own.encode_batch, *[texts] * 7) < 3 * seconds(lambda ts: [t.split() for t in ts], *[texts] * 7)
    # new plain words: 1.4 times as long as the library's whole way when each went through it, 0.6 by its model alone
    fresh = [["".join(draw.choice("abcdefgé") for _ in range(9)) for _ in range(20_000)] for _ in range(5)]
    assert seconds(own.encode_batch, *fresh) < seconds(lambda ts: own.tokenizer.encode_batch_fast(ts, add_special_tokens=False), *fresh)
