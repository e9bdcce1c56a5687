"""Encoding, decoding, counting and packing against the libraries themselves."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeweave.llm import bpe, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = " \n\t\r\x0b\x1c\x1f\x85\xa0 abcABC'sdrevmtl019,.!#é中ßİΣ́😀<|endoftext|>\0\1ª²"
FIXED = ["", "  a", "a ", "\n", "a\n\nb", " \n a", "a" * 3000, "ab" * 2000, " " * 300, "don't I'll 'ss", "foo <|endoftext|> bar<|endoftext|>", "x,y.z ,a .b ...", "1,000.5", "\0\0 \0", "the the the"]


def texts(n=3000):
    draw = random.Random(5)
    return FIXED + ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_encoding_is_the_librarys(library):
    own, sample = bpe.encoder(BYTE), texts()
    want = [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_batch(sample)] == want
    assert [own.vocabulary.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    library = Tokenizer.from_file(BYTE) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = library
    want = library.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(BYTE).encode_batch([text])[0].tolist() == want
    assert token_counts.counter(BYTE).count_batch([text]) == [len(want)]


def test_invalid_bytes_decode_to_replacements(library):
    assert bpe.encoder(BYTE).vocabulary.decode([222, 64, 50256]) == library.decode([222, 64, 50256], skip_special_tokens=False)


def test_a_small_cache_changes_nothing(library):
    own, sample = bpe.Encoder(BYTE), texts(500)
    own.cache.entries = 50
    for _ in range(3):
        assert [x.tolist() for x in own.encode_batch(sample)] == [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]


def test_counts_by_blocks(library):
    draw = random.Random(6)
    parts = ["'s", "'r", "'re", "'", "''", " '", "\n'", "<|endoftext|>", " ", "  ", "\n", "\n\n", "abc", "12", "!", "é"]
    own, sample = token_counts.counter(BYTE), texts(800) + ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(3000)]
    want = [len(e.ids) for e in library.encode_batch(sample, add_special_tokens=False)]
    for block in (token_counts.BLOCK, 1, 2, 7, 40):
        assert own.count_batch(sample, block) == want


def test_every_text_goes_through_the_scan(spark, library, monkeypatch):
    """On a table of documents: all texts are composed from the maps of their blocks, and the states stay few."""
    sample = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    own, scanned, scan = token_counts.Counter(BYTE), [], token_counts.Counter.scan
    monkeypatch.setattr(token_counts.Counter, "scan", lambda self, found: scanned.extend(found) or scan(self, found))
    got = own.count_batch(sample)
    assert got == [len(e.ids) for e in library.encode_batch(sample, add_special_tokens=False)]
    assert len(scanned) == len(sample) and sum(map(len, scanned)) == sum(max(1, -(-len(t) // token_counts.BLOCK)) if t else 0 for t in sample)
    assert len(own.words.states) < 100_000


def test_maps_compose_in_any_bracketing(library):
    own = token_counts.counter(BYTE)
    made = own.maps(["one tw", "o three", " four fi", "ve'", "re", None, "  six", " "])
    want = len(library.encode("one two three four five're<|endoftext|>  six ", add_special_tokens=False).ids)
    draw = random.Random(1)
    for _ in range(50):
        left = list(made)
        while len(left) > 1:
            i = draw.randrange(len(left) - 1)
            left[i : i + 2] = [token_counts.compose(own.machine, left[i], left[i + 1])]
        at, n = left[0].apply(own.machine, token_counts.START)
        assert n + own.machine.end(at) == want


def test_words_share_states():
    """Words that leave the same choices open are in one state, whatever they began with."""
    words = token_counts.Words(bpe.encoder(BYTE).vocabulary)
    ends = {id(words.run(words.root, begin + b"qzqzqz")[0]) for begin in (b"", b"xx", b"hello", b" some", b"zq" * 50)}
    assert len(ends) < 5
    runs = token_counts.Words(bpe.encoder(BYTE).vocabulary)
    runs.count(b"qz" * 50_000)
    assert len(runs.states) < 1000


def test_a_full_transducer_starts_again(monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 20)
    words = token_counts.Words(bpe.encoder(BYTE).vocabulary)
    for word in (b" hounourseth", b"xqzzt" * 100, b" hounourseth"):
        assert words.count(word) == len(bpe.encoder(BYTE).vocabulary.merge(word))
    assert len(words.states) <= 20


def test_wide_words_are_proposed_and_verified(library):
    draw, own = random.Random(7), bpe.Encoder(BYTE)
    sample = ["x" * 48, "x" * 49, "a" * 3000, "=" * 500, " " * 300, "中文" * 60, "é" * 100, "." * 77, "<>" * 100]
    sample += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(49, 300))) for _ in range(100)]
    assert [x.tolist() for x in own.encode_batch(sample)] == [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    assert own.vocabulary.long_words > own.vocabulary.long_merged > 0


def rows(spark, values):
    return spark.createDataFrame(values, "doc_id long, text string, n_tokens string, ids string")


EDGES = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "a b", "x", "y"), (3, "a b", "x", "y"), (None, "c", None, None), (5, "long " * 60_000, None, None)]


def test_round_trip_query(spark, library):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.bpe_round_trip(rows(spark, EDGES), BYTE).collect()}
    for doc_id, text, *_ in EDGES:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(rows(spark, []), BYTE).count() == 0
    encoded = bpe.bpe_encode(rows(spark, EDGES), BYTE)
    assert {r.text for r in bpe.bpe_decode(encoded, BYTE).collect()} == {t or "" for _, t, *_ in EDGES}


def test_count_query(spark, library):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(rows(spark, EDGES), BYTE).collect())
    want = sorted((d or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in EDGES)
    assert got == want
    assert token_counts.token_counts(rows(spark, []), BYTE).count() == 0


def test_word_tokens_are_the_librarys():
    import numpy as np

    library, sample = Tokenizer.from_file(WORD), texts()
    want = [e.ids for e in library.encode_batch(sample, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.word_tokens(WORD).encode_batch(sample)] == want


def test_differencing_levels_sums():
    draw = random.Random(3)
    sizes = [draw.randrange(1, 1000) for _ in range(600)]
    parts = packing.difference(sizes, 60)
    assert sorted(i for p in parts for i in p) == list(range(600))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 60
    assert packing.difference([8, 7, 6, 5, 4], 2) in ([[0, 1], [2, 3, 4]], [[2, 3, 4], [0, 1]], [[0, 2], [1, 3, 4]], [[1, 3, 4], [0, 2]])


def test_windows_rise_with_capacity():
    assert len(packing.windows([3000, 3000, 3000], 4096)) == 3
    assert packing.windows([], 10) == []
    for w in packing.windows([2500] * 7 + [500] * 3, 4096):
        assert sum(([2500] * 7 + [500] * 3)[i] for i in w) <= 4096


def test_pack_query(spark):
    library = Tokenizer.from_file(WORD)
    values = EDGES + [(i, f"word{i} " * (i * 7 % 900 + 1), None, None) for i in range(10, 140)]
    got = packing.pack(rows(spark, values), WORD).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text, *_ in values:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
        copies = sum(d == doc_id for d, *_ in values)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[p.start : p.start + p.length]))
    total = sum(r.length for r in got)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_sequence) <= total / 4096 * 1.1 + 2
    assert packing.pack(rows(spark, []), WORD).count() == 0
    with_ids = packing.pack(rows(spark, EDGES[2:4]), WORD, with_ids=True).collect()
    assert [r.ids[-1] for r in with_ids] == [2, 2]
