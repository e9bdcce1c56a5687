"""Packing: documents into sequences of at most ``capacity`` tokens.

A document longer than the capacity first gives whole sequences; what remains of
it is cut by halves. Others are one piece. Pieces are dealt evenly into groups of about ``GROUP``, and each
group is partitioned into windows by Karmarkar-Karp multiway differencing: the two
partial partitions with the largest spread are merged so that heavy windows of one
meet light windows of the other. If the heaviest window exceeds the capacity, the
number of windows rises and the group is partitioned again.

Groups hold a bounded number of small rows (an id, a length, a checksum), so no
task grows with the input, whatever a document's size or number of copies.
"""

from __future__ import annotations

import heapq
import itertools
import math
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep_alone, materialize, text_slices
from .bpe import byte_alphabet

CAPACITY, END_ID, GROUP, FINE, FINEST = 4096, 2, 2048, 512, 32
CACHE_ENTRIES, CACHE_LONGEST = 400_000, 64

_BLANK, _COMMA, _STOP = b" ,."
#: White space of the tokenizer's pattern: what is one byte of UTF-8 becomes a blank; of the others C2 leads two bytes, the rest lead three.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(b"\t\n\v\f\r")] = _BLANK
_WIDE = np.array([int.from_bytes(c.encode().ljust(3, b"\0")) for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))])
_LEADS = np.isin(np.arange(256), _WIDE >> 16)
#: A comma or full stop behind a plain letter or digit begins a word: those of ASCII, and what follows C3 in À-Ö, Ø-ö and ø-ÿ.
_LETTER = np.isin(np.arange(256), list(b"0123456789" + string.ascii_letters.encode()))
_AFTER_C3 = (np.arange(256) >= 0x80) & (np.arange(256) != 0x97) & (np.arange(256) != 0xB7)
#: A chunk of at most 64 such letters alone is one word of the pattern, and its small letters are composed already.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]){1,64}")
#: Its bytes as characters of the vocabulary, of small letters; blanks and newlines stay.
_SPELLED = np.zeros(256, np.uint32)
_SPELLED[[*byte_alphabet().values()]] = [ord(c) for c in byte_alphabet()]
_SPELLED[ord("A") : ord("Z") + 1] = _SPELLED[ord("a") : ord("z") + 1]
_SPELLED[0x80:0x9F] = _SPELLED[0xA0:0xBF]
_SPELLED[list(b" \n")] = list(b" \n")


class WordTokens:
    """Token ids of whole texts by the tokenizers library, which sees each distinct chunk once while it is cached.

    The vocabulary drops white space, so what stands between it is encoded alone. A batch is cut and
    its distinct chunks are found as arrays; only these become Python objects. Plain words go to the
    library's model directly, all other chunks through its normalizer and pattern.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of texts that begin at ``starts``, with blanks for all white space, and where its chunks begin.

        A chunk begins with a text, at a blank, or at a comma or full stop that begins a word.
        """
        plain = _PLAIN[data]
        lead = np.flatnonzero(_LEADS[data])
        if lead.size:
            second, third = data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
            two = data[lead] == 0xC2
            code = data[lead].astype(np.int64) << 16 | second.astype(np.int64) << 8 | np.where(two, 0, third)
            wide = np.isin(code, _WIDE)
            lead, two = lead[wide], two[wide]
            plain[lead] = plain[lead + 1] = plain[lead[~two] + 2] = _BLANK
        begins = plain == _BLANK
        stops = np.flatnonzero((plain == _COMMA) | (plain == _STOP))
        stops = stops[stops > 0]
        before = plain[stops - 1]
        begins[stops[_LETTER[before] | _AFTER_C3[before] & (plain[stops - 2] == 0xC3)]] = True
        begins[starts[starts < len(data)]] = True
        return plain, np.flatnonzero(begins)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if not any(texts):
            return [b""] * len(texts)
        _, offsets, data = pa.array(texts, pa.large_string()).buffers()
        starts = np.frombuffer(offsets, np.int64, len(texts) + 1)
        plain, at = self.cut(np.frombuffer(data, np.uint8, starts[-1]), starts)
        ends = np.append(at, starts[-1])
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(plain)]).dictionary_encode()
        ids = pa.array(self._ids(_items(chunks.dictionary)), pa.large_binary()).take(chunks.indices)
        return _items(ids, np.searchsorted(ends, starts))

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.new) > CACHE_ENTRIES // 2:
            self.old, self.new = self.new, {}
        new, old, fresh = self.new, self.old, []
        out = list(map(new.get, chunks))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            if (ids := old.get(chunks[k])) is None:
                fresh.append(k)
            else:
                out[k] = new[chunks[k]] = ids
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            for k, ids in zip(part, self._fresh([chunks[k] for k in part]), strict=True):
                out[k] = array("I", ids).tobytes()
                if len(chunks[k]) <= CACHE_LONGEST:
                    new[chunks[k]] = out[k]
        return out

    def _fresh(self, chunks: list[bytes]) -> Iterator[list[int]]:
        plain = list(map(_WORD.fullmatch, chunks))
        spelled = np.frombuffer(b"\n".join([c for c, p in zip(chunks, plain, strict=True) if p]), np.uint8)
        words = iter(_SPELLED[spelled].astype("<u4").tobytes().decode("utf-32-le").split())
        others = iter(self.tokenizer.encode_batch_fast([c.decode() for c, p in zip(chunks, plain, strict=True) if not p], add_special_tokens=False))
        tokenize = self.tokenizer.model.tokenize
        for p in plain:
            yield [t.id for t in tokenize(next(words))] if p else next(others).ids


def _items(of: pa.LargeBinaryArray, bounds: np.ndarray | slice = slice(None)) -> list[bytes]:
    """Bytes of each item, or of all items between ``bounds``."""
    _, offsets, data = of.buffers()
    whole = data.to_pybytes() if data else b""
    return [whole[lo:hi] for lo, hi in itertools.pairwise(np.frombuffer(offsets, np.int64, len(of) + 1)[bounds].tolist())]


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces.

    A document within the capacity stays whole. Of a longer one, which is cut anyway,
    the rest behind the whole sequences is halved, and from ``FINE`` tokens on cut into
    pieces of ``FINEST``: small pieces level out what the large ones leave between windows.
    """
    whole = n // capacity if n >= capacity else 0
    out = [(k * capacity, capacity) for k in range(whole)]
    at = whole * capacity
    while at < n:
        rest = n - at
        take = rest if not whole else min(rest, FINEST) if rest <= FINE else -(-rest // 2)
        out.append((at, take))
        at += take
    return out


class _Pieces:
    """Batches of documents to batches of pieces; with ``ids`` the pieces carry their token ids."""

    def __init__(self, path: str, capacity: int, ids: bool):
        self.path, self.capacity, self.ids = path, capacity, ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("packing", _loaded.clear)
        own, cap = word_tokens(self.path), self.capacity
        end = END_ID.to_bytes(4, "little")
        for part, texts in text_slices(batches, most=2_000_000):
            rows = []
            for doc_id, packed in zip(part.column("doc_id").to_pylist(), own.encode_batch(texts), strict=True):
                packed += end
                n = len(packed) // 4
                for start, length in cuts(n, cap):
                    cut = packed[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(cut), n, cut))
            doc, start, length, crc, n, cut = zip(*rows, strict=True)
            columns = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, n)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if self.ids:
                columns.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: ``k`` windows of near-equal sums, as lists of positions in ``sizes``.

    A partial partition is kept as its windows in falling order of load, without the
    empty ones; loads count from its lightest window, which the spread is measured from.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    # (minus spread, order of arrival, loads, window contents); contents are nested pairs, flattened at the end
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, a_in = heapq.heappop(heap)
        _, _, b, b_in = heapq.heappop(heap)
        free = k - len(b)
        # the heaviest of a meet empty windows of b first, then b's lightest
        loads, inside = a[:free], a_in[:free]
        for j in range(free, len(a)):
            at = len(b) - 1 - (j - free)
            loads.append(a[j] + b[at])
            inside.append((a_in[j], b_in[at]))
        rest = len(b) - max(0, len(a) - free)
        loads += b[:rest]
        inside += b_in[:rest]
        order = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        loads, inside = [loads[i] for i in order], [inside[i] for i in order]
        if len(loads) == k and loads[-1]:
            least = loads[-1]
            loads = [x - least for x in loads]
        spread = loads[0] - (loads[-1] if len(loads) == k else 0)
        heapq.heappush(heap, (-spread, tick, loads, inside))
        tick += 1
    out = []
    for tree in heap[0][3] if heap else []:
        items, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            else:
                items.append(t)
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within the capacity: as many as the sum needs, and more while the heaviest exceeds it."""
    if not sizes:
        return []
    k = math.ceil(sum(sizes) / capacity)
    while True:
        found = difference(sizes, k)
        over = max(sum(sizes[i] for i in w) for w in found)
        if over <= capacity:
            return [w for w in found if w]
        k += max(1, k // 500)


class _Windows:
    def __init__(self, capacity: int):
        self.capacity = capacity

    def __call__(self, key, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = pieces["length"].to_numpy()
        whole = np.flatnonzero(sizes == self.capacity)
        rest = np.flatnonzero(sizes < self.capacity)
        found = [[int(i)] for i in whole] + [[int(rest[i]) for i in w] for w in windows(sizes[rest].tolist(), self.capacity)]
        sequence, offset = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        for number, members in enumerate(found):
            at = 0
            for i in members:
                sequence[i], offset[i] = (int(key[0]) << 20) + number, at
                at += int(sizes[i])
        return pieces.assign(sequence_id=sequence, offset=offset).drop(columns="__group")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    Null and empty texts are documents of one id, the closing one; very long texts are
    many pieces. Repeated rows are packed each for itself, and null ids are kept. Pieces
    of equal length are dealt with by doc_id, start and checksum, so equal input gives
    equal windows. An empty table gives no pieces; other columns are not read, whatever
    their names. The pieces are written and counted when this is called, which sets the
    number of groups.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    cut = materialize(documents.select("doc_id", "text").mapInArrow(_Pieces(path, capacity, with_ids), schema), "pieces")
    groups = max(1, round(cut.count() / GROUP))
    # dealt by position, not by key: repeated documents spread like any others
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    place = _Windows(capacity)
    return dealt.groupBy("__group").applyInPandas(lambda key, rows: place(key, rows), schema + ", sequence_id long, offset long")
