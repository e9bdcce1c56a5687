"""Byte-pair encoding and decoding by speculation and verification.

A batch of distinct words is first cut greedily into the longest tokens of the
vocabulary. Whether such a proposal is what the merges would have made depends on
adjacent tokens alone, so one vectorised pass tests every adjacent pair of the
whole batch. Only words with a failing pair go through exact merging.

Two neighbours ``a b`` stand if no merge across their boundary would have fired
while they were being built. On the way down the right edge of ``a`` and the left
edge of ``b``, each part lives from the rank that made it to the rank that used it
up; a crossing merge fires if its rank falls into both lives. On equal ranks the
merge further left goes first.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._shared import keep_alone, text_slices

NEVER = np.int64(1 << 40)
#: Entries of a worker's cache of chunks; the older half goes when it is full. Longer chunks are not kept.
CACHE_ENTRIES, CACHE_LONGEST = 800_000, 64
#: Bytes of words that are handled in step; wider ones are proposed each for itself.
WIDTHS = (8, 12, 16, 24, 48)
_draw = np.random.default_rng(20240229)
BYTE_HASH = _draw.integers(1, 1 << 63, 256, np.uint64)
HASH_BASE = np.uint64(int(_draw.integers(1 << 62, 1 << 63)) | 1)
HASH_POWERS = np.cumprod(np.append(np.uint64(1), np.full(256, HASH_BASE, np.uint64)), dtype=np.uint64)


def hash_bytes(data: bytes) -> int:
    h, base = 0, int(HASH_BASE)
    for b in data:
        h = (h * base + int(BYTE_HASH[b])) & 0xFFFFFFFFFFFFFFFF
    return h


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary with its merges, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ids = model["vocab"]
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, k in ids.items():
            self.bytes[k] = bytes(alphabet[c] for c in token)
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.names = [str(k) for k in range(size)]
        self.ids = {self.bytes[k]: k for k in ids.values()}
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate((m if isinstance(m, list) else m.split(" ") for m in model["merges"]), 1):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.merges[x, y] = (r, z)
            if not self.rank[z]:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.int64(1) << 62)
        self._ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], NEVER)
        self._made = np.zeros(len(self.merges) + 1, np.int64)
        for r, z in self.merges.values():
            self._made[r] = z
        self._byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self._longest = np.ones(1 << 16, np.int64)
        for t in self.ids:
            if len(t) > 1:
                self._longest[t[0] << 8 | t[1]] = max(self._longest[t[0] << 8 | t[1]], len(t))
        tokens = list(self.ids)
        hashes = np.array([hash_bytes(t) for t in tokens], np.uint64)
        order = np.argsort(hashes)
        self._hashes = np.append(hashes[order], np.uint64((1 << 64) - 1))
        self._hash_ids = np.append(np.array([self.ids[t] for t in tokens], np.int64)[order], -1)
        #: Words beyond the width classes that were proposed, and those of them that had to be merged.
        self.long_words = self.long_merged = 0
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: does no merge cross their boundary?"""
        keys, back = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        good = np.ones(len(keys), bool)
        live = np.arange(len(keys))
        x, y = keys >> 32, keys & 0xFFFFFFFF
        end_x, end_y = np.full(len(keys), NEVER), np.full(len(keys), NEVER)
        while live.size:
            m = self.merge_ranks(x, y)
            fires = (m < end_x) & (m <= end_y) & (m < NEVER)
            good[live[fires]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~fires & ((rx > 0) | (ry > 0))
            live, x, y, rx, ry, end_x, end_y = live[on], x[on], y[on], rx[on], ry[on], end_x[on], end_y[on]
            down = rx > ry
            end_x, end_y = np.where(down, rx, end_x), np.where(down, end_y, ry)
            x, y = np.where(down, self.right[x], x), np.where(down, y, self.left[y])
        return good[back]

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._hashes, hashes)
        return np.where(self._hashes[at] == hashes, self._hash_ids[at], -1)

    def propose(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match, all words in step: their tokens (-1 beyond the last) and how many.

        ``rows`` holds the words as bytes, one a row. Substrings are looked up by a
        64-bit polynomial hash, which differences of prefix hashes give.
        """
        n, width = rows.shape
        prefix = np.zeros((n, width + 1), np.uint64)
        for j in range(width):
            prefix[:, j + 1] = prefix[:, j] * HASH_BASE + BYTE_HASH[rows[:, j]]
        out, count, at = np.full((n, width), -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(sizes > 0)
        while live.size:
            start = at[live]
            first = rows[live, start].astype(np.int64)
            second = rows[live, np.minimum(start + 1, width - 1)]
            length = np.minimum(sizes[live] - start, self._longest[first << 8 | second])
            found = np.full(live.size, -1, np.int64)
            todo = np.arange(live.size)
            while todo.size:
                r, s, k = live[todo], start[todo], length[todo]
                ids = self._lookup(prefix[r, s + k] - prefix[r, s] * HASH_POWERS[k])
                found[todo] = ids
                todo = todo[ids < 0]
                length[todo] -= 1
            out[live, count[live]] = found
            count[live] += 1
            at[live] += length
            live = live[at[live] < sizes[live]]
        return out, count

    def merge_rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words in step, one merge of each in a round: the lowest rank, then the leftmost."""
        n, width = tokens.shape
        out, sizes = np.full((n, width), -1, np.int64), np.zeros(n, np.int64)
        rows, owner = tokens, np.arange(n)
        ranks = self._row_ranks(rows[:, :-1], rows[:, 1:])
        place = np.arange(width)
        while True:
            at = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            over = (ranks[np.arange(len(rows)), at] == NEVER) if width > 1 else np.ones(len(rows), bool)
            if over.any():
                out[owner[over], : rows.shape[1]] = rows[over]
                rows, owner, ranks, at = rows[~over], owner[~over], ranks[~over], at[~over]
            if not len(rows):
                break
            r = np.arange(len(rows))
            made = self._made[ranks[r, at]]
            shift = place[None, : rows.shape[1] - 1] + (place[None, : rows.shape[1] - 1] > at[:, None])
            rows = np.take_along_axis(rows, shift, 1)
            rows[r, at] = made
            wide = rows.shape[1]
            if wide > 1:
                ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], ranks.shape[1] - 1), 1)
                right = np.minimum(at + 1, wide - 1)
                has = at + 1 < wide
                ranks[r[has], at[has]] = self._row_ranks(made[has], rows[r[has], right[has]])
                has = at > 0
                ranks[r[has], at[has] - 1] = self._row_ranks(rows[r[has], at[has] - 1], made[has])
            else:
                ranks = np.full((len(rows), 1), NEVER)
        sizes = (out >= 0).sum(1)
        return out, sizes

    def _row_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where((a < 0) | (b < 0), NEVER, self.merge_ranks(np.maximum(a, 0), np.maximum(b, 0)))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals first."""
        part = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n, merges = len(part), self.merges
        if n < 48:
            while len(part) > 1:
                best, at = (1 << 40, 0), -1
                for i in range(len(part) - 1):
                    m = merges.get((part[i], part[i + 1]))
                    if m and m[0] < best[0]:
                        best, at = m, i
                if at < 0:
                    break
                part[at : at + 2] = [best[1]]
            return part
        # a heap of candidate merges over a linked list, for long words
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, part[i], part[i + 1]) for i in range(n - 1) if (m := merges.get((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j >= n or part[j] != y:
                continue
            part[i], part[j] = merges[x, y][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((part[i], part[after[i]])):
                    heapq.heappush(heap, (m[0], i, part[i], part[after[i]]))
            if before[i] >= 0 and (m := merges.get((part[before[i]], part[i]))):
                heapq.heappush(heap, (m[0], before[i], part[before[i]], part[i]))
        return [k for k in part if k >= 0]

    def propose_long(self, word: bytes) -> list[int]:
        """Greedy longest match of one word that is wider than the classes."""
        out, at, ids, longest = [], 0, self.ids, self._longest
        while at < len(word):
            end = min(len(word), at + (int(longest[word[at] << 8 | word[at + 1]]) if at + 1 < len(word) else 1))
            while (token := ids.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, packed as little-endian unsigned 32-bit numbers.

        Words of every width are proposed, then all their adjacent pairs are tested at
        once, and words with a failing pair are merged. Words of one width class are
        proposed and merged in step; wider ones each for itself, and tested together.
        """
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            classes.setdefault(next((c for c in WIDTHS if len(w) <= c), 0), []).append(k)
        for k, ids in self._encode_long([(k, words[k]) for k in classes.pop(0, ())]):
            out[k] = ids
        for width, members in classes.items():
            for lo in range(0, len(members), 65536):
                own = members[lo : lo + 65536]
                rows = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in own]), np.uint8).reshape(-1, width)
                sizes = np.fromiter((len(words[k]) for k in own), np.int64, len(own))
                tokens, count = self.propose(rows, sizes)
                r, c = np.nonzero(tokens[:, 1:] >= 0)
                failing = np.unique(r[~self.compatible(tokens[r, c], tokens[r, c + 1])]) if len(r) else r
                if len(failing):
                    base = np.where(np.arange(width)[None, :] < sizes[failing, None], self._byte_ids[rows[failing]], -1)
                    tokens[failing], count[failing] = self.merge_rows(base)
                flat = np.ascontiguousarray(tokens[tokens >= 0], "<u4").tobytes()
                ends = (np.cumsum(count) * 4).tolist()
                start = 0
                for k, end in zip(own, ends, strict=True):
                    out[k] = flat[start:end]
                    start = end
        return out

    def _encode_long(self, words: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        proposed = [np.array(self.propose_long(w), np.int64) for _, w in words]
        if not words:
            return
        flat, owner = np.concatenate(proposed), np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inside = owner[1:] == owner[:-1]
        failing = set(owner[:-1][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])].tolist())
        self.long_words, self.long_merged = self.long_words + len(words), self.long_merged + len(failing)
        for i, (k, w) in enumerate(words):
            yield k, np.array(self.merge(w) if i in failing else proposed[i], "<u4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD. Special tokens are kept."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


#: The pre-tokeniser of the public byte-level vocabularies (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: No word spans the place before a white-space run that follows something else.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: A comma or full stop after a letter or digit begins a word; this finds any other.
_ODD_STOP = re.compile(r"(?<![^\W_])[,.]")
#: First characters of a chunk's key: it stands as it is behind START or GLUED; a newline is part of
#: the chunk; any other key lost one space in front.
START, GLUED = "\0", "\1"


def chunk_keys(text: str) -> list[str]:
    """Cut a text at places that no word spans, into keys for a cache."""
    if START not in text and GLUED not in text and not _ODD_STOP.search(text):
        parts = text.replace("\n", " \n").replace(",", " \1,").replace(".", " \1.").split(" ")
        # a text that begins with a blank or a newline has no chunk before it
        led = not parts[0]
        if led:
            del parts[0]
        if parts and "" not in parts and "\n" not in parts:
            if not led:
                parts[0] = START + parts[0]
            return parts
    return [word_key(p) for p in _CUT.split(text)]


def word_key(chunk: str) -> str:
    if chunk[:1] == "\n" or chunk[:1] == " " and chunk[1:2] not in ("", "\n", START, GLUED):
        return chunk.removeprefix(" ")
    return START + chunk


def key_chunk(key: str) -> str:
    head = key[:1]
    return key[1:] if head == START or head == GLUED else key if head == "\n" else " " + key


class ChunkCache:
    """Chunk -> value, filled by ``compute`` on lists of distinct chunks.

    Of two generations the older one goes when the newer is full, so memory is bounded.
    """

    def __init__(self, compute: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        self.compute, self.entries, self.new, self.old = compute, entries // 2, {}, {}

    def peek(self, key: str):
        found = self.new.get(key)
        return self.old.get(key) if found is None else found

    def values(self, texts: list[str]) -> list[list]:
        """For every text the values of its chunks in order."""
        cut = [chunk_keys(t) for t in texts]
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set(itertools.chain.from_iterable(cut)).difference(new)
        fresh, extra = [], {}
        for c in missing:
            if c in old:
                new[c] = old[c]
            else:
                fresh.append(c)
        if fresh:
            for c, v in zip(fresh, self.compute([key_chunk(c) for c in fresh]), strict=True):
                if len(c) <= CACHE_LONGEST:
                    new[c] = v
                else:
                    extra[c] = v
        if extra:
            return [[new[c] if c in new else extra[c] for c in parts] for parts in cut]
        return [list(map(new.__getitem__, parts)) for parts in cut]


def split_words(vocabulary: Vocabulary, chunk: str) -> list[str | int]:
    """Words of a chunk; special tokens, which come first, as their ids."""
    core = chunk[1:] if chunk[:1] == " " else chunk
    if core.isascii() and core.isalpha():
        return [chunk]
    if vocabulary._special_split is not None and any(s in chunk for s in vocabulary.special):
        out: list[str | int] = []
        for k, piece in enumerate(vocabulary._special_split.split(chunk)):
            out += [vocabulary.special[piece]] if k % 2 else WORDS.findall(piece)
        return out
    return WORDS.findall(chunk)


class Encoder:
    """Texts to token ids with a bounded cache; one for each worker and vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cache = ChunkCache(self._encode_chunks)

    def _encode_chunks(self, found: list[str]) -> list[bytes]:
        split = [split_words(self.vocabulary, c) for c in found]
        packed: dict[str, bytes] = {}
        fresh = []
        for w in {w for s in split for w in s if isinstance(w, str)}:
            known = self.cache.peek(word_key(w))
            if known is None:
                fresh.append(w)
            else:
                packed[w] = known
        packed.update(zip(fresh, self.vocabulary.encode_words([w.encode() for w in fresh]), strict=True))
        return [packed[s[0]] if len(s) == 1 and isinstance(s[0], str) else b"".join([packed[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in s]) for s in split]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(v), "<u4") for v in self.cache.values(texts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    keep_alone("byte pairs", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Task:
    """What a worker runs on its batches; the vocabulary is loaded there, by path."""

    def __init__(self, path: str):
        self.path = path


class _Encode(_Task):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(self.path)
        for part, texts in text_slices(batches, most=2_000_000):
            ids = own.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])


class _Decode(_Task):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(self.path).vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [own.decode(k) if k is not None else None for k in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


class _RoundTrip(_Task):
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(self.path)
        names = own.vocabulary.names
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part, texts in text_slices(batches, most=2_000_000):
            n, ids_sha, text_sha = [], [], []
            for array in own.encode_batch(texts):
                ids = array.tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(names.__getitem__, ids)).encode()))
                text_sha.append(sha(own.vocabulary.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def bpe_encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and token ids of every whole text. Null and empty texts have no ids; special strings in a text are special tokens."""
    return documents.select("doc_id", "text").mapInArrow(_Encode(path), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of token ids (columns doc_id, ids); null ids give a null text."""
    return encoded.select("doc_id", "ids").mapInArrow(_Decode(path), "doc_id long, text string")


def bpe_round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Encode every whole text, decode the ids, and return digests of both.

    Null and empty texts have no ids and decode to the empty text. Very long texts and
    words go the same way as others. Rows are judged each for itself: repeated rows repeat
    their results, null ids are kept, nothing is ordered. An empty table gives an empty
    one; other columns are not read, whatever their names.
    """
    return documents.select("doc_id", "text").mapInArrow(_RoundTrip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
