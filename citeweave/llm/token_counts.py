"""Token counts by a compiled finite-state transducer and a prefix scan over chunk maps.

Two machines run in step. ``Words`` reads the bytes of a word. The encoding of every
prefix of a word ends in one certain token, and the rest of that encoding is the
encoding of what stands before that token. So what the coming bytes can still do
depends only on the places where a longer token may have begun: for each of them the
node of the vocabulary's prefix tree that the bytes since then lead to, the last token
before it, and how many tokens fewer there were. That is a state; words that agree in
it share it, whatever they began with. A transition carries how many tokens it emits,
less those it takes back.

``Machine`` reads the characters of a text. Its states say what kind of word is open
(letters, digits, signs, white space, or an apostrophe that may become a contraction),
the state of ``Words`` in it, and what has been read but is not yet dealt out: a white
space may end a run or begin the next word.

A text is cut into blocks. What a block does to any state is its map: state -> (state,
count). After a character that is no white space and one of " \\n" all states come
together. So a map is the block's head up to there, which is run from whatever state
comes in, the count behind it, and the state that the block ends in; blocks without
such a place are all head. Special strings in a text are maps of their own: all states
come together in the start. Maps compose associatively, and the maps of all texts of a
batch are composed by a scan, pairwise, level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._shared import keep_alone, text_slices
from .bpe import ChunkCache, Vocabulary, split_words

#: States that are kept for reuse. Beyond them the table starts anew.
MAX_STATES = 200_000
CACHE_ENTRIES = 1_000_000
#: Characters of a block.
BLOCK = 1 << 13
#: A white-space run begins a word if something else stands before it.
_MEET = re.compile(r"(?<=\S)[ \n]")


class State:
    """One state of ``Words``: parts (node, last token before it or -1, tokens less), the longest first; transitions as they are compiled."""

    __slots__ = ("next", "parts")

    def __init__(self, parts: tuple):
        self.parts = parts
        self.next: dict[int, tuple[State, int]] = {}


class Words:
    """The transducer of words: bytes in, numbers of tokens out. States and transitions are compiled on first use."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.merges = v.merges
        self.left, self.right, self.rank = v.left.tolist(), v.right.tolist(), v.rank.tolist()
        # the prefix tree of all tokens: (node << 8 | byte) -> node, and the token that a node spells
        self.tree: dict[int, int] = {}
        self.token = [-1]
        for spelt, k in v.ids.items():
            node = 0
            for b in spelt:
                to = self.tree.get(node << 8 | b)
                if to is None:
                    to = self.tree[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = k
        self.inner = bytearray(len(self.token))
        for key in self.tree:
            self.inner[key >> 8] = 1
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states; those still held elsewhere stay valid."""
        self.root = State(((0, -1, 0),))
        self.states = {self.root.parts: self.root}

    def stands(self, a: int, b: int) -> bool:
        """Do the tokens ``a b`` stay as they are side by side? The vocabulary's own test, for one pair."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        x, y, end_x, end_y = a, b, 1 << 40, 1 << 40
        good = True
        while True:
            m = self.merges.get((x, y))
            if m and m[0] < end_x and m[0] <= end_y:
                good = False
                break
            rx, ry = self.rank[x], self.rank[y]
            if not rx and not ry:
                break
            if rx > ry:
                end_x, x = rx, self.right[x]
            else:
                end_y, y = ry, self.left[y]
        if len(self.pairs) > MAX_STATES:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def hop(self, state: State, byte: int) -> tuple[State, int]:
        """The transition of a state on a byte: the next state and the tokens emitted."""
        child_of, token_of, inner, pairs = self.tree.get, self.token, self.inner, self.pairs
        found, emitted, alive = -1, 0, []
        for node, last, less in state.parts:
            child = child_of(node << 8 | byte)
            if child is None:
                continue
            # the longest token that fits behind what stands before it ends the new encoding
            if found < 0:
                token = token_of[child]
                if token >= 0:
                    if last < 0:
                        found, emitted = token, less + 1
                    else:
                        fits = pairs.get(last << 32 | token)
                        if fits or fits is None and self.stands(last, token):
                            found, emitted = token, less + 1
            if inner[child]:
                alive.append((child, last, less))
        parts = (*[(node, last, less - emitted) for node, last, less in alive], (0, found, 0))
        to = self.states.get(parts)
        if to is None:
            if len(self.states) >= MAX_STATES:
                self.clear()
            to = self.states[parts] = State(parts)
        state.next[byte] = to, emitted
        return to, emitted

    def run(self, state: State, data: bytes) -> tuple[State, int]:
        count = 0
        for b in data:
            to = state.next.get(b)
            state, emitted = to if to is not None else self.hop(state, b)
            count += emitted
        return state, count

    def count(self, word: bytes) -> int:
        """Tokens of a whole word."""
        return self.run(self.root, word)[1]


#: What a character is to the words of a text: a letter, a digit, white space, an apostrophe, or another sign.
_LETTER, _DIGIT, _SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")


class _Kinds(dict):
    def __missing__(self, c: str) -> str:
        kind = "letter" if _LETTER.match(c) else "digit" if _DIGIT.match(c) else "space" if _SPACE.match(c) else "quote" if c == "'" else "sign"
        self[c] = kind
        return kind


_kind = _Kinds()
#: Kind of the open word, its state, and what is read but not dealt out.
Open = tuple[str, State | None, str]
START: Open = ("start", None, "")
#: Letters that make a contraction behind an apostrophe, or begin one of two letters (fixed values).
_WHOLE, _HALF = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}


class Machine:
    """The transducer of texts. ``step`` reads a character, ``end`` closes a text; both say what they emit."""

    def __init__(self, words: Words):
        self.words = words

    def _begin(self, c: str, before: str = "") -> tuple[Open, int]:
        """A new word begins with ``c``, behind a blank that belongs to it."""
        kind = _kind[c]
        if kind == "space":
            return ("space", self.words.root, c), 0
        if kind == "quote":
            kind = "sign" if before else "quote"
        state, n = self.words.run(self.words.root, (before + c).encode())
        return (kind, state, ""), n

    def step(self, at: Open, c: str) -> tuple[Open, int]:
        kind, state, held = at
        own = _kind[c]
        if kind == own and kind in ("letter", "digit", "sign") or kind == "sign" and own == "quote":
            state, n = self.words.run(state, c.encode())
            return (kind, state, ""), n
        if kind == "space":
            if own == "space":
                # what was held belongs to the run
                state, n = self.words.run(state, held.encode())
                return (kind, state, c), n
            if held == " ":
                return self._begin(c, " ")
            alone = self.words.count(held.encode())
            at, n = self._begin(c)
            return at, alone + n
        if kind == "quote":
            if held:
                if _HALF[held] == c:
                    return START, self.words.run(state, (held + c).encode())[1]
                # no contraction: the apostrophe was a word, and letters began behind it
                at, n = self._begin(held)
                at, more = self.step(at, c)
                return at, n + more
            if c in _WHOLE:
                return START, self.words.run(state, c.encode())[1]
            if c in _HALF:
                return (kind, state, c), 0
            if own in ("sign", "quote"):
                state, n = self.words.run(state, c.encode())
                return ("sign", state, ""), n
        return self._begin(c)

    def end(self, at: Open) -> int:
        kind, state, held = at
        if kind == "space":
            return self.words.run(state, held.encode())[1]
        return self.words.count(held.encode()) if held else 0

    def run(self, at: Open, text: str) -> tuple[Open, int]:
        count = 0
        for c in text:
            at, n = self.step(at, c)
            count += n
        return at, count


class Map:
    """state -> (state, count) of a stretch of text.

    Any state runs over ``head``. If ``meets``, the word that is open then ends and all
    states come together; ``count`` tokens follow, and ``after`` is the state in the
    end. If not, the head is all.
    """

    __slots__ = ("after", "count", "head", "meets")

    def __init__(self, head: str, meets: bool = False, count: int = 0, after: Open = START):
        self.head, self.meets, self.count, self.after = head, meets, count, after

    def apply(self, machine: Machine, at: Open) -> tuple[Open, int]:
        at, n = machine.run(at, self.head)
        return (self.after, n + machine.end(at) + self.count) if self.meets else (at, n)


def compose(machine: Machine, a: Map, b: Map) -> Map:
    """``a``, then ``b``."""
    if not a.meets:
        return Map(a.head + b.head, b.meets, b.count, b.after)
    after, n = b.apply(machine, a.after)
    return Map(a.head, True, a.count + n, after)


class Counter:
    """Counts tokens of whole texts; one for each worker and vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = Words(self.vocabulary)
        self.machine = Machine(self.words)
        #: Stretches between two places where all states come together always emit the same.
        self.cache = ChunkCache(self._count_chunks, CACHE_ENTRIES)

    def _count_chunks(self, chunks: list[str]) -> list[int]:
        return [sum(self.words.count(w.encode()) for w in split_words(self.vocabulary, c)) for c in chunks]

    def stretches(self, text: str, block: int) -> Iterator[str | None]:
        """The blocks of a text in order; None for a special string."""
        special = self.vocabulary.special
        pieces = self.vocabulary._special_split.split(text) if special and any(s in text for s in special) else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield None
            else:
                yield from (piece[i : i + block] for i in range(0, len(piece), block))

    def maps(self, blocks: list[str | None]) -> list[Map]:
        """The map of every block, each by itself."""
        cuts: list[tuple[int, int] | None] = []
        inner: list[str] = []
        for b in blocks:
            cuts.append(None)
            if b is None or (first := _MEET.search(b)) is None:
                continue
            # the last such place: before the last run of white space that begins with one of " \n"
            begin, last = first.start(), max(b.rfind(" "), b.rfind("\n"))
            while last > begin and not (b[last] in " \n" and not b[last - 1].isspace()):
                last -= 1
            cuts[-1] = begin, last
            inner.append(b[begin:last])
        counts = iter([sum(v) for v in self.cache.values(inner)])
        out = []
        for b, cut in zip(blocks, cuts, strict=True):
            if b is None:
                out.append(Map("", True, 1))
            elif cut is None:
                out.append(Map(b))
            else:
                after, n = self.machine.run(START, b[cut[1] :])
                out.append(Map(b[: cut[0]], True, next(counts) + n, after))
        return out

    def scan(self, rows: list[list[Map]]) -> list[Map]:
        """The composition of each row of maps: all rows in step, pairwise, level by level."""
        while any(len(r) > 1 for r in rows):
            rows = [[compose(self.machine, *r[i : i + 2]) if i + 1 < len(r) else r[i] for i in range(0, len(r), 2)] for r in rows]
        return [r[0] if r else Map("") for r in rows]

    def count_batch(self, texts: list[str], block: int = BLOCK) -> list[int]:
        """Tokens of whole texts: the maps of their blocks, composed, applied to the start."""
        cut = [list(self.stretches(t, block)) for t in texts]
        made = iter(self.maps([b for own in cut for b in own]))
        out = []
        for whole in self.scan([[next(made) for _ in own] for own in cut]):
            at, n = whole.apply(self.machine, START)
            out.append(n + self.machine.end(at))
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    keep_alone("token counts", _counters.clear)
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


class _Count:
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(self.path)
        for part, texts in text_slices(batches, most=2_000_000):
            n = own.count_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > self.limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )


def token_counts(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, bytes, tokens and whether these exceed ``limit``, for every whole text.

    Null and empty texts have no tokens. Special strings in a text count as the one
    token that the library makes of them. Very long texts are many blocks. Rows are
    counted each for itself: repeated rows repeat their counts, null ids are kept, and
    equal counts need no order. An empty table gives an empty one; other columns are not read.
    """
    return documents.select("doc_id", "text").mapInArrow(_Count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
