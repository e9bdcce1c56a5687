"""Batch kernels for what built-in functions do too slowly: terms of texts and their embedding slots.

Stemming is a choice among lists for each word, and a slot is a hash for each term. As
expressions inside lambdas they are evaluated for every occurrence, outside generated
code. Here a worker remembers each distinct word, and Arrow batches go in and out.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable
from decimal import ROUND_HALF_UP, Decimal
from hashlib import sha1
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from . import vocab

#: Distinct words that a worker remembers.
REMEMBERED = 200_000
_WORD = re.compile("[a-z0-9]{3,}")
_OPERAND = re.compile(r'(-?)"([^"]*)"|(-?)([^\s"]+)')
_STEMS = {form: forms[0] for forms in vocab.STEMS for form in forms}


def stem(word: str) -> str:
    """One search term from one lower-case word."""
    if word in _STEMS:
        return _STEMS[word]
    if len(word) > 4:
        if word.endswith("ies"):
            return word[:-3] + "y"
        if word.endswith("s") and not word.endswith("ss"):
            return word[:-1]
    return word


class _Terms(dict):
    """Word -> its term, or "" if it is none."""

    def __missing__(self, word: str) -> str:
        term = stem(word)
        term = term if len(term) > 2 and term not in vocab.STOPWORDS else ""
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = term
        return term


class _Codes(dict):
    """Word -> (first four bytes of its term's SHA-1, +1 or -1 by the parity of the fifth), or None if it is no term."""

    def __missing__(self, word: str) -> tuple[int, int] | None:
        term, code = _terms[word], None
        if term:
            digest = sha1(term.encode(), usedforsecurity=False).digest()
            code = int.from_bytes(digest[:4], "big"), 1 - digest[4] % 2 * 2
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code
        return code


_terms, _codes = _Terms(), _Codes()


def terms(text: str) -> list[str]:
    """Stemmed terms longer than two letters that are no stopwords, in order, repeats kept."""
    return [t for w in _WORD.findall(text.lower()) if (t := _terms[w])]


def slots(text: str, dimensions: int) -> dict[int, int]:
    """Signed counts of a text's terms by dimension, ascending; those that cancel out stay as 0."""
    out: dict[int, int] = {}
    for word, n in Counter(_WORD.findall(text.lower())).items():
        if (code := _codes[word]) is not None:
            slot = code[0] % dimensions
            out[slot] = out.get(slot, 0) + n * code[1]
    return dict(sorted(out.items()))


class _Units(dict):
    """(signed count, sum of squared counts) -> the value in the embedding, rounded as the database rounds."""

    def __missing__(self, key: tuple[int, int]) -> float:
        value = float(Decimal(repr(key[0] / math.sqrt(key[1]))).quantize(Decimal("1e-8"), ROUND_HALF_UP)) if key[1] else 0.0
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


_units = _Units()


class Asked:
    """What the questions of one document ask: the places of those that have a term, or a value in a slot of the embedding."""

    def __init__(self) -> None:
        self.squares: list[float] = []
        self.by_term: dict[str, list[int]] = {}
        self.by_slot: dict[int, list[tuple[int, float]]] = {}

    def add(self, q_terms: Iterable[str], embedding: dict[int, float], square: float) -> None:
        at = len(self.squares)
        self.squares.append(square)
        for t in q_terms:
            self.by_term.setdefault(t, []).append(at)
        for slot, value in embedding.items():
            self.by_slot.setdefault(slot, []).append((at, value))


#: Characters of texts, and pairs of a chunk and a question, that are met at once.
AT_ONCE = 500_000
#: Values in embeddings that stand in a table: squares of texts below the first, counts below half the second.
_SQUARES, _COUNTS = 4_096, 16
_table = np.full(_SQUARES * _COUNTS, np.nan)


def _values(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``_units`` of every count and its text's sum of squares."""
    half = _COUNTS // 2
    at = np.where((np.abs(counts) < half) & (totals < _SQUARES), totals * _COUNTS + counts + half, -1)
    values = _table[at]
    for k in np.unique(at[np.isnan(values) & (at >= 0)]).tolist():
        _table[k] = _units[k % _COUNTS - half, k // _COUNTS]
    values = _table[at]
    for i in np.flatnonzero(at < 0).tolist():
        values[i] = _units[int(counts[i]), int(totals[i])]
    return values


class _Postings:
    """Sorted keys, each with its run of rows of the columns."""

    def __init__(self, found: dict[int, list], kinds: list) -> None:
        keys = sorted(found)
        rows = [x for k in keys for x in found[k]]
        self.keys = np.array(keys, np.int64)
        self.sizes = np.array([len(found[k]) for k in keys], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.columns = [np.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    def met(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The places of the keys that are found, one for each row of their runs, in order, and these rows."""
        if not len(self.keys):
            return np.zeros(0, np.int64), [c[:0] for c in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = np.flatnonzero(self.keys[at] == keys)
        sizes = self.sizes[at[own]]
        rows = np.repeat(self.starts[at[own]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(own, sizes), [c[rows] for c in self.columns]


class _Words(dict):
    """Word -> its place in the lists of slots, signs, and places of terms among those asked; -1 where there is none."""

    def __init__(self, terms: dict[str, int], dimensions: int) -> None:
        self.terms, self.dimensions = terms, dimensions
        self.slots, self.signs, self.asked = array("q"), array("q"), array("q")

    def __missing__(self, word: str) -> int:
        code = _codes[word]
        self.slots.append(-1 if code is None else code[0] % self.dimensions)
        self.signs.append(0 if code is None else code[1])
        self.asked.append(-1 if code is None else self.terms.get(_terms[word], -1))
        self[word] = at = len(self)
        return at


class Meeting:
    """What the questions of all documents ask, by document and term and by document and slot."""

    def __init__(self, asked: dict[str, Asked], dimensions: int) -> None:
        self.dimensions = dimensions
        self.documents = {document: d for d, document in enumerate(asked)}
        self.sizes = np.array([*(len(a.squares) for a in asked.values()), 0], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.squares = np.array([q for a in asked.values() for q in a.squares], np.float64)
        self.terms: dict[str, int] = {}
        for a in asked.values():
            for t in a.by_term:
                self.terms.setdefault(t, len(self.terms))
        n = len(self.terms)
        self.by_term = _Postings({d * n + self.terms[t]: [(at,) for at in found] for d, a in enumerate(asked.values()) for t, found in a.by_term.items()}, [np.int64])
        self.by_slot = _Postings({d * dimensions + slot: found for d, a in enumerate(asked.values()) for slot, found in a.by_slot.items()}, [np.int64, np.float64])
        self.words = _Words(self.terms, dimensions)

    def _places(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row and place of every word."""
        found = [_WORD.findall(t.lower()) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        places = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        return np.repeat(np.arange(len(found)), sizes), places

    def meet(self, documents: list, paths: list, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every row the number of its document's questions; then one after the other, for each of
        these, the number of its terms in path and text, and the cosine of both embeddings, not below 0.

        Sums are taken in the order of slots, as ``vectors`` takes them.
        """
        if len(self.words) > REMEMBERED:
            self.words = _Words(self.terms, self.dimensions)
        n, d = len(texts), self.dimensions
        doc = np.array([self.documents.get(x, len(self.documents)) for x in documents], np.int64)
        sizes = self.sizes[doc]
        pairs, base = int(sizes.sum()), np.cumsum(sizes) - sizes
        (row, word), (path_row, path_word) = self._places(texts), self._places(paths)
        # copies, for these still grow
        slots, signs, asked = (np.array(x, np.int64) for x in (self.words.slots, self.words.signs, self.words.asked))

        term_row, term = np.concatenate([row, path_row]), asked[np.concatenate([word, path_word])]
        term_row, term = np.divmod(np.unique((term_row * len(self.terms) + term)[term >= 0]), max(len(self.terms), 1))
        own, (at,) = self.by_term.met(doc[term_row] * len(self.terms) + term)
        hits = np.bincount(base[term_row[own]] + at, minlength=pairs)

        # signs in the lowest bit, so that words of one slot of a row lie side by side with them
        slot = slots[word]
        coded = ((row * d + slot) * 2 + (signs[word] > 0))[slot >= 0]
        coded.sort()
        key = coded >> 1
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.add.reduceat((coded & 1) * 2 - 1, starts) if len(starts) else key
        row, slot = np.divmod(key[starts], d)
        totals = np.bincount(row, counts * counts, n).astype(np.int64)
        value = _values(counts, totals[row])
        square = np.bincount(row, value * value, n)
        own, (at, other) = self.by_slot.met(doc[row] * d + slot)
        inner = np.bincount(base[row[own]] + at, other * value[own], pairs)
        asked_square = self.squares[np.repeat(self.first[doc] - base, sizes) + np.arange(pairs)]
        norm = np.sqrt(asked_square * np.repeat(square, sizes))
        return sizes, hits, np.divide(inner, norm, out=np.zeros(pairs), where=inner > 0)

    def slices(self, documents: list, texts: list) -> Iterable[slice]:
        """Runs of rows of bounded characters and pairs, one row at least."""
        start = taken = 0
        for i, (document, text) in enumerate(zip(documents, texts, strict=True)):
            taken += len(text) + self.sizes[self.documents.get(document, len(self.documents))] + 1
            if taken >= AT_ONCE:
                yield slice(start, i + 1)
                start, taken = i + 1, 0
        if start < len(texts):
            yield slice(start, len(texts))


def met_by(asked: dict[str, Asked], dimensions: int) -> Callable:
    """A kernel from document, path and text of chunks to ``hits`` and ``similarity`` by the place of a question of the document.

    It is said to be nondeterministic: else Spark computes it a second time below a join, to filter out nulls that it never gives.
    """
    meeting = Meeting(asked, dimensions)

    @F.arrow_udf(StructType([StructField("hits", ArrayType(IntegerType(), False), False), StructField("similarity", ArrayType(DoubleType(), False), False)]))
    def meet(documents: pa.Array, paths: pa.Array, texts: pa.Array) -> pa.Array:
        own, path, text = documents.to_pylist(), [p or "" for p in paths.to_pylist()], [t or "" for t in texts.to_pylist()]
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        sizes, hits, similar = map(np.concatenate, zip(none, *(meeting.meet(own[s], path[s], text[s]) for s in meeting.slices(own, text)), strict=True))
        return pa.StructArray.from_arrays([_lists(sizes, pa.array(hits.astype(np.int32))), _lists(sizes, pa.array(similar))], ["hits", "similarity"])

    return meet.asNondeterministic()


def web_query(question: str) -> dict:
    """A question in web search syntax: words side by side must all occur, "or" parts alternatives, quotes make a phrase, a leading minus excludes.

    ``any`` are the alternatives, each a list of items that must all hold: the terms of
    a word or phrase, in this order, and whether they must be absent. ``asked`` are the
    distinct terms that may occur, ``required`` those that every alternative needs.
    Operands without terms say nothing; an alternative or question of none matches nothing.
    """
    alternatives: list[list[dict]] = [[]]
    for minus, phrase, dash, word in _OPERAND.findall(question):
        if word.lower() == "or" and not dash:
            alternatives.append([])
            continue
        found, absent = terms(phrase or word), bool(minus or dash)
        whole = [found] if phrase or absent else [[t] for t in found]
        alternatives[-1] += [{"terms": t, "absent": absent} for t in whole if t]
    alternatives = [a for a in alternatives if a]
    present = [dict.fromkeys(t for item in a if not item["absent"] for t in item["terms"]) for a in alternatives]
    asked = dict.fromkeys(t for p in present for t in p)
    return {"any": alternatives, "asked": list(asked), "required": [t for t in asked if all(t in p for p in present)]}


def _lists(sizes: list[int | None], flat: pa.Array) -> pa.Array:
    """One list of each size from the flat values; a null for None."""
    ends = np.cumsum([0, *(n or 0 for n in sizes)], dtype=np.int32)
    missing = np.array([*(n is None for n in sizes), False])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing if missing.any() else None), flat)


@F.arrow_udf(ArrayType(StringType(), False))
def text_terms(texts: pa.Array) -> pa.Array:
    sizes, flat = [], []
    for x in texts:
        t = x.as_py()
        found = [] if t is None else terms(t)
        sizes.append(None if t is None else len(found))
        flat += found
    return _lists(sizes, pa.array(flat, pa.string()))


@F.arrow_udf(ArrayType(StructType([StructField("key", IntegerType(), False), StructField("value", DoubleType(), False)]), False))
def text_slots(texts: pa.Array, dimensions: pa.Array) -> pa.Array:
    d = dimensions[0].as_py() if len(dimensions) else 1
    sizes, keys, values = [], [], []
    for x in texts:
        t = x.as_py()
        found = {} if t is None else slots(t, d)
        sizes.append(None if t is None else len(found))
        keys += found
        values += found.values()
    return _lists(sizes, pa.StructArray.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.float64())], ["key", "value"]))


_ITEM = StructType([StructField("terms", ArrayType(StringType(), False), False), StructField("absent", BooleanType(), False)])
_QUERY = StructType([StructField("any", ArrayType(ArrayType(_ITEM, False), False), False), StructField("asked", ArrayType(StringType(), False), False), StructField("required", ArrayType(StringType(), False), False)])
_ARROW_TERMS = pa.list_(pa.field("element", pa.string(), False))
_ARROW_ITEM = pa.struct([pa.field("terms", _ARROW_TERMS, False), pa.field("absent", pa.bool_(), False)])
_ARROW_ITEMS = pa.list_(pa.field("element", _ARROW_ITEM, False))
_ARROW_QUERY = pa.struct([pa.field("any", pa.list_(pa.field("element", _ARROW_ITEMS, False)), False), pa.field("asked", _ARROW_TERMS, False), pa.field("required", _ARROW_TERMS, False)])


@F.arrow_udf(_QUERY)
def web_queries(questions: pa.Array) -> pa.Array:
    return pa.array([None if q.as_py() is None else web_query(q.as_py()) for q in questions], _ARROW_QUERY)
