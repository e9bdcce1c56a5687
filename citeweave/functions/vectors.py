"""Vectors as Columns: lexical embeddings, cosine similarity, and sparse dot products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels, vocab


def let(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once, however often ``use`` refers to it, also inside lambdas."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and zero vectors."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def sparse_embedding(text: Column, dimensions: int = vocab.VECTOR_DIMENSIONS) -> Column:
    """Signed counts of a text's search terms, of length one, as a map from dimension to value; empty without terms.

    A term counts in the dimension that the first four bytes of its SHA-1 give, with the
    sign of the fifth. A dense vector of this kind is nearly all zeros, so the map is
    what is stored and compared; ``dense`` spells it out.
    """

    def unit(raw: Column) -> Column:
        length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, e: a + e["value"] * e["value"]))
        return let(length, lambda n: F.transform(raw, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.round(F.try_divide(e["value"], n), 8), F.lit(0.0)).alias("value"))))

    return F.map_from_entries(let(kernels.text_slots(text, F.lit(dimensions)), unit))


def dense(embedding: Column, dimensions: int = vocab.VECTOR_DIMENSIONS) -> Column:
    return let(embedding, lambda e: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at(e, i), F.lit(0.0))))


def square(embedding: Column) -> Column:
    """Squared length of a map; stored beside it, so that no pair computes it."""
    return F.aggregate(F.map_values(embedding), F.lit(0.0), lambda s, v: s + v * v)


def sparse_cosine(a: Column, b: Column, square_a: Column, square_b: Column) -> Column:
    """Cosine of two maps of one dimension count, given their squares.

    Only dimensions that both have are looked up: a map is searched entry by entry.
    """
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    inner = F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.try_element_at(a, k) * F.try_element_at(b, k))
    return F.coalesce(F.try_divide(inner, F.sqrt(square_a * square_b)), F.lit(0.0))
