"""Hashed character n-grams of UTF-8 bytes, vectorised."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
#: Bytes whose n-grams are hashed at once, which bounds what a text of any length takes.
BLOCK = 1 << 18


def blocks(data: bytes, lengths: Iterable[int], bits: int, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the given lengths, repeats kept, as uint32 below 2**bits, an array for each ``block`` bytes.

    An n-gram belongs to the block that it begins in.
    """
    wanted = sorted(set(lengths))
    for lo in range(0, len(data), block):
        raw = np.frombuffer(data, np.uint8, min(block + wanted[-1] - 1, len(data) - lo), lo).astype(np.uint32) + np.uint32(1)
        h, found = np.zeros(len(raw), np.uint32), []
        for n in range(1, wanted[-1] + 1):
            if n > len(raw):
                break
            h = h[: len(raw) - n + 1] * _STEP + raw[n - 1 :]
            if n in wanted:
                own = h[:block]
                mixed = (own ^ (own >> np.uint32(15))) * _MIX + np.uint32(n)
                found.append((mixed ^ (mixed >> np.uint32(13))) * _MIX >> np.uint32(32 - bits))
        yield np.concatenate(found) if found else np.zeros(0, np.uint32)


def hashes(data: bytes, lengths: Iterable[int], bits: int) -> np.ndarray:
    """All of ``blocks`` in one array."""
    return np.concatenate([np.zeros(0, np.uint32), *blocks(data, lengths, bits)])


def fold(doc_id: Column) -> Column:
    """Remainder of crc32 of the id's decimal text by 4; rows with 2 are held out. A null id has the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4).cast("int")


HELD_OUT = 2
