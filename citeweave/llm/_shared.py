"""What several operators of this folder need: scratch tables and batch helpers."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import discard, materialize  # noqa: F401  (operators of this folder take them from here)

#: The operator that keeps something in this worker between batches, and how to let it go.
_kept: list[tuple[str, Callable[[], None]]] = []


def keep_alone(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called by a task of ``owner`` before it keeps caches in its worker, which ``forget`` lets go.

    Workers serve the tasks of one operator after another. What another operator kept
    here is let go first, so a worker never holds the caches of several.
    """
    if _kept and _kept[0][0] != owner:
        _kept.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
    if not _kept:
        _kept.append((owner, forget))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches where their texts reach ``most`` bytes, so Python holds few strings at a time.

    A text longer than that makes a slice of its own. A null text comes as "".
    """
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + sizes[end] <= most):
                total += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [t if t is not None else "" for t in part.column(column).to_pylist()]
            at = end


import pyarrow.compute  # noqa: E402,F401  (pa.compute is not loaded by pyarrow itself)
