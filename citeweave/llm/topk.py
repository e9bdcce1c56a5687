"""Exact top-k search by term-at-a-time accumulation.

Vectors become integers, floor(64 x). Queries and candidates are dealt into blocks
by their position, and every query block meets every candidate block in one task. The
blocks are as large as a task can hold, because each row goes to as many tasks as the
other side has blocks: with ``QUERY_BLOCK`` queries in a task, a candidate is sent once
for that many queries. Within a task the candidates come in slices. A slice is held as
postings by dimension (term): for each non-zero component of a query it adds the
component times the posting's weights into the query's dense score array. A posting
list that covers most of a slice is kept as a full column, so the scatter is a
contiguous addition; a sparse one scatters by position. Of each score array a
partition selection keeps what can be among the k best. What slices, then blocks, have
kept is merged by score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

K, EVERY, SCALE = 20, 20, 64
#: Rows of a block: what one task holds of either side; and candidates whose postings are held at once.
QUERY_BLOCK, CANDIDATE_BLOCK, SLICE = 16_384, 65_536, 8192
#: Candidates that are worth a task of their own where there are few in all.
LEAST_BLOCK = 4096
#: Part of a block from which a posting list is kept as a full column.
FULL = 0.25
#: Queries whose score arrays are held at once.
BATCH = 64


def usable(vector: Column) -> Column:
    """Not null, with components, none of them null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and ``units``, the integer components; rows that take no part are gone."""
    kept = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("units"))


def _matrix(ids: np.ndarray, units: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id, then by vector, so that equal blocks are equal; short vectors end in zeros."""
    rows = np.zeros((len(ids), width), np.int64)
    for i, u in enumerate(units):
        rows[i, : len(u)] = u
    order = np.lexsort((*rows.T[::-1], ids))
    return ids[order], rows[order]


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, scores) for batches of queries, term at a time over the candidates' postings."""
    n, width = candidates.shape
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, width)
    # every kind is exact for scores up to ``most``; beyond long, Python's integers are exact and slow
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
    postings = []
    for t in range(width):
        column = candidates[:, t]
        at = np.flatnonzero(column)
        postings.append((None, column.astype(kind)) if len(at) >= FULL * n else (at, column[at].astype(kind)))
    weights = queries.astype(kind)
    room = np.empty(n, kind)
    for lo in range(0, len(queries), BATCH):
        batch = weights[lo : lo + BATCH]
        scores = np.zeros((len(batch), n), kind)
        for q, row in enumerate(batch):
            total = scores[q]
            for t in np.flatnonzero(row).tolist():
                at, column = postings[t]
                if at is None:
                    np.multiply(column, row[t], out=room)
                    np.add(total, room, out=total)
                elif len(at):
                    total[at] += column * row[t]
        yield lo, scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, without those of the query's own id; ids ascend."""
    n = len(scores)
    if n > 4 * k:
        lo, hi = np.searchsorted(ids, [own, own + 1]) if own < 2**63 - 1 else (np.searchsorted(ids, own), n)
        need = k + int(hi - lo)  # as many as that may be the query's own
        if n > need:
            # all above the last score that can count, and of those that equal it the first ones
            edge = scores[np.argpartition(scores, n - need)[n - need]] if scores.dtype != object else sorted(scores)[n - need]
            at = np.concatenate([np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)[:need]])
        else:
            at = np.arange(n)
    else:
        at = np.arange(n)
    at = at[ids[at] != own]
    order = sorted(at.tolist(), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else at[np.lexsort((ids[at], ~scores[at].astype(np.int64)))]
    return np.asarray(order, np.int64)[:k]


class _Block:
    def __init__(self, k: int):
        self.k = k

    def __call__(self, key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(max(map(len, left["units"])), max(map(len, right["units"])))
        q_ids, q_rows = _matrix(left["vec_id"].to_numpy(), left["units"].tolist(), width)
        order = right["vec_id"].argsort(kind="stable")
        ids, units = right["vec_id"].to_numpy()[order], right["units"]
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
        for lo in range(0, len(ids), SLICE):
            c_ids, c_rows = _matrix(ids[lo : lo + SLICE], units.iloc[order[lo : lo + SLICE]].tolist(), width)
            for first, scores in accumulate(q_rows, c_rows):
                for i, row in enumerate(scores, first):
                    at = best(row, c_ids, int(q_ids[i]), self.k)
                    found = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in row[at]], np.int64) if row.dtype == object else row[at].astype(np.int64)
                    if len(held[i][0]):
                        both, found = np.concatenate([held[i][0], c_ids[at]]), np.concatenate([held[i][1], found])
                        keep = np.lexsort((both, ~found))[: self.k]
                        held[i] = both[keep], found[keep]
                    else:
                        held[i] = c_ids[at], found
        return pd.DataFrame(
            {"query_id": np.repeat(q_ids, [len(h[0]) for h in held]), "vec_id": np.concatenate([h[0] for h in held]), "score": np.concatenate([h[1] for h in held])}
        ).astype("int64")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products.

    Both sides have the columns vec_id and embedding; others are not read. Every row
    but those of the query's own id is a candidate, also rows that repeat an id, and
    query rows that repeat one share its k places. Ties go to the smaller vec_id.
    Vectors of different lengths meet as if they ended in zeros. Null ids, null vectors
    and those with null or non-finite components take no part. With fewer than k
    candidates all are returned, of empty tables nothing; scores beyond a long are
    clipped to it. Both sides are written and counted when this is called, which sets
    the number of blocks.
    """
    spark = vectors.sparkSession
    held = materialize(quantized(vectors), "units")
    asked = materialize(quantized(queries), "query-units")
    n = held.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    c_blocks = max(1, math.ceil(n / CANDIDATE_BLOCK), min(tasks, math.ceil(n / LEAST_BLOCK)))
    # dealt by position in the written tables, so rows that repeat spread like any others
    place = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", place(q_blocks)).withColumn("cb", spread(c_blocks))
    right = held.withColumn("cb", place(c_blocks)).withColumn("qb", spread(q_blocks))
    search = _Block(k)
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(lambda key, q, c: search(key, q, c), "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(vectors: DataFrame, n: int = EVERY) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by n."""
    return vectors.filter(F.col("vec_id") % n == 0)


ORACLE = """
WITH units AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS u
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_dot_product(CAST(q.u AS DOUBLE[]), CAST(c.u AS DOUBLE[])) AS BIGINT) AS score
  FROM units q JOIN units c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
placed AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""
