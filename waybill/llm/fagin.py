"""Exact top-k inner products by Fagin's threshold algorithm.

Distinct vectors are dealt to blocks. A block sorts its vectors once per dimension. For a query, lists are read
from the end that its component's sign prefers, in step; every vector met is scored in full (random access); the
bound on the unmet is the score of an imagined vector made of each list's last value read. Reading stops when
the bound is under the k-th score, be it of this block or of the blocks that the task read before. Tasks' results are
merged, so nothing about the answer is approximate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import Best, Chunk, classes, search, valid

#: STEP: entries first read of each list; each further step reads half as many as were read before.
SCALE, STEP = 256, 32
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def top_k(x: np.ndarray, first: np.ndarray, order: np.ndarray, q: np.ndarray, k: int, step: int = STEP, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``k`` best inner products with ``q``, best first, ties to smaller ``first``, and their scores. With
    ``floor`` rows that score under it may be missing.

    x: integers, vectors by dimensions. order: for each dimension the rows in rising order of their component.
    """
    n = len(x)
    dims = np.flatnonzero(q)
    if not len(dims):
        best = np.argsort(first, kind="stable")[:k]
        return best, np.zeros(len(best), np.int64)
    if float(np.abs(q).max()) * float(max(abs(int(x.min())), abs(int(x.max())))) * x.shape[1] >= 2.0**62:  # beyond 64 bits: exact, in whole numbers of any size
        scores = x.astype(object) @ q.astype(object)
        best = np.array(sorted(range(n), key=lambda i: (-scores[i], first[i]))[:k], np.int64)
        return best, np.array([max(_LEAST, min(_MOST, int(scores[i]))) for i in best], np.int64)
    up = q[dims] < 0  # from the small end
    ends = np.where(up[:, None], order[dims], order[dims, ::-1])  # each list as it is read
    met = np.zeros(n, bool)
    at: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    best = np.empty(0, np.int64)
    depth = 0
    while depth < n:
        end = min(n, depth + max(step, depth // 2))
        new = np.zeros(n, bool)
        new[ends[:, depth:end].ravel()] = True
        new &= ~met
        rows = np.flatnonzero(new)
        at.append(rows)
        scores.append(x[rows] @ q)
        met |= new
        depth = end
        best = np.concatenate([best, scores[-1]])
        if len(best) > k:
            best = np.partition(best, len(best) - k)[-k:]
        bound = int((x[ends[:, end - 1], dims] * q[dims]).sum())
        if (len(best) >= k and bound < best.min()) or (floor is not None and bound < floor):
            break
    rows, values = np.concatenate(at), np.concatenate(scores)
    if len(rows) > k:
        stay = values >= np.partition(values, len(values) - k)[len(values) - k]
        rows, values = rows[stay], values[stay]
    best = np.lexsort((first[rows], -values))[:k]
    return rows[best], values[best]


def _pack(x: np.ndarray, ids: list[list[int]]) -> bytes:
    return pickle.dumps((x, np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32)), ids))


def _one_chunk(k: int):
    def found(blocks: DataFrame, chunk: Chunk) -> DataFrame:
        asked = blocks.sparkSession.sparkContext.broadcast(chunk)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            for batch in batches:
                for blob in batch.column(0):
                    x, order, ids = pickle.loads(blob.as_py())
                    first = np.array([i[0] for i in ids])
                    names, queries = asked.value.get(x.shape[1], ((), ()))
                    for query, q in zip(map(int, names), queries, strict=True):
                        # One class more than results: the query's own may hold the query alone.
                        rows, scores = top_k(x, first, order, q, k + 1, floor=best.floor(query))
                        best.add(query, scores.tolist(), [ids[r] for r in rows.tolist()])
            yield from best.rows(pa.int64())

        return blocks.mapInArrow(run, "query_id long, vec_id long, score long")

    return found


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by
    ``every``, the ``k`` other rows of the largest integer inner product of floor(scale * component).

    Null, empty and non-finite vectors and null ids take no part. A vector is compared with those of its own
    length. With fewer candidates all are returned. Repeated ids are one row if their vectors are equal; a query's own
    id is never its result. Ties go to the smaller vec_id. Other columns are ignored. An empty table gives an empty
    result. A scaled component or a score beyond 64 bits is taken as the end of their range.
    """
    rows = vectors.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec")).distinct()
    return search(classes(rows, k + 1), rows.where(F.col("vec_id") % every == 0), k, _pack, _one_chunk(k), "long")
