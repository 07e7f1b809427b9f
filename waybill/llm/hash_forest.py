"""Approximate nearest neighbours by a hash-prefix forest (LSH forest in sorted arrays).

Each tree gives a vector a string of ``BITS`` random-hyperplane bits, and keeps the strings of all vectors in sorted
order; the array is cut into the row blocks of the table, each of them sorted. A query descends every tree to its
longest-prefix matches and ascends all trees in step, one bit at a time, so that the ranges of the sorted arrays that
share its prefix grow, until they hold enough entries. That is decided over the whole table: a first pass adds up, for
each query, the entries of all blocks at each prefix length; the ascent ends at the prefix length, and within it at
the tree, at which ``EFFORT`` entries for each vector are reached. The second pass gathers the candidates of those
ranges and scores them exactly.

The index depends on no sample: its hyperplanes are random (seeded), and every row is in it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import Best, Chunk, classes, search, valid

#: Trees, bits of a string, and entries that the ascent ends at, as a share of the vectors (and ``LEAST`` a tree at
#: least, so that tables of so many rows are searched whole); those of the query itself don't count. Entries of several
#: trees may be one candidate. On vectors without structure this share decides the recall.
TREES, BITS, EFFORT, LEAST, SEED = 64, 32, 0.6, 20, 20240607


def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS))


def strings(x: np.ndarray, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    """Vectors by trees: the hash strings, first bit highest."""
    out = np.empty((len(x), trees), np.uint32)
    planes = _planes(x.shape[1], trees, seed)
    weights = (np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        bits = _scaled(x[at : at + 1024]) @ planes > 0
        out[at : at + 1024] = (bits.reshape(-1, trees, BITS) * weights).sum(axis=2, dtype=np.uint32)
    return out


def ranges(keys: np.ndarray, asked: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Trees by queries: where the entries begin and end that share the first ``depth`` bits (one number, or trees by
    queries) with a query. keys: trees by sorted strings; asked: queries by trees."""
    shift = np.broadcast_to(BITS - np.asarray(depth), (len(keys), len(asked))).astype(np.uint64)
    begin = (asked.T.astype(np.uint64) >> shift) << shift
    end = begin + (np.uint64(1) << shift)
    low, high = np.empty(begin.shape, np.int64), np.empty(begin.shape, np.int64)
    for t, own in enumerate(keys):
        low[t], high[t] = np.searchsorted(own, begin[t], side="left"), np.searchsorted(own, end[t], side="left")
    return low, high


def entries(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Queries by prefix lengths 0 to BITS: entries of all trees that share so many bits."""
    out = np.zeros((len(asked), BITS + 1), np.int64)
    out[:, 0] = keys.size
    for depth in range(1, BITS + 1):
        low, high = ranges(keys, asked, depth)
        out[:, depth] = (high - low).sum(axis=0)
        if not out[:, depth].any():
            break
    return out


def ascent(held: np.ndarray, enough: np.ndarray, trees: int) -> np.ndarray:
    """Trees by queries: the prefix length at which the synchronous ascent leaves each tree. held: entries by prefix
    length over the whole table. The trees are taken in order at the last level, as many as are needed of it."""
    deep = np.minimum((held >= enough[:, None]).sum(axis=1) - 1, BITS)  # the longest prefix that holds enough
    deep = np.maximum(deep, 0)
    at = np.arange(len(held))
    upper = held[at, deep]
    lower = np.where(deep < BITS, held[at, np.minimum(deep + 1, BITS)], 0)
    some = np.ceil(trees * (enough - lower) / np.maximum(1, upper - lower)).clip(1, trees)
    level = np.where(np.arange(trees)[:, None] < some, deep, np.minimum(deep + 1, BITS))
    return np.where(upper < enough, 0, level)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows brought near 1 by a power of two, which changes no cosine and keeps their squares in range."""
    _, exponent = np.frexp(np.abs(x).max(axis=-1, keepdims=True))
    return np.ldexp(x, -exponent)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with ``q`` in double precision; equal rows get equal values."""
    x, q = _scaled(x), _scaled(q)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _pack(trees: int, seed: int):
    def pack(x: np.ndarray, ids: list[list[int]]) -> bytes:
        own = strings(x, trees, seed).T
        order = np.argsort(own, axis=1, kind="stable")
        small = x.astype(np.float32)
        exact = small if (small == x).all() else x
        return pickle.dumps((exact, np.take_along_axis(own, order, axis=1).astype(np.uint64), order.astype(np.int32), ids))

    return pack


def _one_chunk(k: int, trees: int, effort: float, seed: int):
    def found(blocks: DataFrame, chunk: Chunk) -> DataFrame:
        spark = blocks.sparkSession
        asked = spark.sparkContext.broadcast({n: (names, x, strings(x, trees, seed)) for n, (names, x) in chunk.items()})

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            rows: dict[int, int] = {}
            for batch in batches:
                for blob in batch.column(0):
                    x, keys, _, _ = pickle.loads(blob.as_py())
                    n = x.shape[1]
                    if n in asked.value:
                        sums[n] = sums.get(n, 0) + entries(keys, asked.value[n][2])
                        rows[n] = rows.get(n, 0) + len(x)
            for n, held in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), n)), pa.array(np.arange(len(held))), pa.array(np.full(len(held), rows[n])), *(pa.array(c) for c in held.T.copy())], names=["n", "q", "rows", *(f"d{d}" for d in range(BITS + 1))])

        names = [f"d{d}" for d in range(BITS + 1)]
        counted = blocks.mapInArrow(count, "n long, q long, rows long, " + ", ".join(f"{c} long" for c in names))
        table = counted.groupBy("n", "q").agg(F.sum("rows").alias("rows"), *(F.sum(c).alias(c) for c in names)).toArrow()  # a row a query of the chunk
        told = np.stack([c.to_numpy() for c in table.columns], axis=1) if table.num_rows else np.empty((0, BITS + 4), np.int64)
        levels: dict[int, np.ndarray] = {}
        for n in chunk:
            own = told[told[:, 0] == n]
            own = own[np.argsort(own[:, 1])]
            if len(own):
                levels[n] = ascent(own[:, 3:], trees + np.maximum(LEAST * trees, np.ceil(effort * own[:, 2])), trees).astype(np.int8)
        stop = spark.sparkContext.broadcast(levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            for batch in batches:
                for blob in batch.column(0):
                    x, keys, order, ids = pickle.loads(blob.as_py())
                    n = x.shape[1]
                    if n not in stop.value:
                        continue
                    x = x.astype(np.float64)
                    first = np.array([i[0] for i in ids])
                    names, queries, own = asked.value[n]
                    low, high = ranges(keys, own, stop.value[n].astype(np.int64))
                    for j, (query, v) in enumerate(zip(map(int, names), queries, strict=True)):
                        mark = np.zeros(len(x), bool)
                        mark[np.concatenate([order[t, a:b] for t, (a, b) in enumerate(zip(low[:, j].tolist(), high[:, j].tolist(), strict=True)) if a < b] or [np.empty(0, np.int32)])] = True
                        near = np.flatnonzero(mark)
                        score = cosine(x[near], v)
                        floor = best.floor(query)
                        if floor is not None:
                            near, score = near[score >= floor], score[score >= floor]
                        if len(near) > 4 * k:  # all that tie with the last of the best stay
                            stay = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                            near, score = near[stay], score[stay]
                        top = np.lexsort((first[near], -score))[: k + 1]
                        if len(top):
                            best.add(query, score[top].tolist(), [ids[r] for r in near[top].tolist()])
            yield from best.rows(pa.float64())

        return blocks.mapInArrow(run, "query_id long, vec_id long, score double")

    return found


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = TREES, effort: float = EFFORT, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) whose vec_id is divisible by
    ``every``, the ``k`` other rows found of largest cosine.

    Null, empty, zero and non-finite vectors and null ids take no part; a vector is compared with those of its own
    length. Equal vectors are one entry of the index with their smallest ids. With fewer candidates all found are
    returned. Repeated rows are one; ties go to the smaller vec_id. Other columns are ignored. An empty table gives an
    empty result. ``effort``: entries of the forest read for a query, as a share of the vectors.
    """
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).where(some).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).distinct()
    return search(classes(rows, k + 1), rows.where(F.col("vec_id") % every == 0), k, _pack(trees, seed), _one_chunk(k, trees, effort, seed), "double")
