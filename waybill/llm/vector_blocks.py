"""What the two vector searches share: valid vectors, classes of equal ones, row blocks in the shared folder, and
query chunks that pass by them.

Row blocks are made and written once. Queries come in chunks of a bounded size, which are sent to the tasks; a task
passes its row blocks one after the other and keeps what it has found for each query, so that a block profits
from the ones before. Rows meet queries without a shuffle: what is shuffled are the rows once, into blocks,
and a few results for each query and task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import append_table, drop_staged, own_dir, staged

#: Rows of a block, bytes of a chunk of queries (a proven bound on what is broadcast), and salts of a common vector.
BLOCK_ROWS, CHUNK_BYTES, SALTS = 2048, 16 << 20, 32

#: A chunk: for each vector length the ids and the vectors of its queries.
Chunk = dict[int, tuple[np.ndarray, np.ndarray]]


def valid(embedding: Column) -> Column:
    """Neither null nor empty, and all components are finite numbers."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~odd


def classes(rows: DataFrame, most: int) -> DataFrame:
    """vec, ids: each distinct vector with its ``most`` smallest ids. Only those can be among ``most`` - 1 results
    besides the query itself, since equal vectors score the same and ties go to smaller ids. A vector that a third
    of all rows share is cut down by salted groups before its rows meet."""
    salted = rows.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    first = salted.withColumn("rn", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("vec_id"))).where(F.col("rn") <= most)
    again = first.select("vec_id", "vec").withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("rn") <= most)
    return again.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def row_blocks(groups: DataFrame, pack: Callable[[np.ndarray, list[list[int]]], bytes]) -> tuple[DataFrame, str]:
    """The blocks (rows binary) of ``groups`` (vec, ids) in the shared folder, and their path. A block has vectors of
    one length, BLOCK_ROWS of them or so."""
    spark = groups.sparkSession
    groups, path = staged(groups, "classes")
    n = max(1, math.ceil(groups.count() / BLOCK_ROWS))
    parts = min(n, max(4 * spark.sparkContext.defaultParallelism, n // 16))
    key = F.shiftleft(F.size("vec").cast("long"), 32) + F.pmod(F.xxhash64("vec"), F.lit(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            blob = pack(_matrix(table.column("vec")), table.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.large_binary()).cast(pa.binary())], names=["rows"])

    blocks, block_path = staged(groups.withColumn("d", key).repartition(parts, "d").sortWithinPartitions("d").mapInArrow(run, "rows binary"), "blocks")
    drop_staged(spark, path)
    return blocks, block_path


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their last column -> a table for each of its values."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(batch.num_columns - 1).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if s == e:
                continue
            if keys[s] != now:
                if held:
                    yield pa.Table.from_batches(held)
                now, held = keys[s], []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def chunks(queries: DataFrame) -> Iterator[Chunk]:
    """The queries (vec_id, vec) in chunks of CHUNK_BYTES or so, whatever lengths their vectors have."""
    size, n = queries.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0)), F.count(F.lit(1))).first()
    count = max(1, math.ceil((8 * size + 64 * n) / CHUNK_BYTES))
    dealt = queries.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("q")).repartition(min(count, 200), "q").sortWithinPartitions("q")
    asked, path = staged(dealt, "asked")
    for q in range(count):
        table = asked.where(F.col("q") == q).select("vec_id", "vec").toArrow()
        lengths = pc.list_value_length(table.column("vec"))
        own = {n: table.filter(pc.equal(lengths, n)) for n in pc.unique(lengths).to_pylist()}
        yield {n: (t.column("vec_id").to_numpy(), _matrix(t.column("vec"))) for n, t in own.items()}
    drop_staged(queries.sparkSession, path)


class Best:
    """The best ``k`` of each query, as a task finds them: largest score first, ties to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.held: dict[int, list[tuple[float, int]]] = {}

    def floor(self, query: int) -> float | None:
        """The score that a row has to reach; None while any row is among the best."""
        held = self.held.get(query, ())
        return -held[-1][0] if len(held) == self.k else None

    def add(self, query: int, scores: list, ids: list[list[int]]) -> None:
        new = [(-s, i) for s, own in zip(scores, ids, strict=True) for i in own if i != query]
        self.held[query] = sorted({*self.held.get(query, ()), *new})[: self.k]

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows = [(q, i, -s) for q, held in self.held.items() for s, i in held]
        for at in range(0, len(rows), 50_000):
            a, b, c = zip(*rows[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, kind)], names=["query_id", "vec_id", "score"])


def search(groups: DataFrame, queries: DataFrame, k: int, pack, one_chunk: Callable[[DataFrame, Chunk], DataFrame], score: str) -> DataFrame:
    """query_id, rank, vec_id, score: ``one_chunk`` of the row blocks and each chunk of queries, merged. Each chunk's
    results are added to one table in the shared folder."""
    spark = groups.sparkSession
    blocks, path = row_blocks(groups, pack)
    kinds = f"query_id long, vec_id long, score {score}"
    out = f"{own_dir(spark)}/found-{uuid.uuid4().hex}"
    append_table(spark.createDataFrame([], kinds), out)
    for chunk in chunks(queries):
        if chunk:
            append_table(one_chunk(blocks, chunk), out)
    drop_staged(spark, path)
    found = spark.read.schema(kinds).parquet(out)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
