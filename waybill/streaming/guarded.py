"""The guard in a stream: every micro-batch is judged before its sink sees it. An extension beyond batch gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.guard import StepGuard


def guarded_sink(stream: DataFrame, guard: StepGuard, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer whose query fails with the guard's finding on the first bad micro-batch, before ``sink`` gets it."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            guard.assert_batch(batch)
            sink(batch, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each)


def windowed_range(values: DataFrame, ts: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Observed extremes and the number of non-finite values by time window, with a watermark for late rows: the
    range gate's statistics of a stream."""
    v = F.col(value).cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    values = values.withColumn(ts, F.col(ts).cast("timestamp"))
    return values.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.count(v).alias("n"), F.count_if(bad).alias("n_bad"), F.min(F.when(~bad, v)).alias("v_min"), F.max(F.when(~bad, v)).alias("v_max"))
