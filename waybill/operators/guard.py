"""The guard before a training step: content gates on the very batch, and no step on a batch that breaks them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import TRAINING_STEP_INPUT
from .gates import channel_content, gate_name, value_range


class ContractViolation(RuntimeError):
    """Carries the findings that stopped a batch."""

    def __init__(self, results: list[Any]) -> None:
        self.results = results
        super().__init__("; ".join(f"{r['gate']} ({r['stream']}): {r['message'] or r['status']}" for r in results if r["status"] in ("FAIL", "UNDECL")))


def as_observations(batch: Any) -> DataFrame:
    """A batch is a DataFrame of observations: it has px and stream."""
    if not isinstance(batch, DataFrame) or not {"px", "stream"} <= set(batch.columns):
        raise TypeError("a batch is a DataFrame with px and stream, or give an extractor")
    return batch


class StepGuard:
    """Gates batches by ``contracts``. A batch is judged by one pass over it before the step runs on it."""

    def __init__(self, contracts: DataFrame, extractor: Callable[[Any], DataFrame] = as_observations, block: Iterable[str] = ("FAIL", "UNDECL"), certificate: list | None = None) -> None:
        self.contracts, self.extractor, self.block, self.certificate = contracts, extractor, tuple(block), certificate

    def observe(self, batch: Any) -> DataFrame:
        """subject, stream, gate, status, message of the batch, at the boundary before the step."""
        seen = self.extractor(batch).withColumn("boundary", F.lit(TRAINING_STEP_INPUT))
        names = ("subject", "stream", "status", "message")
        both = value_range(seen, self.contracts).select(F.lit(gate_name("value_range", TRAINING_STEP_INPUT)).alias("gate"), *names).unionByName(channel_content(seen, self.contracts).select(F.lit(gate_name("channel_content", TRAINING_STEP_INPUT)).alias("gate"), *names))
        if self.certificate is not None:
            self.certificate.extend(both.collect())
        return both

    def assert_batch(self, batch: Any) -> None:
        bad = self.observe(batch).where(F.col("status").isin(*self.block)).collect()
        if bad:
            raise ContractViolation(bad)

    def wrap(self, step: Callable[..., Any], argument: int | str = 0) -> Callable[..., Any]:
        """The step behind the guard. ``argument``: place or keyword of its batch."""

        @functools.wraps(step)
        def guarded(*args: Any, **kwargs: Any) -> Any:
            try:
                batch = args[argument] if isinstance(argument, int) else kwargs[argument]
            except (IndexError, KeyError):
                raise TypeError(f"the step was called without its batch ({argument})") from None
            self.assert_batch(batch)
            return step(*args, **kwargs)

        return guarded


def guard_step(contracts: DataFrame, **options: Any) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Decorator form of :class:`StepGuard`."""
    argument = options.pop("argument", 0)
    return lambda step: StepGuard(contracts, **options).wrap(step, argument)
