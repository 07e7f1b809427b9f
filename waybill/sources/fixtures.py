"""Generated frames, as DataFrames: what a subject is fed so that its delivery can be told apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAT_VALUE, CHECKER_CELL, TILE = 128, 8, 16


def _pixels(h: int, w: int, value: Callable[[Column, Column, Column], Column]) -> Column:
    """px of a frame: ``value`` of row, column and channel, in row-major order."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w * 3 - 1)), lambda i: value(F.floor(i / (3 * w)).cast("int"), F.pmod(F.floor(i / 3).cast("int"), F.lit(w)), F.pmod(i, F.lit(3))).cast("double"))


def _even(y: Column, x: Column, cell: int) -> Column:
    return F.pmod(F.floor(y / cell) + F.floor(x / cell), F.lit(2)) == 0


def flat(h: int, w: int) -> Column:
    return F.array_repeat(F.lit(float(FLAT_VALUE)), h * w * 3)


def checker(h: int, w: int) -> Column:
    return _pixels(h, w, lambda y, x, c: F.when(_even(y, x, CHECKER_CELL), 255).otherwise(0))


def signature(h: int, w: int) -> Column:
    """Three channels that differ, with pixels at both ends of the range."""
    cell = max(2, min(h, w) // 8)

    def value(y: Column, x: Column, c: Column) -> Column:
        place = F.pmod(y * w + x, F.lit(4))
        even = _even(y, x, cell)
        stripe = F.pmod(F.floor(x / cell), F.lit(2)) == 0
        return F.when(place == 0, 0).when(place == 1, 255).when(c == 0, F.when(even, 0).otherwise(255)).when(c == 1, F.when(even, 192).otherwise(32)).otherwise(F.when(stripe, 64).otherwise(224))

    return _pixels(h, w, value)


def index(h: int, w: int, number: Column) -> Column:
    """A tile of the frame's number with one dark and one light anchor, repeated."""
    return _pixels(h, w, lambda y, x, c: F.when((F.pmod(y, F.lit(TILE)) == 0) & (F.pmod(x, F.lit(TILE)) == 0), 0).when((F.pmod(y, F.lit(TILE)) == 0) & (F.pmod(x, F.lit(TILE)) == 1), 255).otherwise(number))


def frames(spark: SparkSession, kind: str, n_frames: int = 16, shape: tuple[int, int] = (64, 64)) -> DataFrame:
    """frame_pos, h, w, c, px of a clip: flat, checker, signature, or index (256 frames at most)."""
    h, w = shape
    if kind == "index" and n_frames > 256:
        raise ValueError("an index clip has 256 frames at most")
    px = {"flat": lambda: flat(h, w), "checker": lambda: checker(h, w), "signature": lambda: signature(h, w), "index": lambda: index(h, w, F.col("id"))}
    if kind not in px:
        raise ValueError(f"no such fixture: {kind}")
    return spark.range(n_frames).select(F.col("id").cast("int").alias("frame_pos"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(3).alias("c"), px[kind]().alias("px"))


def make_pair(spark: SparkSession, n_frames: int = 32, shape: tuple[int, int] = (64, 64), gt_kind: str = "index", lq_kind: str = "index") -> DataFrame:
    """Target and input frames of one clip, told apart by ``stream``."""
    one = lambda stream, kind: frames(spark, kind, n_frames, shape).select(F.lit(stream).alias("stream"), "*")
    return one("gt", gt_kind).unionByName(one("lq", lq_kind))
