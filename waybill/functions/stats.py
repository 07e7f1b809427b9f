"""Statistics of delivered arrays, as column expressions. Arrays are row-major height, width, channel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_finite(x: Column) -> Column:
    """True for NaN and infinities. (The largest value can't tell: NaN sorts last.)"""
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def bimodality(px: Column) -> Column:
    """Share of values near either end of 0..255: under 15 or over 240."""
    return F.size(F.filter(px, lambda v: (v < 15) | (v > 240))) / F.size(px)


def to_255(px: Column) -> Column:
    """Bring a tensor to 0..255 by its own range: within 0..1 it is scaled by 255, else up to 1 it is taken as -1..1,
    else it stays. The decision is one for the tensor; a NaN in it leaves it as it is."""

    def scale(px: Column) -> Column:
        top = F.array_max(px)  # NaN is the largest
        unit = (top <= 1 + 1e-6) & (F.array_min(px) >= -1e-6)
        return F.when(unit, F.transform(px, lambda v: v * 255)).when(top <= 1 + 1e-6, F.transform(px, lambda v: (v + 1) * 127.5)).otherwise(px)

    return let(px, scale)


def channel_mae(px: Column, channels: int, a: int, b: int) -> Column:
    """Mean absolute difference of channels ``a`` and ``b`` of one frame."""
    n = F.floor(F.size(px) / channels).cast("int")
    at = lambda i, c: F.get(px, i * channels + c)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.abs(at(i, a) - at(i, b)))
    return F.when(n > 0, total / n)


def least_channel_mae(px: Column, channels: int) -> Column:
    """Over all pairs of channels; 0 where there is no pair."""
    pairs = [channel_mae(px, channels, a, b) for a in range(channels) for b in range(a + 1, channels)]
    return F.lit(0.0) if not pairs else F.least(*pairs) if len(pairs) > 1 else pairs[0]


def least_mae_of_frame(px: Column, channels: Column) -> Column:
    """The least mean absolute difference of two channels of a frame, whatever their number; 0 where there is no pair."""
    n = F.floor(F.size(px) / channels).cast("int")
    at = lambda i, c: F.get(px, i * channels + c)
    mae = lambda a, b: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.abs(at(i, a) - at(i, b))) / n
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), channels - 1), lambda b: F.transform(F.sequence(F.lit(0), b - 1), lambda a: mae(a, b))))
    return F.when((channels > 1) & (n > 0), F.array_min(pairs)).otherwise(F.lit(0.0))


def deltas(a: Column, b: Column) -> Column:
    """Absolute differences of two tensors of equal size."""
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def rms_distance(a: Column, b: Column) -> Column:
    """Root mean square difference of two vectors; exactly 0 for equal ones."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)
    return F.sqrt(total / F.size(a))


def aspect_error(dh: Column, dw: Column, eh: Column, ew: Column) -> Column:
    """Relative error of the delivered aspect ratio against the declared one."""
    return F.abs(dw / dh - ew / eh) / (ew / eh)


def upper_median(table: DataFrame, by: str) -> float | None:
    """The upper of the two middle values of a column where their number is even: read from counts of the distinct
    values, so that no task holds all of them."""
    counts = table.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return None
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(by)))
    return upto.where(F.col("upto") > total // 2).agg(F.min(by)).first()[0]


#: How near a level a value is, and the share of values that are an anchor or the number (fixed values).
LEVEL_TOLERANCE, LEVEL_SHARE = 2.0, 0.98


def decode_index(px: Column, floating: Column | bool = True, tolerance: float = LEVEL_TOLERANCE, agree: float = LEVEL_SHARE) -> Column:
    """The frame number that an index frame shows, null where it shows none.

    ``floating``: the values come from a floating-point tensor; then ones within 0..1 are scaled by 255, and ones within
    -1..1 from there. Whole numbers are levels already. Without anchors (values within the tolerance of 0 and of 255)
    the number is the mean, if the frame is flat within the tolerance. With them it is the median, and counts only
    within 0..255 and where nearly all values are within the tolerance of an anchor or the number.
    """
    n = F.size(px)
    real = F.lit(floating) if isinstance(floating, bool) else floating

    def levels(px: Column) -> Column:
        top, least = F.array_max(px), F.array_min(px)
        small = real & (top <= 1 + 1e-6)
        return F.when(small & (least >= -1e-6), F.transform(px, lambda v: v * 255)).when(small & (least >= -1 - 1e-6), F.transform(px, lambda v: (v + 1) * 127.5)).otherwise(px)

    def read(full: Column) -> Column:
        mean = F.aggregate(full, F.lit(0.0), lambda acc, v: acc + v) / n
        spread = let(mean, lambda m: F.sqrt(F.aggregate(full, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m)) / n))
        plain = F.when(spread <= tolerance, F.bround(mean).cast("int"))
        anchors = F.exists(full, lambda v: F.abs(v) <= tolerance) & F.exists(full, lambda v: F.abs(v - 255) <= tolerance)
        return F.when(~anchors, plain).otherwise(let(F.array_sort(full), anchored))

    def anchored(ordered: Column) -> Column:
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2

        def count(number: Column) -> Column:
            near = F.size(F.filter(ordered, lambda v: (F.abs(v) <= tolerance) | (F.abs(v - 255) <= tolerance) | (F.abs(v - number) <= tolerance))) / n
            return F.when((number >= 0) & (number <= 255) & (near >= agree), number.cast("int"))

        return let(F.bround(middle), count)

    return F.when((n <= 0) | n.isNull() | F.exists(px, lambda v: v.isNull() | non_finite(v)), None).otherwise(let(levels(px), read))


def content_hash(px: Column) -> Column:
    """The first 16 digits of the SHA-256 of a frame's values as rounded bytes, in order."""
    digits = F.array_join(F.transform(px, lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(v).cast("int"))).cast("long")), 2, "0")), "")
    return F.substring(F.sha2(F.unhex(digits), 256), 1, 16)
